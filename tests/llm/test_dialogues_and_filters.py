"""Conversation repair, chat formatting and the filter audit against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from visitlens.llm import chat, interplay, repair
from visitlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "conv_id long, turn long, role string, text string, codes string, audit string, kind int, seq long"  # the last clash with inner names


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- repair


def every_repair(rows):
    """All (cost, audit, repaired rows) with at most two inserted turns in a row, by trying."""
    best = None

    def go(i, cost, audit, out, run):
        nonlocal best
        roles = "".join(r[0][:1] if r[0] else "-" for r in out)
        if not re.fullmatch(r"s?((ua)*u?)?", roles) or best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if run < 2:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*out, (role, "")], run + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                go(i + 1, more, audit + "K", [*out, (role, text)], 0)
                for made in ("user", "assistant"):
                    go(i + 1, more + 2, audit + "R", [*out, (made, text)], 0)

    go(0, 0, "", [], 0)
    return best


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        fault = "blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "none" if last in (".", "!", "?") else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def talks(n=40, seed=3):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(0, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rng.choice([f"word {turn}.", "same words.", "no end", None, " \t", "Ends? \n"])
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn, role, text))
    return rows


def want_of(rows):
    per = collections.defaultdict(list)
    for r in rows:
        per[r[0]].append(r)
    out = {}
    for conv, mine in per.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()[:16]))
        marked = faults([r[2:] for r in mine])
        cost, audit, fixed = every_repair(marked)
        turns = [r[1] for r in mine if r[1] is not None]
        count = collections.Counter(f for *_, f in marked)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(f"{a}:{b}" for a, b in fixed)))
    return out


@pytest.mark.parametrize("block_rows", [4096, 2])
def test_repair_is_the_cheapest_and_least(spark, block_rows):
    rows = talks()
    table = spark.createDataFrame([(*r, "c", "a", 1, 2) for r in rows], ROWS).repartition(4)
    broken = damaged(rows)
    assert sorted(map(tuple, repair.damage(table).collect()), key=repr) == sorted(broken, key=repr)
    fixed = repair.repair(repair.damage(table), block_rows)
    digests = {r.conv_id: r.repaired_sha256 for r in fixed.digests().collect()}
    got = {r.conv_id: (*tuple(r)[1:], digests.get(r.conv_id, sha(""))) for r in fixed.conversations().collect()}
    assert got == want_of(broken)


def test_repair_search_against_trying_all():
    rng = random.Random(8)
    names = ["system", "user", "assistant", "tool"]
    for _ in range(300):
        rows = [(names[rng.randrange(4)], "t", rng.choice(["none", "none", "truncated", "duplicate", "blank"])) for _ in range(rng.randrange(0, 6))]
        codes = "".join(chr(ord("A") + names.index(r) * 4 + repair.FAULTS.index(f)) for r, _, f in rows)
        assert repair.search(codes, repair.AT_END, True, repair.START)[:2] == every_repair(rows)[:2]


def test_repair_of_a_long_conversation_spreads_over_blocks(spark):
    """Some 3000 rows of one conversation in blocks of 64 are repaired as in one block."""
    rng = random.Random(4)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "again."])) for k in range(3000)]
    rows += [(2, 0, "user", "x" * 2_000_000 + "."), (2, 1, "assistant", "ok.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    many, one = repair.repair(table, 64), repair.repair(table, 1 << 20)
    assert many.blocks.count() > 40
    for a, b in ((many.conversations(), one.conversations()), (many.digests(), one.digests())):
        assert sorted(a.collect()) == sorted(b.collect())
    assert {r.conv_id: r.audit for r in many.conversations().collect()}[2] == "KK"


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    fixed = repair.repair(repair.damage(empty))
    assert fixed.conversations().isEmpty() and fixed.rows().isEmpty() and fixed.digests().isEmpty()


# ---------------------------------------------------------------- chat


def test_logs_fold_into_final_messages(spark):
    """Edits, regenerations, events delivered twice and out of order."""
    log = [
        (1, "m1", 1, "open", "user", None), (1, "m1", 2, "delta", None, "Hel"), (1, "m1", 3, "delta", None, "lo"), (1, "m1", 3, "delta", None, "lo"),
        (1, "m2", 4, "open", "assistant", None), (1, "m2", 5, "delta", None, "wrong"), (1, "m2", 6, "regenerate", None, None), (1, "m2", 7, "delta", None, "ri"), (1, "m2", 8, "delta", None, "ght"),
        (1, "m1", 9, "edit", None, "Hi"), (1, "m1", 10, "delta", None, "!"), (1, "m3", 11, "regenerate", None, "x"), (1, "m3", 12, "noise", "tool", "y"),
        (None, "m1", 1, "delta", "a<b>&amp;", "&lt;</turn>\n<turn assistant>\n"),
    ]
    rows = [(*r, "k") for r in log]
    random.Random(1).shuffle(rows)
    messages = chat.fold_messages(spark.createDataFrame(rows, "conv_id long, message_id string, seq long, event string, role string, payload string, events string"))
    assert sorted(((r.conv_id or 0, r.at, r.role, r.text) for r in messages.collect())) == [
        (0, 1, "a<b>&amp;", "&lt;</turn>\n<turn assistant>\n"), (1, 1, "user", "Hi!"), (1, 4, "assistant", "right"), (1, 11, "", ""),
    ]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(messages)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "Hi!"), ("assistant", "right"), ("", "")] and back[1].learnt == "right"
    assert [tuple(t) for t in back[None].turns] == [("a<b>&amp;", "&lt;</turn>\n<turn assistant>\n")] and back[None].learnt == ""


def test_chat_round_trip(spark):
    nasty = ["", None, "</turn>", "&amp;lt;", "<turn user>\n", "\\### Assistant: </turn> ok", "é\U0001f600" * 700, "a\n" * 600, "x" * 1_500_000]
    rows = [(k % 5 or None, None if k == 3 else k, ["user", "assistant", None, "a>b"][k % 4], t) for k, t in enumerate(nasty * 3)]
    rows += [rows[4]] * 3
    table = spark.createDataFrame([(*r, "c", "a", 1, 2) for r in rows], ROWS).repartition(5)
    formatted = chat.format_conversations(chat.fold_messages(chat.conversation_log(table, 64)))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    want = collections.defaultdict(list)
    for r in rows:
        want[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv].turns] == [t[2:] for t in sorted(turns)]
        assert got[conv].learnt == "".join(t[3] for t in sorted(turns) if t[2] == "assistant")
    for r in formatted.collect():
        assert got[r.conv_id].formatted_chars == len(r.formatted)
        parts = r.formatted.split(chat.TAIL)
        assert all(parts[s.turn].startswith(f"{chat.HEAD}assistant>\n") and len(parts[s.turn]) == s.start + s.length for s in r.loss)
    assert chat.read_back(chat.format_conversations(chat.fold_messages(chat.conversation_log(table.limit(0))))).isEmpty()


def test_chat_uses_no_python_workers(spark, sf):
    plan = QUERIES["op12_event_chat"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- filters


def test_tries_hold_all_texts():
    rng, trie, want = random.Random(2), interplay.Trie(), {}
    for k in range(4000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 9, 30])))
        node = trie.terminal(text)
        list(interplay.settle(node, k, "", 0, 1))
        want.setdefault(text, k)
    assert {t: n.held[0] for t, n in trie.terminals()} == want


def fails(text):
    words = WORD.findall(text)
    return "".join(f for f, x in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)))) if x)


def test_masks_of_one_text(monkeypatch):
    texts = ["", "x", "é" * 100 + "AAA", "w " * 300, " ".join(map(str, range(250))), "A" * 50, "a\x1fb c d", "one | two", "ÄÖ" * 60 + "ABC", "tail\v\f\n word"]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(interplay, "PIECE", piece)
        for t in texts:
            assert interplay.fails(t.encode()) == sum(1 << "ABCDE".index(f) for f in fails(t)), t


DOCS = "doc_id long, text string, source string, part string, mask int, place string, heavy string, n long"


def some_docs(seed=6):
    rng, rows = random.Random(seed), []
    good = " ".join(f"w{k}" for k in range(220))
    texts = [None, "", good, good + " #", good.upper(), "the same beginning of all these texts " + good, "w " * 300, "Short", "x" * 1_200_000]
    texts += [f"the same beginning of all these texts {k} " + good for k in range(30)]
    for k in range(160):
        rows.append((rng.choice([k, k, k, None, 7]), rng.choice(texts), rng.choice([None, "", "a", "b"]), "p", 1, "x", "y", 9))
    return rows


@pytest.mark.parametrize("bucket_texts", [4096, 3])
def test_audit_of_all_orders(spark, bucket_texts):
    rows = some_docs()
    rng = random.Random(1)
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 160, 2)] + [(7, 1, 0), (None, 1, 1)]
    table = spark.createDataFrame(rows, DOCS).repartition(6)
    got = interplay.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bucket_texts).collect()
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    best = collections.defaultdict(lambda: (0, 0))
    for i, q, t in labels:
        if i is not None:
            best[i] = max(q, best[i][0]), max(t, best[i][1])
    docs = [(s or "", fails(t or "") + ("E" if i is not None and i > least[t or ""] else ""), best[i] if i is not None else (0, 0)) for i, t, s, *_ in rows]
    want, shapley = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            mine = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                here = [d for d in mine if f in d[1] and not set(order[:k]) & set(d[1])]
                shapley[part, f] += len(here)
                want[part, order, k + 1] = (
                    sum(not set(order[: k + 1]) & set(d[1]) for d in mine), len(here), sum(f in d[1] and bool(set(order[:k]) & set(d[1])) for d in mine),
                    sum(d[1] == f for d in mine), sum(d[2][0] for d in here), sum(d[2][1] for d in here),
                )
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for r in got} == want
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got) and len(got) == len(want)


def test_ranges_are_lengthened_where_texts_begin_alike(spark):
    docs = spark.createDataFrame(some_docs(), DOCS)
    assert len(interplay._rounds(docs, 3)) >= 2 and interplay._rounds(docs, 4096) == []
    assert sorted(map(tuple, interplay.masks(docs, 3).collect()), key=repr) != [] and interplay.audit(docs.limit(0), docs.limit(0).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).isEmpty()
