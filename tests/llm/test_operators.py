"""The corpus operators against brute force, on small planted documents."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visitlens.llm import common, divergence, hpylm, langid, licences, mixing, ngram_join, packing, quality, substring, tiles, vector_dups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, sid long"  # the last two clash with inner names


def make(n=120, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 4, 5, 19, 20, 21, 80, 300]))]
        if k % 5 == 1 and texts[-1]:
            words = texts[-1].split()
            if words and k % 2:
                words[len(words) // 2] = "changed"
        text = " ".join(words)
        if k % 7 == 0:
            text = f"{text}\n{passage}\t tail{k}"
        texts.append(None if k % 31 == 30 else text if k % 13 else text.upper())
    texts += ["", "   \n", "x " * 30_000, "same words here", "same words here"]
    return [(k, t, ["en", "de", None][k % 3], [None, "a", "b", "a"][k % 4], None, "k", k) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_words_and_hashes_follow_the_text():
    import pyarrow as pa

    texts = ["a bc  d\n", None, "", "é x\ty", "a bc d", "  lead"]
    seen = collections.defaultdict(set)
    for size in (1, 6, 1 << 20):
        for lo, hi, b, off in common.text_chunks(pa.array(texts), size):
            s, e, first = common.word_spans(b, off)
            for i in range(lo, hi):
                got = [bytes(b[x:y]).decode() for x, y in zip(s, e)][first[i - lo] : first[i - lo + 1]]
                assert got == WORD.findall(texts[i] or "")
            for w, h in zip([bytes(b[x:y]) for x, y in zip(s, e)], common.word_hashes(b, s, e)):
                seen[w].add(int(h))
    assert all(len(h) == 1 for h in seen.values()) and len({h for x in seen.values() for h in x}) == len(seen)


def test_sketch_never_misses_a_repeat(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    h[5000:6000] = h[:1000]
    parts = [p for k in range(0, len(h), 3000) for p in common.sketch_parts(h[k : k + 3000], 20, 2)]
    sketch = common.merge_sketch(spark.createDataFrame([(b, bytearray(p)) for b, p in parts], "block int, payload binary"), 20, 2)
    assert sketch.repeated(h[:1000]).all() and sketch.repeated(h[6000:]).mean() < 0.1


def test_only_repeats_fill_a_repeat_filter(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 4_000_000, dtype=np.uint64) << np.uint64(1)
    h[2_000_000:2_002_000] = h[:2000]
    h[3_000_000:3_000_070] = h[7]
    space = common.cell_space(len(h))
    parts = [p for k in range(0, len(h), 900_000) for p in common.cell_parts(h[k : k + 900_000], space)]
    sketch = common.repeat_filter(spark.createDataFrame([(b, bytearray(p)) for b, p in parts], "block int, payload binary"), space, 8.0, 20, 1, (2, 8, 64))
    assert (sketch.level(h[:2000]) > 0).all() and sketch.level(h[7:8])[0] == 3
    assert (sketch.level(h[2000:2_000_000]) > 0).mean() < 0.08  # a sketch of 2**20 cells that counts all values calls every one repeated


def test_single_windows_do_not_fill_the_sketch_of_passages(spark, monkeypatch):
    """Three windows a cell: at any size, what is sent are the repeated ones and few more."""
    monkeypatch.setattr(substring, "MOST_BITS", 20)
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 200_000).tolist())) for _ in range(16)]
    texts[1] = " ".join(texts[0].split()[500:1000]) + " " + texts[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sketch = substring.repeat_sketch(docs, 20)
    own = [np.concatenate([h1 for *_, h1, _ in substring._windows(pa.array([t]), 20, False)]) for t in texts[1:3]]
    assert sketch.repeated(own[0][:481]).all() and sketch.repeated(own[1]).mean() < 0.05
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect()}
    assert got == {i: (200_500 if i == 1 else 200_000, 500 if i == 1 else 0) for i in range(16)}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({x for p in links for x in p}, links)
    assert all(want[i] == c for i, c in got.items()) and all(i in got or want[i] == i for i in want)


@pytest.mark.parametrize("salt_rows", [200_000, 7])
def test_packing(docs, empty, salt_rows):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, window=256, salt_rows=salt_rows).collect()
    tok = Tokenizer.from_file(packing.tokenizer_file())
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_plan_uses_each_piece_once_and_pads_little():
    hist = np.bincount(np.random.default_rng(2).integers(1, 2048, 20_000), minlength=2049)
    packs = packing.plan_packs(hist, 2048)
    used = np.zeros(2049, int)
    for lengths, n in packs:
        assert sum(lengths) <= 2048
        for a in lengths:
            used[a] += n
    assert (used == hist).all() and 1 - (hist @ np.arange(2049)) / (2048 * sum(n for _, n in packs)) < 0.01


def _ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in packing.encoder().texts(pa.array(texts, pa.string()))]


def _fresh_ids(texts):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(packing.tokenizer_file())
    return [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_on_texts_without_blanks():
    """Chinese, Thai, encoded bytes, and runs about the length from which the tokenizer takes over."""
    rng = random.Random(5)
    kinds = (("中文字符没有空格。", 20_000), ("ภาษาไทย", 20_000), ("abcXYZ0189+/", 1_000_000), ("éàü", 5_000), ("ab", 999), ("ab", 1001), (" ", 3_000), ("\n ", 999))
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in kinds] + [None, "", "x" + " " * 1200 + "y"]
    assert _ids(texts) == _fresh_ids(texts)


def test_encoder_is_the_tokenizer():
    assert _ids(["x <|endoftext|> y"]) == [[87, 220, 50256, 331]]
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "é", " x", "中", "<|endoftext|>", "<|endof", "text|>", "don't", "0.5", "\xad", "ɏ", "ɐ", "ª", "\x1c", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert packing.encoder().fast and _ids(texts) == _fresh_ids(texts)


def test_language_id_on_held_out_documents(spark, sf, empty):
    docs = common.table(spark, sf, "documents")
    held = common.crc_mod("doc_id", 4) == 2
    learnt = langid.learn(docs.where(~held).select("doc_id", "text", "lang"))
    got = langid.identify(docs, learnt, carry=("doc_id", "lang")).select("row.*", "lang_pred", "score").where(held).collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 34"), (4, "中文")], "doc_id long, text string")
    assert [(r.lang_pred == "und", r.rejected) for r in langid.identify(odd, learnt).orderBy("doc_id").collect()][:3] == [(True, True)] * 3
    assert langid.identify(empty, learnt).count() == 0 and langid.learn(empty) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_quality_on_held_out_documents(spark, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    held = common.crc_mod("doc_id", 5) == 0
    model = quality.learn(docs.join(labels.where(~held), "doc_id"))
    got = quality.score(docs, model).join(labels, "doc_id").where(held).collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert quality.score(empty, model).count() == 0
    none = quality.learn(empty.withColumn("quality", F.lit(1)))
    assert {r.score for r in quality.score(spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string"), none).collect()} == {0.5}


def test_trees_walk_like_their_definition():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    m = quality.fit(x, y, trees=30, depth=3)

    def walk(row):
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            total += leaf[k - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(m.score(x), [walk(r) for r in x]) and ((m.score(x) > 0.5) == y).mean() > 0.95


def test_ngram_join(docs, empty):
    rows = {r.doc_id: WORD.findall(lower(r.text)) for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for i, w in rows.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    assert len(set(want.values())) < len(want)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_documents_of_their_own_send_nothing_beside_many_others(spark, monkeypatch):
    """Three shingles a cell of the largest sketch: still only near copies are sent."""
    monkeypatch.setattr(ngram_join, "MOST_BITS", 20)
    sent, keyed = [], ngram_join._keyed
    monkeypatch.setattr(ngram_join, "_keyed", lambda *a: sent.append(keyed(*a)) or sent[0])
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 20_000).tolist())) for _ in range(160)]
    texts[9] = texts[3] + " more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: 3 if i == 9 else i for i in range(160)}
    assert sent[0].count() == 2


def test_ngram_tiles_find_what_pivots_do_not(spark):
    """Documents which share a passage and fall into several groups around it."""
    rng = random.Random(9)
    base = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"q{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    sets = {k: {tuple(t.split()[j : j + 5]) for j in range(56)} for k, t in rows}
    want = groups(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_ngram_join_of_a_large_group_around_a_passage(spark):
    """2 000 near copies of one text which fall into many components, copies of some,
    texts that only share the passage, null and repeated ids."""
    rng = random.Random(3)
    base, passage = [f"b{k}" for k in range(90)], [f"p{k}" for k in range(40)]
    rows = []
    for k in range(2000):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(90)] = f"q{rng.randrange(400)}"
        rows.append((k, " ".join(words)))
    rows += [(3000 + k, " ".join([f"u{k}-{j}" for j in range(rng.choice([5, 60]))] + passage)) for k in range(150)]
    rows += [(4000 + k, rows[k][1]) for k in range(0, 300, 3)] + [(None, rows[7][1]), (None, "only here with no id at all"), (7, rows[7][1]), (5, None)]
    sets = [frozenset(tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))) if t else frozenset() for _, t in rows]
    distinct, holders, links = sorted(set(sets), key=sorted), collections.defaultdict(list), set()
    for i, s in enumerate(distinct):
        shared = collections.Counter(j for g in s for j in holders[g])
        links |= {(i, j) for j, c in shared.items() if 100 * c >= 80 * (len(s) + len(distinct[j]) - c)}
        for g in s:
            holders[g].append(i)
    root, number = groups(range(len(distinct)), links), {s: i for i, s in enumerate(distinct)}
    least = collections.defaultdict(lambda: None)
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            r = root[number[s]]
            least[r] = i if least[r] is None else min(i, least[r])
    want = collections.Counter((i, len(s), least[root[number[s]]] if s else i) for (i, _), s in zip(rows, sets))
    assert len({c for _, _, c in want}) > 20
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_words_of_a_regular_pattern_have_hashes_of_their_own():
    """Thue-Morse words, which collide under any polynomial modulo 2**64."""
    import pyarrow as pa

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    (_, _, data, off), = common.text_chunks(pa.array([f"{a} {b} {a}"]))
    starts, ends, _ = common.word_spans(data, off)
    for seed in (0, 1):
        h = common.word_hashes(data, starts, ends, seed)
        assert h[0] != h[1] and h[0] == h[2]
        patterns = [common.window_hashes(np.where(np.frombuffer(w[:32].encode(), np.uint8) == 97, *h[:2]), 32, seed)[0] for w in (a, b)]
        assert patterns[0] != patterns[1]


def test_vectors(spark, empty):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(40):
            v = rng.normal(size=16)
            for k in range(rng.integers(1, 4)):
                w = v + rng.normal(size=16) * 0.14 * k * np.linalg.norm(v) / 4
                rows.append((n, [float(x) for x in w.astype(np.float32)], label))
                n += 1
    rows += [(n + 1, rows[0][1], 1), (n + 2, [2 * x for x in rows[0][1]], 1), (n + 3, None, 1), (n + 4, [0.0] * 16, 1), (n + 5, [float("nan")] * 16, 1), (n + 6, [None] * 16, 1), (n + 7, [1.0, 2.0], 1), (n + 8, [], 1)]
    good = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [
        (a, b) for a, (x, la) in good.items() for b, (y, lb) in good.items()
        if a < b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98
    ]
    count = collections.Counter(i for p in links for i in p)
    want = groups([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dups.link_vectors(df).collect()}
    assert len(links) > 20 and got == {r[0]: (count[r[0]], want[r[0]], want[r[0]] == r[0]) for r in rows}
    assert vector_dups.link_vectors(df.limit(0)).count() == 0


def _vector_links(rows):
    """By brute force: (vec_id, n_links, component) of rows with unlike ids."""
    unit = {i: np.array(v) / max(map(abs, v)) for i, v, _ in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and unit[a[0]] @ unit[b[0]] >= 0.98]
    count, component = collections.Counter(i for p in links for i in p), groups([r[0] for r in rows], links)
    return sorted((i, count[i], component[i]) for i, _, _ in rows)


@pytest.mark.parametrize("grid", [1, 2, 3, 6])
def test_vectors_of_one_label_in_small_tiles(spark, monkeypatch, grid):
    """Lengths from 1e-200 to 1e200, one large group of near copies, cells cut into tiles."""
    monkeypatch.setattr(vector_dups, "tiled", lambda rows, keys, member, name: tiles.tiled(rows, keys, member, name, tile_rows=20))
    rng, rows = np.random.default_rng(8), []
    centre = rng.normal(size=24)
    for i in range(260):
        v = centre + 0.1 * rng.normal(size=24) if i % 2 else rng.normal(size=24)
        rows.append((i, (v * 10.0 ** rng.choice([-200, 0, 200])).tolist(), 7))
    rows += [(300, [3 * x for x in rows[1][1]], 7), (301, [1e-3 * x for x in rows[0][1]], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_dups.link_vectors(df, grid=grid)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == _vector_links(rows)


def test_vectors_without_and_with_repeated_ids(spark):
    v, w = [1.0, 2.0, 3.0], [5.0, -1.0, 0.0]
    rows = [(1, v, 1), (1, v, 1), (2, v, 1), (None, v, 1), (None, w, 1), (3, w, 1), (4, v, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dups.link_vectors(df).collect())
    assert got == {(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 0, None, True): 2, (3, 0, 3, True): 1, (4, 0, 4, True): 1}


def test_grid_grows_with_the_largest_label():
    assert [vector_dups.grid_dims(n, 0.98, 8) for n in (0, 5_000, 300_000, 10**6, 10**12)] == [2, 2, 3, 4, 6]
    assert vector_dups.grid_dims(10**12, 1.0, 8) < 6


def test_divergence_base_counts(docs, empty):
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        w = WORD.findall(text)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (g.kept and g.base_failed)
    assert divergence.judge(empty).count() == 0


def test_divergence_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = divergence.judge(common.table(spark, sf, "documents")).join(common.table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert np.mean(good) > 0.99 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.9


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum((a * math.log2(a / c) if a else 0) / 2 + (b * math.log2(b / c) if b else 0) / 2 for a, b, c in zip(p, q, m)))
    row = spark.range(1).select(divergence.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()
    assert row[0] == pytest.approx(want)


def test_substrings(docs, empty):
    rows = sorted((r.doc_id, WORD.findall(r.text or "")) for r in docs.collect())
    seen, want = set(), {}
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.remove_repeats(docs, carry=("keys",)).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 100
    assert substring.remove_repeats(empty).count() == 0


def test_licences_by_common_sentences(spark):
    cases = {
        "This project is licensed under the MIT License - see the LICENSE.md file for details.": "MIT", "This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.": "MIT",
        "Licensed under the GPLv3.": "GPL-3.0", "Licensed under GPL-3.0-or-later.": "GPL-3.0", "Released under the Apache 2.0 license.": "Apache-2.0", "Distributed under MIT.": "MIT",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT", "// SPDX-License-Identifier: MIT OR Apache-2.0\n": "Apache-2.0,MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\n": "GPL-2.0", "you are licensed to drive or to fly": "", "mit": "",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {k: r.licences for k, r in zip(cases, licences.scan_licences(rows).orderBy("doc_id").collect())}
    assert got == cases


def test_licences_of_a_long_text_in_linear_time(spark):
    """A megabyte of two sentences of the BSD licence in turn: rules are walked, not searched back."""
    import time

    two = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nAll rights reserved.\n\n"
    took = []
    for n in (500, 6000):
        rows = spark.createDataFrame([(1, two * n)], "doc_id long, text string")
        began = time.time()
        (row,) = licences.scan_licences(rows).collect()
        took.append(time.time() - began)
        assert row.n_known == 2 * n and row.licences == "all-rights-reserved"
    assert took[1] < 30


def test_licences(spark, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    cases = {
        "x.\nReleased under the MIT License.": "MIT", mit + notice: "MIT", notice + "\n\n" + mit: "", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0. All rights reserved.": "Apache-2.0,all-rights-reserved", "no MIT licence here": "", "": "", None: "",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r.licences for r in licences.scan_licences(rows).orderBy("doc_id").collect()] == list(cases.values())
    bsd2 = (
        "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the"
        " above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and"
        " the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
    )
    bsd3 = bsd2 + "3. Neither the name of Example Org. Ltd, nor the names of its contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    bsd3 = bsd3.replace("Org. Ltd,", "Organisation")
    more = {
        bsd2: "BSD-2-Clause", bsd3: "BSD-3-Clause", bsd3 + bsd2: "BSD-3-Clause",
        "This software is released under the MIT License.": "MIT", "Licensed under the MIT License (see LICENSE)": "MIT", "All code here is dual licensed under the terms of the BSD 3-Clause License.": "BSD-3-Clause",
        "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "// SPDX-License-Identifier MPL-2.0": "MPL-2.0", "This library is distributed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "The person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.": "CC0-1.0",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "Unlicense",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.': "ISC",
        "the bus is under the bridge": "", "you are licensed to drive": "",
    }
    rows = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    got = {k: r.licences for k, r in zip(more, licences.scan_licences(rows).orderBy("doc_id").collect())}
    assert got == more
    assert licences.scan_licences(empty).count() == 0


def test_language_model(docs, empty, spark):
    training = docs.where("doc_id % 4 <> 0")
    rows = {r.doc_id: r for r in hpylm.score(docs, training, heavy=40).collect()}
    toks = {r.doc_id: [*WORD.findall(lower(r.text)), None] for r in docs.collect()}
    c = collections.Counter(w for i, t in toks.items() if i % 4 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
    again = {r.doc_id: r.score for r in hpylm.score(docs.repartition(3), training, heavy=40).collect()}
    assert all(rows[i].score == pytest.approx(again[i], rel=1e-6) for i in rows)
    assert hpylm.score(empty, training, heavy=40).count() == 0
    unlearnt = hpylm.score(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), empty).collect()
    assert len(unlearnt) == 2 and all(r.score == pytest.approx(0.0, abs=1e-6) for r in unlearnt)


def test_language_model_learns_alike_from_a_column_or_another_table(spark):
    """Which of its rows a table learns from may be said by a column or by a second table;
    in the second case no pair of the scored texts is taken for the training's own."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 60))), k % 3 != 0) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learns boolean")
    want = {r.doc_id: r.score for r in hpylm.score(docs, docs.where("learns"), heavy=20).collect()}
    for options in ({"heavy": 20}, {"heavy": 500, "pairs": 30}):
        assert {r.doc_id: r.score for r in hpylm.score(docs, "learns", **options).collect()} == pytest.approx(want, rel=1e-6)


def test_language_model_looks_up_a_slice_of_the_pairs_at_a_time(spark, monkeypatch):
    """However many slices: the same scores; with more, none stores as many looked-up tokens as one alone."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(40)), k % 3 != 0) for k in range(60)], "doc_id long, text string, learns boolean")
    sizes, store = [], hpylm.Scratch.store

    def counting(self, df, name):
        out = store(self, df, name)
        if name == "asked":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(hpylm.Scratch, "store", counting)
    one = {r.doc_id: r.score for r in hpylm.score(docs, "learns", heavy=10, slices=1, sweeps=2).collect()}
    whole, sizes[:] = sizes[0], []
    assert {r.doc_id: r.score for r in hpylm.score(docs, "learns", heavy=10, slices=3, sweeps=2).collect()} == pytest.approx(one, rel=1e-9)
    assert len(sizes) == 3 and sum(sizes) == whole and max(sizes) < 0.6 * whole


def test_language_model_looks_its_texts_up_once(spark):
    """Sums of texts are stored when the tokens to join are, so the result does not tokenise again."""
    docs = spark.createDataFrame([(1, "a b a b c"), (2, ""), (2, ""), (None, "c d")], "doc_id long, text string").withColumn("learns", F.col("doc_id") == 1)
    out = hpylm.score(docs, "learns", heavy=2, sweeps=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and out.count() == 4
    assert sorted(r.n_tokens for r in out.collect()) == [1, 1, 3, 6]


def test_language_model_sums_to_one(spark):
    """The probabilities of all words, of the unknown word and of the end add up to 1
    behind every context. With s(x) = P(x | begin) P(end | x) and s(xw), the ends behind
    each word are solved for; then what follows the beginning has to add up."""
    rng = random.Random(2)
    texts = spark.createDataFrame([(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12)))) for k in range(90)], "doc_id long, text string")
    words = [*"abcdefg", "zz"]
    asked = ["", *words, *(f"{x} {w}" for x in words for w in words)]
    # the heavy table of fewer words than there are sends some words the other way
    for heavy in (100, 3):
        got = {r.doc_id: 10**r.score for r in hpylm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), texts, heavy=heavy).collect()}
        s = {t: got[k] for k, t in enumerate(asked)}
        end = dict.fromkeys(words, 0.1)
        for _ in range(2000):
            end = {x: 1 / (1 + sum(s[f"{x} {w}"] / (s[x] * end[w]) for w in words)) for x in words}
        assert sum(s[x] / end[x] for x in words) + s[""] == pytest.approx(1, abs=1e-3)


def test_language_model_has_a_restaurant_for_every_previous_word(spark):
    """Of 200 words, each is followed by its own partner; the model knows all of them,
    whether looked up in tasks or joined."""
    texts = spark.createDataFrame([(k, f"a{k % 200} b{k % 200}") for k in range(800)], "doc_id long, text string")
    ask = spark.createDataFrame([(k, f"a{k} b{k}") for k in range(200)] + [(1000 + k, f"a{k} b{(k + 7) % 200}") for k in range(200)], "doc_id long, text string")
    runs = [{r.doc_id: r.score for r in hpylm.score(ask, texts, **o).collect()} for o in ({}, {"heavy": 20}, {"pairs": 10})]
    for got in runs:
        assert all(got[k] > got[1000 + k] + 1 for k in range(200))
        assert got == pytest.approx(runs[0], rel=1e-6)


def test_seating_has_as_many_tables_as_the_restaurant_expects():
    n, d, mass, base = 200_000, 0.5, 3.0, 0.2
    c = np.full(n, 5)
    t = hpylm.seat(c, np.full(n, base), np.full(n, d), np.full(n, mass), common.mix(np.arange(n).astype(np.uint64)))
    p = {1: 1.0}
    for j in range(1, 5):
        q = collections.defaultdict(float)
        for k, v in p.items():
            new = mass * base / (j - d * k + mass * base)
            q[k + 1] += v * new
            q[k] += v * (1 - new)
        p = q
    assert t.mean() == pytest.approx(sum(k * v for k, v in p.items()), rel=0.01)


@pytest.mark.parametrize("c,moves,sweeps,n", [(2, 32, 12, 20_000), (6, 32, 12, 20_000), (20, 5, 120, 4_000), (60, 32, 160, 1_500)])
def test_gibbs_sweeps_keep_to_the_exact_distribution_of_tables(c, moves, sweeps, n):
    """P(t) is proportional to S(c, t) times the masses of the tables opened, S being the
    generalised Stirling numbers; also where a sweep moves some of the customers only."""
    d, strength, base, others = 0.4, 2.0, 0.15, 9.0
    stirling = {1: 1.0}
    for m in range(1, c):
        stirling = {t: stirling.get(t - 1, 0.0) + (m - d * t) * stirling.get(t, 0.0) for t in range(1, m + 2)}
        most = max(stirling.values())
        stirling = {t: x / most for t, x in stirling.items()}
    p, mass = {}, 1.0
    for t in range(1, c + 1):
        mass *= (strength + d * (others + t - 1)) * base
        p[t] = stirling[t] * mass
    want = sum(t * x for t, x in p.items()) / sum(p.values())
    one = lambda x: np.full(n, float(x))
    size, off = hpylm.first_sizes(np.full(n, c), np.full(n, min(c, 3)), d)
    for k in range(sweeps):
        key = common.mix(np.arange(n).astype(np.uint64) + np.uint64(k * n + 77))
        size, off = hpylm.gibbs(size, off, np.full(n, c), moves, one(base), one(others), d, strength, key)
        assert size.min() >= 1 and (np.add.reduceat(size, off[:-1]) == c).all()
    assert np.diff(off).mean() == pytest.approx(want, rel=0.03)


def test_a_sweep_moves_every_customer():
    """Customers of one dish at two tables, where hardly any other is opened: blocks leave
    and come back until as many have moved as there are. The share of a table then strays
    as in that many draws; a sweep of 32 customers would hardly move it."""
    n, c = 400, 20_000
    key = common.mix(np.arange(n).astype(np.uint64))
    size, off = hpylm.gibbs(np.full(2 * n, c // 2), np.arange(n + 1) * 2, np.full(n, c), 32, np.full(n, 1e-12), np.full(n, 3.0), 0.5, 1.0, key)
    assert (np.diff(off) == 2).all() and (size.reshape(n, 2).sum(1) == c).all()
    # a move changes the size with variance 2 * 1/2 * 1/2, so c of them by sqrt(c / 2) = 100
    assert np.std(size.reshape(n, 2)[:, 0]) == pytest.approx(math.sqrt(c / 2), rel=0.2)


def test_gibbs_follows_changed_counts():
    """Customers come and go one by one; a dish without customers has no table."""
    c = np.array([0, 1, 3, 900, 40, 0])
    size, off = hpylm.first_sizes(np.array([5, 1, 0, 700, 2000, 0]), np.array([2, 1, 0, 9, 50, 0]), 0.5)
    size, off = hpylm.gibbs(size, off, c, 32, np.full(6, 0.1), np.full(6, 30.0), 0.5, 1.0, common.mix(np.arange(6).astype(np.uint64)))
    assert [int(size[i:j].sum()) for i, j in zip(off, off[1:])] == c.tolist() and size.min() >= 1


@pytest.mark.parametrize("d,strength,others,base", [(0.4, 2.0, 9.0, 0.15), (0.8, 1.0, 2e5, 0.01), (0.95, 1.0, 1e6, 0.5), (0.05, 10.0, 5e3, 1e-3)])
def test_many_customers_are_drawn_at_once_from_the_exact_distribution_of_tables(d, strength, others, base):
    """More customers than are tabled: integrals agree with the recursion of the Stirling numbers, and draws with the exact distribution."""
    c, n = hpylm.TABLE + 300, 20_000
    row = np.zeros(1)
    for m in range(1, c):
        stay = np.log(m - d * np.arange(1, m + 1)) + row
        row = np.append(np.logaddexp(np.append(-np.inf, row[:-1]), stay), row[-1])
    t = np.arange(1, c + 1)
    assert hpylm.log_stirling(np.full(c, c), t, d) == pytest.approx(row, abs=1e-7)
    p = row + np.append(0, np.cumsum(np.log((strength + d * (others + t[:-1])) * base)))
    p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
    got = hpylm.draw_tables(np.full(n, c), np.full(n, base), np.full(n, others), d, strength, common.mix(np.arange(n).astype(np.uint64)))
    assert np.abs(np.cumsum(np.bincount(got, minlength=c + 1)[1:] / n - p)).max() < 1.63 / math.sqrt(n)


def test_a_dish_of_any_number_of_customers_costs_alike():
    """Nothing is laid out by customer or table: of 10**9 customers, whose millions of tables would not fit, all leave and come back."""
    n = 50
    got = hpylm.draw_tables(np.full(n, 10**9), np.full(n, 0.05), np.full(n, 1e8), 0.5, 1.0, common.mix(np.arange(n).astype(np.uint64)))
    assert got.mean() > 10**6 and 0 < got.std() < math.sqrt(10**9) / 2 and (np.abs(got - got.mean()) < 6 * got.std()).all()


def test_levels_are_drawn_near_those_that_made_the_seating():
    rng, d, strength, tables = random.Random(4), 0.6, 10.0, []
    for n in range(20_000):
        if rng.random() < (strength + d * len(tables)) / (strength + n):
            tables.append(1)
        else:
            x, k = rng.random() * (n - d * len(tables)), 0
            while k < len(tables) - 1 and x >= tables[k] - d:
                x -= tables[k] - d
                k += 1
            tables[k] += 1
    one, seen = np.ones(1), collections.Counter(tables)
    sizes = (np.array(list(seen), float), np.array(list(seen.values()), float))
    draws = [hpylm.draw_level(sizes, (one * len(tables), one), (one * 20_000, one), 0.5, 1.0, k) for k in range(40)]
    assert np.mean([x[0] for x in draws]) == pytest.approx(d, abs=0.06)
    assert np.array_equal(np.round(hpylm._lgamma(np.array([0.3, 1.0, 7.5, 1e6])), 6), np.round([math.lgamma(x) for x in (0.3, 1.0, 7.5, 1e6)], 6))


def plain_pitman_yor(texts, asked, d, strength, sweeps, burn, seed=1):
    """Log10 probabilities by a sampler that moves customer by customer, all totals up to
    date, and tells the root of each table at once."""
    rng = random.Random(seed)
    tokens = [(u, w) for t in texts for u, w in zip([None, *t.split()], [*t.split(), None])]
    v = len({w for _, w in tokens})
    rooms = collections.defaultdict(lambda: collections.defaultdict(list))

    def prob(room, w, parent):
        n, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        return (sum(room[w]) - d * len(room[w]) + (strength + d * t) * parent) / (strength + n) if n else parent

    def root(w):
        return prob(rooms["root"], w, 1 / (v + 1))

    def enter(name, w):
        room, parent = rooms[name], 1 / (v + 1) if name == "root" else root(w)
        new = (strength + d * sum(map(len, room.values()))) * parent
        k = rng.choices(range(len(room[w]) + 1), [*(s - d for s in room[w]), new])[0]
        if k < len(room[w]):
            room[w][k] += 1
        else:
            room[w].append(1)
            if name != "root":
                enter("root", w)

    def leave(name, w):
        tables = rooms[name][w]
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            if name != "root":
                leave("root", w)

    for u, w in tokens:
        enter(("of", u), w)
    p = collections.defaultdict(float)
    for k in range(sweeps):
        for u, w in tokens:
            leave(("of", u), w)
            enter(("of", u), w)
        if k >= burn:
            for u, w in {x for t in asked for x in zip([None, *t.split()], [*t.split(), None])}:
                p[u, w] += prob(rooms["of", u], w, root(w)) / (sweeps - burn)
    return [sum(math.log10(p[x]) for x in zip([None, *t.split()], [*t.split(), None])) for t in asked]


def test_language_model_agrees_with_a_plain_sampler(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randint(0, 9)))
    texts, asked = [text() for _ in range(60)], [text() for _ in range(30)] + ["", "new", "w1 new w1"]
    want = plain_pitman_yor(texts, asked, 0.5, 1.0, 300, 50)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ask = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in hpylm.score(ask, rows, sweeps=10, burn=3, discounts=(0.5,), strengths=(1.0,), heavy=12).collect()}
    for k, t in enumerate(asked):
        assert got[k] == pytest.approx(want[k], abs=0.06 * (len(t.split()) + 1))
    assert sum(got.values()) == pytest.approx(sum(want), rel=0.01)


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = dict(zip(names, (3, 1, 2)))
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * sizes[s]]
        target |= {s: 2 * sizes[s] for s in full} if full else share
        left -= sum(2 * sizes[s] for s in full)
        free = free - set(full) if full else set()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(empty).count() == 0
    words = collections.Counter()
    for r in mixing.take(docs).collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert words == collections.Counter({r.doc_id: r.taken for r in rows if r.taken})
