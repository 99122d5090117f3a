"""Conversation structure repair: the cheapest edits that make a conversation's roles an
optional system turn and then user and assistant in turn.

A conversation of any length is cut into blocks of at most ``block_rows`` rows of its order.
Each block first gives what it costs from each of four role states into each other; a walk
back over a conversation's blocks (16 numbers each) turns that into the bound of the rest at
each border. Then every block is searched by itself, from each state in which it could be
entered: depth first on an explicit stack, with lower bounds of every suffix, an incumbent
(cost, audit) and a table of the cheapest prefix at each node, which eliminates worse ones,
until nothing is left that could beat the incumbent. A walk forward picks each block's entry.
Only the codes of rows are looked at for that, one letter each; texts travel once, to be
written out under the edits, as a stream with the edits of one block in memory.

Edits by initial: Keep 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty turn)
2; a truncated row that stays costs 1 more; blank and duplicate rows have to go.

Defined results: a null role or text is one space; rows are ordered by turn, nulls first, and
rows of one turn by role and by a hash of role and text, so repeated rows are neighbours and
all but the first are duplicates; a null conv_id is a conversation like others; a
conversation without rows has no row here; a text of any length is looked at whole; an empty
table gives empty tables; extra columns are ignored, whatever their names. The digest of a
conversation is one stream in one task, as a hash of all its text has to be.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_ROWS = 4096
ROLES = "sua"
#: role states: nothing yet, after the system turn, after a user, after an assistant
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEVER = 1 << 30
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAULTS = ("none", "truncated", "duplicate", "blank")
_A = ord("A")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows damaged by the crc32 of ``conv_id:turn``
    modulo 20, a null being one space: 0 drops, 1 empties, 2 takes the marks of ends
    away, 3 repeats, 4 makes it the user's."""

    def text_of(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(text_of("role"))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).drop("nth")


# ---------------------------------------------------------------- the search in one block


def step_in(state: int, role: int) -> int:
    """The state after a role (0 system, 1 user, 2 assistant, 3 another), or -1."""
    if role == 0:
        return SYSTEM if state == START else -1
    if role == 1:
        return -1 if state == USER else USER
    return ASSISTANT if role == 2 and state == USER else -1


_NEXT = [[step_in(s, r) for r in range(4)] for s in range(STATES)]
#: where a turn leads that may be a user's or an assistant's
_MADE = [ASSISTANT if s == USER else USER for s in range(STATES)]


def decode(letter: str) -> tuple[int, int]:
    """A row's letter -> (role class, fault)."""
    return divmod(ord(letter) - _A, len(FAULTS))


def relax(cost: list[int]) -> list[int]:
    """With turns inserted first where that is cheaper."""
    start, system, user, assistant = cost
    u, a = min(user, assistant + INSERT), min(assistant, user + INSERT)
    return [min(start, u + INSERT), min(system, u + INSERT), u, a]


#: what is left to pay behind the last row: the end has to be at the start or after an assistant
AT_END = relax([0, NEVER, NEVER, 0])


def suffix_bounds(codes: str, ends: list[int]) -> list[list[int]]:
    """Lower bounds of the cost from each row and state on, ``ends`` being those behind
    the block."""
    out = [ends]
    for letter in reversed(codes):
        role, fault = decode(letter)
        after = out[-1]
        cost = [after[s] + DELETE for s in range(STATES)]
        if fault < 2:
            more = TRUNCATED * fault
            for s in range(STATES):
                kept = _NEXT[s][role]
                cost[s] = min(cost[s], after[_MADE[s]] + REROLE + more, after[kept] + KEEP + more if kept >= 0 else NEVER)
        out.append(relax(cost))
    return out[::-1]


def crossing(codes: str) -> list[int]:
    """What the block costs from each state (rows) into each state at its end."""
    columns = [suffix_bounds(codes, [0 if s == e else NEVER for s in range(STATES)])[0] for e in range(STATES)]
    return [min(NEVER, columns[e][s]) for s in range(STATES) for e in range(STATES)]


def search(codes: str, ends: list[int], last: bool, enter: int) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of the cheapest edits of a block from ``enter`` on, of
    equally cheap ones the least audit. Branches are taken in the order of their letters,
    so prefixes come to a node from the least on: a later one of the same cost is worse,
    and one is looked into again only if it is cheaper. Nothing is looked into that costs
    more than the bound at the root allows, which rises until something is found."""
    n = len(codes)
    bounds = suffix_bounds(codes, ends)
    rows = [decode(c) for c in codes]
    limit = bounds[0][enter]
    if limit >= NEVER:
        return NEVER, "", enter
    while True:
        incumbent = (limit + 1, "", enter)
        cheapest = [[NEVER] * STATES for _ in range(n + 1)]
        path: list[str] = []
        stack = [(0, enter, 0, 0, "")]
        while stack:
            i, state, cost, depth, letter = stack.pop()
            if cost + bounds[i][state] >= incumbent[0] or cost >= cheapest[i][state]:
                continue
            cheapest[i][state] = cost
            path[max(depth - 1, 0) :] = [letter] if letter else []
            if i == n and (not last or state in (START, ASSISTANT)):
                left = 0 if last else ends[state]
                if cost + left < incumbent[0]:
                    incumbent = (cost + left, "".join(path), state)
                continue
            branches = []
            if i < n:
                role, fault = rows[i]
                branches.append((i + 1, state, cost + DELETE, "D"))
            if i < n or last:
                branches.append((i, _MADE[state], cost + INSERT, "I"))
            if i < n and fault < 2:
                kept, more = _NEXT[state][role], cost + TRUNCATED * fault
                if kept >= 0:
                    branches.append((i + 1, kept, more + KEEP, "K"))
                branches.append((i + 1, _MADE[state], more + REROLE, "R"))
            stack += [(j, s, c, depth + 1, x) for j, s, c, x in reversed(branches)]
        if incumbent[0] <= limit:
            cost, audit, state = incumbent
            return cost - (0 if last else ends[state]), audit, state
        limit += 1


# ---------------------------------------------------------------- over all conversations


@dataclass
class Repair:
    """What was found: ``blocks`` (a row for each block of a conversation, with its audit),
    ``source`` (the rows) and ``scratch`` (stored tables)."""

    source: DataFrame
    blocks: DataFrame
    scratch: Scratch

    def conversations(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")]
        pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
        rows = self.blocks.groupBy("conv_id").agg(*sums, F.min("lo_turn").alias("lo"), F.max("hi_turn").alias("hi"), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
        gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
        return rows.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def rows(self) -> DataFrame:
        """conv_id, role and text of the repaired conversations. Each conversation's rows
        are neighbours in one partition, in order."""
        heads = self.blocks.select("conv_id", F.col("first.turn").alias("turn"), F.col("first.role").alias("role"), F.col("first.key").alias("key"), F.lit(0).alias("kind"), "block", "codes", "audit", "enters", F.lit(None).cast("string").alias("text"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("codes", "string"), ("audit", "string"), ("enters", "int"))]
        texts = self.source.select("conv_id", "turn", "role", _key().alias("key"), F.lit(1).alias("kind"), *none, "text")
        both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key", "kind", "block")
        both = both.select("conv_id", "role", "kind", "codes", "audit", "enters", "text")

        def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, edits = None, deque()

            def inserted() -> Iterator[tuple]:
                while edits and edits[0][0] == "I":
                    yield conv, edits.popleft()[1], ""

            for batch in batches:
                out = []
                for c, role, kind, codes, audit, enters, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "kind", "codes", "audit", "enters", "text"))):
                    if kind == 0:
                        conv = (c,)
                        edits.extend(_edits(codes, audit, enters))
                    else:
                        what, made = edits.popleft()
                        if what != "D":
                            out.append((conv, made or role, text))
                    out += inserted()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0][0] for r in out], batch.schema.field("conv_id").type), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string())], names=["conv_id", "role", "text"]
                )

        return both.mapInArrow(edit, f"conv_id {self.source.schema['conv_id'].dataType.simpleString()}, role string, text string")

    def digests(self) -> DataFrame:
        """conv_id and repaired_sha256, of ``role:text`` joined by newlines; conversations
        of which nothing is left have no row."""

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, sha = None, None

            def done(convs, hashes, kind):
                return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])

            kind = None
            for batch in batches:
                kind, convs, hashes = batch.schema.field("conv_id").type, [], []
                for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                    if sha is None or c != conv:
                        if sha is not None:
                            convs.append(conv)
                            hashes.append(sha.hexdigest())
                        conv, sha = c, hashlib.sha256()
                    else:
                        sha.update(b"\n")
                    sha.update(f"{role}:{text}".encode())
                yield done(convs, hashes, kind)
            if sha is not None:
                yield done([conv], [sha.hexdigest()], kind)

        return self.rows().mapInArrow(digest, f"conv_id {self.source.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def _edits(codes: str, audit: str, state: int) -> Iterator[tuple[str, str | None]]:
    """(edit, role that is made) in order. Inserted turns come before the row at hand."""
    at = 0
    for x in audit:
        role = decode(codes[at])[0] if at < len(codes) and x != "I" else 3
        made = None
        if x in "IR":
            state = _MADE[state]
            made = "user" if state == USER else "assistant"
        elif x == "K":
            state = _NEXT[state][role]
        at += x != "I"
        yield x, made


def _key():
    """Of role and text, 128 bits."""
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Repair:
    """``rows``: conv_id, turn, role, text."""
    scratch = Scratch(rows.sparkSession)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    blank = ~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    cut = ~F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    light = rows.select("conv_id", "turn", "role", _key().alias("key"), blank.alias("is_blank"), cut.alias("is_cut"))
    order = ["conv_id", "turn", "role", "key"]
    ordered = scratch.store(light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "repair-order")
    again = ordered.where("not is_blank").groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).where("n > 1")
    again = again.select(F.col("conv_id").alias("again_conv"), F.col("key").alias("again_key"), "first_pos")
    marked = ordered.join(again, F.col("conv_id").eqNullSafe(F.col("again_conv")) & (F.col("key") == F.col("again_key")), "left")
    fault = F.when(F.col("is_blank"), 3).when(F.coalesce(F.col("pos") > F.col("first_pos"), F.lit(False)), 2).when(F.col("is_cut"), 1).otherwise(0)
    role = F.when(F.substring("role", 1, 1) == "", 0).otherwise(F.position(F.substring("role", 1, 1), F.lit(ROLES)))
    role = F.when(role == 0, 3).otherwise(role - 1)
    marked = marked.select("conv_id", F.floor(F.col("pos") / block_rows).alias("block"), "pos", "turn", "role", "key", fault.alias("fault"), role.alias("class"))
    letter = F.char((F.lit(_A) + F.col("class") * len(FAULTS) + F.col("fault")).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter"))))
    blocks = marked.groupBy("conv_id", "block").agg(
        F.array_join(F.transform(listed, lambda x: x["letter"]), "").alias("codes"),
        F.min(F.struct("pos", "turn", "role", "key")).alias("first"),
        F.min("turn").alias("lo_turn"), F.max("turn").alias("hi_turn"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
        *[F.count_if(F.col("fault") == FAULTS.index(f)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    blocks = scratch.store(_crossed(blocks), "repair-blocks")
    back = scratch.store(_searched(_ends(blocks)), "repair-searched")
    found = scratch.store(_chained(back), "repair-found")
    scratch.drop(ordered, blocks, back)
    return Repair(rows, found, scratch)


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, values)
    return batch


_INTS, _STRINGS = pa.list_(pa.int32()), pa.list_(pa.string())


def _crossed(blocks: DataFrame) -> DataFrame:
    """Each block's crossing."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with(batch, crossing=pa.array([crossing(c) for c in batch.column("codes").to_pylist()], _INTS))

    return blocks.mapInArrow(cross, _schema(blocks, "crossing array<int>"))


def _schema(rows: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [more])


def _ends(blocks: DataFrame) -> DataFrame:
    """Back over each conversation's blocks: the bounds behind each."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, bound = None, None
        for batch in batches:
            ends, last = [], []
            for c, m in zip(batch.column("conv_id").to_pylist(), batch.column("crossing").to_pylist()):
                last.append(conv != (c,))
                if last[-1]:
                    conv, bound = (c,), AT_END
                ends.append(bound)
                bound = relax([min(m[s * STATES + e] + bound[e] for e in range(STATES)) for s in range(STATES)])
            yield _with(batch, ends=pa.array(ends, _INTS), is_last=pa.array(last, pa.bool_()))

    ordered = blocks.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.desc("block"))
    return ordered.mapInArrow(back, _schema(blocks, "ends array<int>, is_last boolean"))


def _searched(blocks: DataFrame) -> DataFrame:
    """Each block's cheapest edits from each state. Blocks are dealt anew, as those of one
    conversation may be many."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[search(c, e, last, s) for s in range(STATES)] for c, e, last in zip(*(batch.column(x).to_pylist() for x in ("codes", "ends", "is_last")))]
            yield _with(batch, costs=pa.array([[f[0] for f in x] for x in found], _INTS), audits=pa.array([[f[1] for f in x] for x in found], _STRINGS), exits=pa.array([[f[2] for f in x] for x in found], _INTS))

    return blocks.repartition("conv_id", "block").mapInArrow(look, _schema(blocks, "costs array<int>, audits array<string>, exits array<int>"))


def _chained(blocks: DataFrame) -> DataFrame:
    """Forward over each conversation's blocks: the state in which each is entered, and
    with it its edits; also the pairs of roles that don't belong beside each other, and
    turns that were counted in the block before."""
    legal = {(0, 1), (1, 2), (2, 1)}

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, before, turn = None, START, None, None
        for batch in batches:
            out = {k: [] for k in ("cost", "audit", "enters", "illegal", "turns")}
            for c, codes, costs, audits, exits, lo, hi, turns in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "codes", "costs", "audits", "exits", "lo_turn", "hi_turn", "turns"))):
                if conv != (c,):
                    conv, state, before, turn = (c,), START, None, None
                roles = ([] if before is None else [before]) + [decode(x)[0] for x in codes]
                out["illegal"].append(sum((a, b) not in legal for a, b in zip(roles, roles[1:])))
                out["turns"].append(turns - (turn is not None and lo == turn))
                out["enters"].append(state)
                out["cost"].append(costs[state])
                out["audit"].append(audits[state])
                state, before, turn = exits[state], roles[-1], hi if hi is not None else turn
            kinds = {"cost": pa.int64(), "audit": pa.string(), "enters": pa.int32(), "illegal": pa.int64(), "turns": pa.int64()}
            kept = [c for c in batch.schema.names if c in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(out[k], t) for k, t in kinds.items())], names=[*kept, *kinds])

    keep = ("conv_id", "block", "codes", "first", "lo_turn", "hi_turn", "blank", "duplicate", "truncated")
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    kept = ordered.select(*[c for c in blocks.columns if c in keep])
    return ordered.mapInArrow(forward, _schema(kept, "cost bigint, audit string, enters int, illegal bigint, turns bigint"))


def oracle_sql() -> str:
    """DuckDB SQL: the cheapest (cost, audit) of each state, row by row."""

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def plus(p: str, cost: int | str, letter: str) -> str:
        return f"{{'c': {p}.c + {cost}, 'a': {p}.a || '{letter}'}}"

    def inserted(alias: str) -> str:
        p = [f"{alias}.p{s}" for s in range(STATES)]
        user = least(p[2], *[plus(p[s], INSERT, "I") for s in (0, 1, 3)])
        return f"{p[0]} as q0, {p[1]} as q1, {user} as q2, {least(p[3], plus(user, INSERT, 'I'))} as q3"

    def when(test: str, option: str) -> str:
        return f"case when {test} then {option} else {never} end"

    never = f"{{'c': {NEVER}, 'a': ''}}"
    moves = [[plus("q0", 3, "D")], [plus("q1", 3, "D")], [plus("q2", 3, "D")], [plus("q3", 3, "D")]]
    moves[1].append(when("fault < 2 and cls = 's'", plus("q0", "fault", "K")))
    for s in (0, 1, 3):
        moves[2].append(when("fault < 2 and cls = 'u'", plus(f"q{s}", "fault", "K")))
        moves[2].append(when("fault < 2", plus(f"q{s}", "fault + 2", "R")))
    moves[3].append(when("fault < 2 and cls = 'a'", plus("q2", "fault", "K")))
    moves[3].append(when("fault < 2", plus("q2", "fault + 2", "R")))
    steps = ", ".join(f"{least(*m)} as p{s}" for s, m in enumerate(moves))
    return f"""
with recursive crcs as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as id from conversations),
bits as (select r as b, list_reduce(list_prepend(r, range(8)), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end) as t from range(256) t(r)),
tab as (select list(t order by b) as ts from bits),
hashed as (
  select c.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(id) + 1), lambda i: ascii(substr(id, i::integer, 1))::bigint)),
    lambda v, x: xor(v // 256, ts[(xor(v % 256, x))::integer + 1]))) % 20 as kind from crcs c, tab),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as nth from hashed where kind <> 0),
placed_ as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
ranked as (select *, row_number() over (partition by conv_id, role, text order by i) as seen from placed_),
rows_ as materialized (
  select conv_id, turn, role, text, i, left(role, 1) as cls, left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair,
    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 3 when seen > 1 then 2 when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 1 else 0 end as fault from ranked),
walk as (
  select distinct conv_id, 0::bigint as i, {{'c': 0, 'a': ''}} as p0, {never} as p1, {never} as p2, {never} as p3 from rows_
  union all
  select conv_id, i, {steps} from (select r.conv_id, r.i, r.cls, r.fault, {inserted('w')} from walk w join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1)),
ended as (
  select conv_id, {least('q0', 'q3')} as best from (select w.conv_id, {inserted('w')}, w.i, max(w.i) over (partition by w.conv_id) as n from walk w) where i = n),
placed as (
  select conv_id, best.c as cost, best.a as audit, unnest(string_split(best.a, '')) as edit, generate_subscripts(string_split(best.a, ''), 1) as k from ended where best.a <> ''),
counted as (
  select *, count(*) filter (edit <> 'I') over (partition by conv_id order by k) as i, count(*) filter (edit <> 'D') over (partition by conv_id order by k) as j from placed),
joined as (
  select c.conv_id, c.k, c.j, c.edit, r.role, r.text, max(case when c.edit = 'K' and r.cls = 's' then 1 else 0 end) over (partition by c.conv_id) as sys
  from counted c left join rows_ r on r.conv_id is not distinct from c.conv_id and r.i = c.i and c.edit <> 'I'),
texts as (
  select conv_id, sha256(string_agg(case when edit = 'K' then role when (j - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by k)) as sha
  from joined where edit <> 'D' group by conv_id),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 3) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 1) as truncated, count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) as illegal from rows_ group by conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join sums s on s.conv_id is not distinct from a.conv_id left join ended e on e.conv_id is not distinct from a.conv_id left join texts t on t.conv_id is not distinct from a.conv_id"""
