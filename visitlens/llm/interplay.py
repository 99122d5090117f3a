"""Filter interaction audit: what each of five filters removes in every order of them.

Each document gets a mask of the filters that it fails. Four look at the document alone; the
fifth asks for a smaller doc_id with the same text. For that, texts go into compressed
(radix) tries that hold the smallest id at their terminals: first one trie for each batch of
a task, which leaves one row of each text, then one for each range of texts. The ranges are
of prefixes which are lengthened where more than ``bucket_texts`` different texts share one,
so that a trie never holds more, however alike texts begin. Only counts by part and mask
come out, and all orders are answered from these.

Defined results: a null text is empty, a null source the part ''; a document without doc_id
is never a duplicate and makes none; rows that repeat a doc_id and its text do not make each
other duplicates; labels that repeat an id count by their largest value; texts of any length
are inserted whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
SAME = 1 << FILTERS.index("E")
BUCKET_TEXTS = 4096
#: at most so many prefixes of a length are lengthened, which bounds what is broadcast
MOST_HEAVY = 1 << 20
FIRST_PREFIX, LONGER = 3, 4
PIECE = 1 << 20
TRIE_BYTES = 1 << 24


# ---------------------------------------------------------------- one document


def fails(text: bytes) -> int:
    """The mask of the filters A to D."""
    words, distinct, at = 0, set(), 0
    while at < len(text):  # pieces end where a word does, so that long texts need no list of all words
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        piece = text[at:end].split()
        words += len(piece)
        distinct.update(piece)
        at = end
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    points = len(text) - len(text.translate(None, bytes(b for b in range(256) if b & 0xC0 != 0x80)))
    symbols = len(text) != len(text.translate(None, SYMBOLS))
    return (words < 200) | (100 * len(distinct) < 50 * words) << 1 | (100 * upper > 2 * points) << 2 | symbols << 3


# ---------------------------------------------------------------- tries


class Node:
    __slots__ = ("edges", "held")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.held = None


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` are those of ``b`` from ``at`` on."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if b.startswith(a[lo:mid], at + lo) else (lo, mid - 1)
    return lo


class Trie:
    """A compressed trie of whole texts: an edge has the bytes up to where texts part."""

    def __init__(self):
        self.root, self.bytes = Node(), 0

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made where it is not there."""
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                child = Node()
                node.edges[text[at]] = (text[at:], child)
                self.bytes += len(text) - at
                return child
            label, child = edge
            if not text.startswith(label, at):
                k = shared(label, text, at)
                middle = Node()
                middle.edges[label[k]] = (label[k:], child)
                node.edges[text[at]] = (label[:k], middle)
                label, child = label[:k], middle
            node, at = child, at + len(label)
        return node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        stack = [(b"", self.root)]
        while stack:
            text, node = stack.pop()
            if node.held is not None:
                yield text, node
            stack += [(text + label, child) for label, child in node.edges.values()]


def settle(node: Node, doc_id: int, part: str, mask: int, n: int) -> Iterator[tuple]:
    """Hold the rows of the smallest id at the terminal, and give those that are sure to
    have a smaller one: (doc_id, part, mask, n)."""
    if node.held is None or doc_id < node.held[0]:
        old, node.held = node.held, (doc_id, mask, {part: n})
        if old is not None:
            yield from ((old[0], p, old[1] | SAME, k) for p, k in old[2].items())
    elif doc_id == node.held[0]:
        node.held[2][part] = node.held[2].get(part, 0) + n
    else:
        yield doc_id, part, mask | SAME, n


_OUT = "doc_id long, part string, mask int, n long, text string"
_NAMES = ["doc_id", "part", "mask", "n", "text"]
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _held(trie: Trie) -> Iterator[tuple]:
    for text, node in trie.terminals():
        doc_id, mask, parts = node.held
        for part, n in parts.items():
            yield doc_id, part, mask, n, text.decode()


def masks_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text) -> rows with a mask: those that are settled without text, and
    of each text of a batch those of the smallest id, with it."""
    for batch in batches:
        trie, out, held = Trie(), [], 0
        for doc_id, part, text in zip(*(batch.column(c) for c in ("doc_id", "part", "text"))):
            text = text.as_buffer().to_pybytes() if text.is_valid else b""
            mask, doc_id, part = fails(text), doc_id.as_py(), part.as_py()
            if doc_id is None:
                out.append((None, part, mask, 1, None))
                continue
            out += [(*r, None) for r in settle(trie.terminal(text), doc_id, part, mask, 1)]
            if trie.bytes > TRIE_BYTES:
                yield _batch(out + list(_held(trie)))
                trie, out = Trie(), []
        yield _batch(out + list(_held(trie)))
    give_back()


def settle_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in the order of their prefixes -> (doc_id, part, mask, n). A trie is
    given up where the prefix changes."""
    trie, prefix = Trie(), None

    def done():
        return [(d, p, m, n, None) for _, node in trie.terminals() for d, m, parts in [node.held] for p, n in parts.items()]

    for batch in batches:
        out = []
        for doc_id, part, mask, n, text, place in zip(*(batch.column(c).to_pylist() for c in (*_NAMES, "place"))):
            if text is None:
                out.append((doc_id, part, mask, n, None))
                continue
            if place != prefix:
                out += done()
                trie, prefix = Trie(), place
            out += [(*r, None) for r in settle(trie.terminal(text.encode()), doc_id, part, mask, n)]
        yield _batch(out)
    yield _batch(done())
    give_back()


def _rounds(docs: DataFrame, bucket_texts: int) -> list[tuple[int, DataFrame]]:
    """[(length, prefixes of that length which more than ``bucket_texts`` texts share)], to
    the length at which there are none. Each is at most MOST_HEAVY prefixes."""
    out, length = [], FIRST_PREFIX
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    bound = max(bucket_texts, docs.count() // MOST_HEAVY)
    while True:
        rows = texts.select(F.substring("text", 1, length).alias("p"), F.xxhash64("text").alias("h"), F.substring("text", 1, out[-1][0] if out else 0).alias("before"))
        rows = rows.join(F.broadcast(out[-1][1].withColumnRenamed("heavy", "before")), "before", "left_semi") if out else rows
        counted = rows.where(F.char_length("p") == length).select("p", "h").distinct().groupBy("p").count()
        heavy = stored(counted.where(F.col("count") > bound).select(F.col("p").alias("heavy")), "heavy-prefixes")
        if heavy.isEmpty():
            return out
        out.append((length, heavy))
        length *= LONGER


def masks(docs: DataFrame, bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """(doc_id, part, mask, n) of ``docs`` (doc_id, source, text): n rows with that mask."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    rounds = _rounds(docs, bucket_texts)
    rows = docs.mapInArrow(masks_of_batches, _OUT)
    length = F.lit(FIRST_PREFIX)
    for k, (size, heavy) in enumerate(rounds):
        mark = f"is_heavy_{k}"
        rows = rows.withColumn("p", F.substring("text", 1, size)).join(F.broadcast(heavy.withColumn(mark, F.lit(True))), F.col("p") == F.col("heavy"), "left").drop("p", "heavy")
        length = F.when(F.col(mark), F.lit(size * LONGER)).otherwise(length)
    # rows that are settled have no text: they are spread by their id
    place = F.coalesce(F.substr("text", F.lit(1), length), F.hex(F.xxhash64("doc_id", "n")))
    rows = rows.select(*_NAMES, place.alias("place"))
    return rows.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(settle_ranges, _OUT).drop("text")


# ---------------------------------------------------------------- all orders


def audit(docs: DataFrame, labels: DataFrame, bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """One row for each part, order of the filters and step of it."""
    found = masks(docs, bucket_texts).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = found.join(known, "doc_id", "left")
    good, toxic = (F.when(F.col(c) == 1, F.col("n")).otherwise(0) for c in ("quality", "toxic"))
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"))
    all_masks = range(1 << len(FILTERS))
    per = counts.groupBy("part").agg(*[F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in all_masks]).alias(c) for c in ("n", "good", "toxic")])

    def over(c: str, weight) -> Column:
        """The sum over masks of the counts, each times its weight."""
        return F.aggregate(F.transform(c, lambda v, m: v * weight(m)), F.lit(0).cast("long"), lambda a, v: a + v)

    def passing(c: str) -> Column:
        """For each set of filters, how many fail none of them."""
        return F.transform(F.sequence(F.lit(0), F.lit(len(all_masks) - 1)), lambda s: over(c, lambda m: F.when(m.bitwiseAND(s) == 0, 1).otherwise(0)))

    orders = F.array(*[F.array(*[F.lit(FILTERS.index(x)) for x in order]) for order in permutations(FILTERS)])
    per = per.select("part", "n", *[passing(c).alias(f"pass_{c}") for c in ("n", "good", "toxic")], F.explode(orders).alias("o"))
    steps = per.select("*", F.posexplode("o").alias("k", "f")).withColumns(
        {"bit": F.expr("cast(shiftleft(1, f) as int)"), "before": F.aggregate(F.expr("slice(o, 1, k)"), F.lit(0), lambda a, x: a + F.call_function("shiftleft", F.lit(1), x))}
    )

    def left(c: str, which: Column) -> Column:
        return F.get(f"pass_{c}", which)

    both = F.col("before") + F.col("bit")
    gone = {c: left(c, F.col("before")) - left(c, both) for c in ("n", "good", "toxic")}
    failing = left("n", F.lit(0)) - left("n", F.col("bit"))
    every = factorial(len(FILTERS))
    first = over("n", lambda m: F.when(m.bitwiseAND(F.col("bit")) == 0, 0).otherwise(F.floor(F.lit(every) / F.greatest(F.bit_count(m), F.lit(1)))))
    return steps.select(
        "part", F.array_join(F.transform("o", lambda x: F.substr(F.lit(FILTERS), x + F.lit(1), F.lit(1))), "").alias("filter_order"), (F.col("k") + 1).cast("int").alias("step"),
        left("n", both).alias("kept"), gone["n"].alias("removed"), (failing - gone["n"]).alias("redundant"), F.get("n", F.col("bit")).alias("unique_fails"),
        gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), first.cast("long").alias("shapley"),
    )


def oracle_sql() -> str:
    """DuckDB SQL: masks by a window over equal texts, and the orders by counting."""
    rest = "".join(f" join f f{k} on f{k}.l not in ({', '.join(f'f{j}.l' for j in range(1, k))})" for k in range(2, len(FILTERS) + 1))
    name = " || ".join(f"f{k}.l" for k in range(1, len(FILTERS) + 1))
    return f"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from d),
l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
m as materialized (
  select part, l.quality = 1 as good, l.toxic = 1 as toxic,
    (case when len(words) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end)
    || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 'C' else '' end) || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end)
    || (case when w.doc_id > min(w.doc_id) over (partition by text) then 'E' else '' end) as failed
  from w left join l on l.doc_id = w.doc_id),
c as (select part, failed, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, failed),
f as (select unnest(string_split('{",".join(FILTERS)}', ',')) as l),
o as (select {name} as filter_order from f f1{rest}),
s as (select filter_order, k::integer as step, filter_order[k] as l, left(filter_order, k - 1) as before from o, range(1, {len(FILTERS) + 1}) t(k)),
x as (select c.*, s.filter_order, s.step, contains(failed, l) as fails, before <> '' and regexp_matches(failed, '[' || before || '_]') as earlier, failed = l as alone from c, s)
select part, filter_order, step, coalesce(sum(n) filter (not fails and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (fails and not earlier), 0)::bigint as removed,
  coalesce(sum(n) filter (fails and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (alone), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (fails and not earlier), 0)::bigint as good_lost, coalesce(sum(toxic) filter (fails and not earlier), 0)::bigint as toxic_lost,
  coalesce(sum(n * ({factorial(len(FILTERS))} // greatest(1, length(failed)))) filter (fails), 0)::bigint as shapley
from x group by part, filter_order, step"""
