"""N-gram Jaccard join: exact near-duplicate groups of whole texts.

A document is the set of its distinct five-word shingles, as sorted 64-bit hashes; sets
have 128-bit ids, and equal ids are one set from the start. All shingles are ordered by
the level of a count-min sketch of their counts, rare ones first, then by hash. Under
such an order, two sets of Jaccard 0.8 share a shingle among the first n - ceil(0.8 n) + 1
of the larger and the first n - ceil(1.6 n / 1.8) + 1 of the smaller one (its index
keys). Shingles which the sketch knows to be in one document only come first and need
not be sent, so a document with more than a fifth of its own shingles sends nothing.
Sets that share a key are compared in three steps, none of which returns pairs: each
gives at most as many rows as came in.

1. Each set with up to four pivots, which are members of its keys' groups. The rows of a
   pivot are a tile, or several if they are many; in it, the pivot's array is intersected
   with each member's. This resolves groups of copies at a cost in proportion to them.
2. What is left of a key's group, if it is in more than one component, in tiles: the
   sets of a size band and the index sets of the band below (sizes further apart cannot
   reach 0.8). A pair that shares an earlier one of the sets' ``FEW`` first keys, by
   how many share them, is left to that key's tile, so that few rows are left. They come
   again with bitmaps, ``BITS_PER_SHINGLE`` bits a shingle, folded to one length inside
   a tile: the bits which only one of two has bound the overlap from above. Rows with a
   partner that may link go on.
3. These rows, with their arrays, in the same tiles: exact sorted intersection of what
   passes the bitmaps, unless already linked. A set goes out with the root that it has
   inside the tile.

Components come from these links by spreading minima. All pairs of sets that could link
are either compared or already in one component. A tile that would be too large by rows
or by shingles is split by salts.

Defined results: a text without words (or null) is empty, linked with nothing, its own
component; under five words, the whole sequence is one shingle; rows which repeat a
doc_id are copies like any others, and keep their rows; a null doc_id names a component
only where all ids of it are null; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import FLUSH, Scratch, Sketch, Space, cell_parts, cell_space, components, give_back, lower_ascii, mix, ranges, repeat_filter, text_chunks, window_hashes, word_hashes, word_spans
from .tiles import Roots, binary16, pairs_behind, salts_of, tiled, whole_groups

WORDS = 5
PERCENT = 80
BITS_PER_SHINGLE = 16
FEW = 8
PIVOT_SEEDS = (11, 12)
CELLS_PER_REPEAT, MOST_BITS = 2.0, 29
LEVELS = (2, 8, 64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: first row, all sets' sorted hashes, and where each set begins."""
    for lo, _, b, off in text_chunks(texts):
        starts, ends, first = word_spans(lower_ascii(b), off)
        h = word_hashes(lower_ascii(b), starts, ends)
        n = np.diff(first)
        at = ranges(first[:-1], np.maximum(first[1:] - (words - 1), first[:-1]))
        doc = np.repeat(np.arange(len(n)), np.maximum(n - (words - 1), 0))
        grams = window_hashes(h, words)[at]
        short = np.flatnonzero((n > 0) & (n < words))
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for k in range(words - 1):
                there = n[short] > k
                total[there] = mix(total[there] + h[first[short[there]] + k] + np.uint64(k + 1))
            grams, doc = np.concatenate([grams, mix(total ^ np.uint64(0xABCD))]), np.concatenate([doc, short])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[new], doc[new]
        yield lo, grams, np.searchsorted(doc, np.arange(len(n) + 1))


def set_ids(grams: np.ndarray, edge: np.ndarray) -> pa.Array:
    """A 128-bit id of each set: two scrambled sums of its scrambled members."""
    halves = []
    for seed in (0x1234567, 0x89ABCDEF01):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ np.uint64(seed)), out=total[1:])
        halves.append(mix(total[edge[1:]] - total[edge[:-1]] + np.diff(edge).astype(np.uint64)))
    data = np.stack(halves, 1).astype("<u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(np.arange(0, len(data) + 1, 16, dtype=np.int32)), pa.py_buffer(data)])


def signature(grams: np.ndarray) -> np.ndarray:
    """A bitmap of at least ``BITS_PER_SHINGLE`` bits for each shingle, its length in
    64-bit words being a power of two."""
    words = 1 << max(0, int(np.ceil(np.log2(max(1, len(grams)) * BITS_PER_SHINGLE / 64))))
    out = np.zeros(64 * words, bool)
    out[(grams & np.uint64(64 * words - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words."""
    return np.bitwise_or.reduce(sig.reshape(-1, words), 0)


def _long_lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))


def _survey(docs: DataFrame, space: Space) -> DataFrame:
    """One pass: (doc_id, n, sid) of every document, and the parts of all shingles' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            parts = list(cell_parts(np.concatenate(held), space))
            none = [pa.nulls(len(parts), t) for t in (kind, pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=names)

        names = ["doc_id", "n", "sid", "block", "payload"]
        for batch in batches:
            for lo, grams, edge in shingle_sets(batch.column(1)):
                k = len(edge) - 1
                held.append(grams)
                n += len(grams)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, k), pa.array(np.diff(edge)), set_ids(grams, edge), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names
                )
                if n >= FLUSH:
                    yield flush(batch.column(0).type)
                    held, n = [], 0
        if held:
            yield flush(batch.column(0).type)
        give_back()

    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n", "long").add("sid", "binary").add("block", "integer").add("payload", "binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _keyed(docs: DataFrame, sketch: Sketch, percent: int) -> DataFrame:
    """(sid, n, keys, n_index, sig, grams) of each set that has a key to send, once in
    each task: its keys in order, the first n_index of which are index keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            for _, grams, edge in shingle_sets(batch.column(0)):
                level = sketch.level(grams)
                n = np.diff(edge)
                total = np.concatenate([[0], np.cumsum(level == 0)])
                own = total[edge[1:]] - total[edge[:-1]]
                probe = n - (percent * n + 99) // 100 + 1 - own
                index = n - (2 * percent * n + 99 + percent) // (100 + percent) + 1 - own
                ids = set_ids(grams, edge)
                pick = []
                for i in np.flatnonzero((n > 0) & (probe > 0)):
                    if (x := ids[i].as_py()) not in done:
                        done.add(x)
                        pick.append(i)
                if not pick:
                    continue
                keys = []
                for i in pick:
                    mine, lv = grams[edge[i] : edge[i + 1]], level[edge[i] : edge[i + 1]]
                    keys.append(mine[np.argsort(lv, kind="stable")[own[i] : own[i] + probe[i]]])
                pick = np.array(pick)
                sigs = [signature(grams[edge[i] : edge[i + 1]]) for i in pick]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(pick)), pa.array(n[pick]), _long_lists(np.concatenate(keys), np.array([len(k) for k in keys])), pa.array(np.maximum(index[pick], 0)),
                        _long_lists(np.concatenate(sigs), np.array([len(x) for x in sigs])), _long_lists(grams[ranges(edge[pick], edge[pick + 1])], n[pick]),
                    ],
                    names=["sid", "n", "keys", "n_index", "sig", "grams"],
                )
        give_back()

    return docs.select("text").mapInArrow(run, "sid binary, n long, keys array<long>, n_index long, sig array<long>, grams array<long>")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Of sorted distinct values, how many are in both."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    na, nb = len(a), len(b)
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    common = _overlap(a, b)
    return 100 * common >= percent * (na + nb - common)


def _list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each row's begin."""
    edge = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), edge


# ---------------------------------------------------------------- step 1: pivots


def _star_links(star: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(pivot, sid) -> (a, b): the rows whose sets link."""
    star = scratch.store(star.join(sets.select("sid", "n"), "sid"), "star")
    large = salts_of(star, ["pivot"], "star", weight="n")
    rows = star.join(large, "pivot", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    members = rows.select("pivot", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int").alias("salt"), "sid", F.lit(1).alias("part"))
    heads = rows.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).distinct()
    heads = heads.select("pivot", "salt", F.col("pivot").alias("sid"), F.lit(0).alias("part"))
    tiles = members.unionByName(heads).join(sets.select("sid", "grams"), "sid").select("pivot", "salt", "part", "sid", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            values, edge = _list_values(batch.column(4))
            pivots, salts, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = []
            for i, at in enumerate(zip(pivots, salts)):
                mine = values[edge[i] : edge[i + 1]]
                if parts[i] == 0:
                    tile, head = at, mine.copy()
                elif at == tile and _links(head, mine, percent):
                    hit.append(i)
            pick = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(3).take(pick)], names=["a", "b"])

    dealt = tiles.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "part")
    out = scratch.store(dealt.mapInArrow(run, "a binary, b binary"), "star-links")
    scratch.drop(star)
    return out


def _pivots(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(pivot, sid): each set with the pivots of its keys' groups, at most two under each
    of two orders. A group's pivot is the first of its index sets under the order."""
    ranks = [F.min(F.when(F.col("index"), F.struct(F.xxhash64(F.lit(s), "sid").alias("r"), "sid")))["sid"].alias(f"p{s}") for s in PIVOT_SEEDS]
    groups = keys.groupBy("h").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), *ranks).where("lo <> hi and p11 is not null").drop("lo", "hi")
    groups = scratch.store(groups, "pivots")
    ends = [f(f"p{s}").alias(f"{f.__name__}{s}") for s in PIVOT_SEEDS for f in (F.min, F.max)]
    star = keys.select("h", "sid").join(groups, "h").groupBy("sid").agg(*ends)
    return star.select(F.explode(F.array_distinct(F.array("min11", "max11", "min12", "max12"))).alias("pivot"), "sid").where("pivot <> sid")


# ---------------------------------------------------------------- steps 2 and 3: tiles


def _mixed_members(keys: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, sid, n, index, comp, many): the rows of those keys whose sets are in more than
    one component; many is the key's number of rows."""
    member = keys.join(found.select(F.col("id").alias("sid"), "component"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    member = scratch.store(member.select("h", "sid", "n", "index", "comp"), "members")
    groups = member.groupBy("h").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("many"), F.max("index").alias("any")).where("p <> q and any")
    out = scratch.store(member.join(groups.select("h", "many"), "h"), "mixed-members")
    scratch.drop(member)
    return out


TILE_KEYS = ["h", "band", "ti", "tj"]
TILE_SCHEMA = "h long, band int, ti int, tj int, salt int, sid binary, comp binary, n long, index boolean, visitor boolean, earlier array<long>"
TILE_COLUMNS = [c.split()[0] for c in TILE_SCHEMA.split(", ")]


def _tile_rows(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows of mixed groups in their tiles. ``earlier``: of the set's first index keys,
    those before this one. Keys of like counts come in the order in which sets send
    them, so that sets which share many keys have most of the first ones in common."""
    order = F.struct((-F.floor(F.log2("many"))).alias("less"), F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("place"), "h")
    few = rows.where("index").groupBy("sid").agg(F.slice(F.array_sort(F.collect_list(order)), 1, FEW).alias("few"))
    rows = rows.join(few, "sid", "left").withColumn("here", order)
    rows = rows.withColumn("earlier", F.expr("transform(filter(coalesce(few, array()), x -> x < here), x -> x.h)")).drop("few", "here", "many")
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    home, above = F.struct(band.alias("band"), F.lit(False).alias("visitor")), F.struct((band + 1).alias("band"), F.lit(True).alias("visitor"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("index"), F.array(home, above)).otherwise(F.array(home)))).select("*", "at.*").drop("at")
    banded = scratch.store(rows, "banded")
    return tiled(banded, ["h", "band"], "sid", "ngram", weight="n").select(*TILE_COLUMNS)


def _usable(batch: pa.RecordBatch, percent: int):
    """Whether the rows i and j of a tile are a pair to be compared in this one."""
    sid, comp = binary16(batch.column("sid")), binary16(batch.column("comp"))
    n, salt, index, visitor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "salt", "index", "visitor"))
    split = batch.column("ti").to_numpy() != batch.column("tj").to_numpy()
    values, edge = _list_values(batch.column("earlier"))
    size = np.diff(edge)
    earlier, there = np.zeros((len(n), FEW), np.uint64), np.arange(FEW) < size[:, None]
    earlier[there] = values[edge[0] : edge[-1]]

    def usable(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        smaller_i = (n[i] < n[j]) | ((n[i] == n[j]) & ((sid[i, 0] < sid[j, 0]) | ((sid[i, 0] == sid[j, 0]) & (sid[i, 1] < sid[j, 1]))))
        ok = (comp[i] != comp[j]).any(1) & ~(visitor[i] & visitor[j]) & (~split[i] | (salt[i] != salt[j]))
        ok &= np.where(smaller_i, index[i] & ~visitor[j], index[j] & ~visitor[i])
        ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        at = np.flatnonzero(ok)
        if len(at):
            a, b = i[at], j[at]
            both = (earlier[a][:, :, None] == earlier[b][:, None, :]) & there[a][:, :, None] & there[b][:, None, :]
            ok[at[both.any((1, 2))]] = False
        return ok

    return usable


def _may_link(n: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """By the bits that only one of two has, whether their overlap may suffice."""
    alone_i = np.bitwise_count(sig[i] & ~sig[j]).sum(1, dtype=np.int64)
    alone_j = np.bitwise_count(sig[j] & ~sig[i]).sum(1, dtype=np.int64)
    common = np.minimum(n[i] - alone_i, n[j] - alone_j)
    return 100 * common >= percent * (n[i] + n[j] - common)


def _promising(batch: pa.RecordBatch, group: np.ndarray, sigs: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The usable pairs of all tiles that may link. Tiles whose shortest bitmaps are of
    one length are compared together."""
    n, usable = batch.column("n").to_numpy(), _usable(batch, percent)
    words = np.array([len(x) for x in sigs])
    shortest = np.minimum.reduceat(words, np.flatnonzero(np.diff(group, prepend=-1)))[np.cumsum(np.diff(group, prepend=group[0]) > 0)]
    for w in np.unique(shortest):
        rows = np.flatnonzero(shortest == w)
        for lo, hi in _runs(group[rows], max(1, (1 << 22) // int(w))):
            part = rows[lo:hi]
            sig = np.stack([folded(sigs[i], int(w)) for i in part])
            for i, j in pairs_behind(group[part], lambda a, b, part=part: usable(part[a], part[b])):
                ok = _may_link(n[part], sig, i, j, percent)
                yield part[i[ok]], part[j[ok]]


def _runs(group: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole groups of about ``most`` rows."""
    lo = 0
    while lo < len(group):
        hi = int(np.searchsorted(group, group[min(lo + most, len(group)) - 1], "right"))
        yield lo, hi
        lo = hi


def _rows_of(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    values, edge = _list_values(batch.column(column))
    return [values[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _with_partner(percent: int, bitmaps: bool):
    """Step 2: the rows of a tile that have a partner, by the bitmaps if they are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in whole_groups(batches, TILE_KEYS):
            keep = np.zeros(len(group), bool)
            pairs = _promising(batch, group, _rows_of(batch, "sig"), percent) if bitmaps else pairs_behind(group, _usable(batch, percent))
            for i, j in pairs:
                keep[i] = keep[j] = True
            yield batch.select(TILE_COLUMNS).filter(pa.array(keep))

    return run


def _tile_roots(percent: int):
    """Step 3: (sid, root) of the rows of a tile that link with an earlier row of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in whole_groups(batches, TILE_KEYS):
            grams, roots = _rows_of(batch, "grams"), Roots(len(group))
            for i, j in _promising(batch, group, [signature(x) for x in grams], percent):
                for a, b in zip(i.tolist(), j.tolist()):
                    if roots.find(a) != roots.find(b) and _links(grams[a], grams[b], percent):
                        roots.link(a, b)
            rows, root = roots.moved()
            sid = batch.column("sid")
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(rows)), sid.take(pa.array(root))], names=["a", "b"])
        give_back()

    return run


def _tile_links(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    def dealt(x: DataFrame) -> DataFrame:
        return x.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "sid")

    some = scratch.store(dealt(_tile_rows(rows, percent, scratch)).mapInArrow(_with_partner(percent, False), TILE_SCHEMA), "some-partner")
    near = scratch.store(dealt(some.join(sets.select("sid", "sig"), "sid")).mapInArrow(_with_partner(percent, True), TILE_SCHEMA), "near-partner")
    scratch.drop(some)
    return scratch.store(dealt(near.join(sets.select("sid", "grams"), "sid")).mapInArrow(_tile_roots(percent), "a binary, b binary"), "tile-links")


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of docs. doc_id may be of any
    type that has an order; component_id is of the same."""
    docs, scratch = docs.select("doc_id", "text"), Scratch(docs.sparkSession)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    space = cell_space(n_bytes // 6)
    survey = scratch.store(_survey(docs, space), "survey")
    sketch = repeat_filter(survey.where("block is not null"), space, CELLS_PER_REPEAT, MOST_BITS, 1, LEVELS)
    each = scratch.store(survey.where("block is null").select("doc_id", "n", "sid"), "each")
    scratch.drop(survey)

    sets = scratch.store(_keyed(docs, sketch, percent).dropDuplicates(["sid"]), "sets")
    keys = scratch.store(sets.select(F.posexplode("keys").alias("pos", "h"), "sid", "n", "n_index").select("h", "sid", "n", (F.col("pos") < F.col("n_index")).alias("index")), "keys")
    links = _star_links(_pivots(keys, scratch), sets, percent, scratch)
    found = components(links, "sets")
    rows = _mixed_members(keys, found, scratch)
    more = _tile_links(rows, sets, percent, scratch)
    if not more.isEmpty():
        found = components(links.unionByName(more), "sets-all")

    some = each.where("n > 0")
    named = some.groupBy("sid").agg(F.min("doc_id").alias("rep"))
    named = named.join(found, named.sid == found.id, "left").select("sid", "rep", F.coalesce("component", "sid").alias("comp"))
    named = scratch.store(named, "named")
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_set = scratch.store(named.join(smallest, "comp").select(F.col("sid").alias("set"), "component_id"), "of-set")
    scratch.drop(sets, keys, rows, links, more, named)
    linked = some.join(of_set, some.sid == of_set.set).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def oracle_sql(percent: int = PERCENT, words: int = WORDS) -> str:
    """DuckDB SQL of the rows, for unique doc_ids."""
    seq = " || ' ' || ".join(f"w[i{'' if k == 0 else f' + {k}'}]" for k in range(words))
    return f"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, {seq} as g from (select doc_id, w, unnest(range(1, len(w) - {words - 2})) as i from d where len(w) >= {words})
  union all select doc_id, 'all ' || array_to_string(w, ' ') from d where len(w) between 1 and {words - 1}),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= {percent} * (x.n + y.n - c)),
r as (select doc_id, doc_id as root from d union select r.doc_id, l.b from r join l on l.a = r.root)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.root) as component_id
from d left join n using (doc_id) join r on r.doc_id = d.doc_id group by d.doc_id"""
