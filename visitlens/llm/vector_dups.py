"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c are 2 - 2c apart in squared distance. A fixed random rotation
spreads that over all coordinates; these are cut into blocks, and if the whole distance
is within the budget, at least one block's is within its proportional share.

Each block is range-joined by itself. Its first coordinates make a grid of cells twice as
wide as the block's radius. A vector belongs to one cell and visits those smaller cells
which its radius reaches, so each pair within the radius meets in one cell. What travels
there is the row's id and the block's coordinates as 16-bit numbers, with the budget
widened by their rounding. The join says which rows have a candidate in which cell; rows
without one, nearly all where copies are few, go no further. Vectors are then fetched
for the rows that are left, and the candidates of a cell are verified by the exact cosine
in double precision. A pair found in several blocks counts in the first only, so the
union is free of repeats and link counts add up. Exact copies, told by a 96-bit hash, are
one vector with a weight; cells with many rows are cut into tiles, and the larger the
largest label, the more coordinates the grid has. A cell sends each member's link count
and its root within the cell, never the pairs.

Defined results: null, empty or zero vectors, those with null or non-finite components,
and rows without label or vec_id link with nothing and are counted by none; very large
and very small components are scaled by powers of two, so lengths neither overflow nor
vanish; vectors of unlike length are not compared; repeated rows are copies of each
other; a repeated vec_id is a row for itself; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, components
from .tiles import tiled, whole_groups

COSINE = 0.98
BLOCKS = 8
GRID_DIMS, MOST_GRID_DIMS, GRID_ROWS = 2, 6, 50_000
SLACK = 1e-9  # of distances, for rounding
UNIT = 32767  # a coordinate of 1 as a 16-bit number
PAIRS = 1 << 14  # candidates verified at a time
KEYS = ["label", "place", "cell", "ti", "tj"]  # a tile; place is 256 * dimensions + block


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dims, min(blocks, dims) + 1).astype(int)


def budgets(dims: int, blocks: int, cosine: float) -> np.ndarray:
    """Each block's share of the squared distance."""
    return (2 - 2 * cosine) * np.diff(block_edges(dims, blocks)) / dims + SLACK


def grid_dims(rows: int, cosine: float, blocks: int) -> int:
    """How many coordinates the grid has: one more each time that the rows of the largest
    label are four times as many, as long as a cell's number fits 62 bits."""
    g = min(MOST_GRID_DIMS, GRID_DIMS + int(np.log2(max(rows / GRID_ROWS, 1)) / 2))
    steps = 0.5 / np.sqrt((2 - 2 * cosine) / (2 * blocks) + SLACK) + 4
    while g > 1 and steps >= 2.0 ** (62 // g - 1):
        g -= 1
    return g


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, each scaled by a power of two, which is exact."""
    raw = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(cosine: float, blocks: int, grid: int) -> Callable:
    """Rows (rep, label, vector) -> a row for each cell a vector is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            for dims in np.unique(lengths):
                some = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                turned = _unit(_vectors(some.column("vector"))) @ rotation(dims)
                edges, radii = block_edges(dims, blocks), np.sqrt(budgets(dims, blocks, cosine)) + SLACK
                for k, radius in enumerate(radii):
                    part = turned[:, edges[k] : edges[k + 1]]
                    yield _cells_of_block(some, part, int(dims) * 256 + k, radius, min(grid, part.shape[1]), 62 // grid)

    return run


def _cells_of_block(rows: pa.RecordBatch, part: np.ndarray, place: int, radius: float, g: int, bits: int) -> pa.RecordBatch:
    at = part[:, :g]
    home = np.floor(at / (2 * radius)).astype(np.int64)
    near = np.where(at - home * 2 * radius < radius, -1, 1)  # the one side that is in reach
    used, cells, visits = [], [], []
    for mask in range(1 << g):
        step = home + near * np.array([(mask >> j) & 1 for j in range(g)])
        ahead = np.zeros(len(at), np.int64)  # sign of (step - home), first difference counts
        for j in range(g):
            ahead = np.where(ahead == 0, np.sign(step[:, j] - home[:, j]), ahead)
        use = np.flatnonzero(ahead <= 0) if mask else np.arange(len(at))
        used.append(use)
        cells.append(((step[use] + (1 << (bits - 1))) << (bits * np.arange(g))).sum(1))
        visits.append(np.full(len(use), bool(mask)))
    used = np.concatenate(used)
    code = np.ascontiguousarray(np.rint(part * UNIT).astype("<i2"))
    width = code.shape[1] * 2
    codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(code), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
    took = pa.array(used)
    return pa.RecordBatch.from_arrays(
        [
            rows.column("rep").take(took), rows.column("label").take(took), pa.array(np.full(len(used), place, np.int64)),
            pa.array(np.concatenate(cells)), pa.array(np.concatenate(visits)), codes.take(took),
        ],
        names=["rep", "label", "place", "cell", "visitor", "code"],
    )


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles of sorted batches, one by one; those of one row, or without a row at home
    in the cell, have no pairs."""
    for batch, group in whole_groups(batches, KEYS):
        away = batch.column("visitor").to_numpy(zero_copy_only=False)
        many, homes = np.bincount(group), np.bincount(group, ~away)
        start = np.cumsum(many) - many
        for i in np.flatnonzero((many > 1) & (homes > 0)):
            yield batch.slice(start[i], many[i])


def _near(part: np.ndarray, limit: float, n_home: int, salt: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within ``limit``, homes first: two at home once, one at home and a
    visitor once; if salts are given, only pairs of unlike ones."""
    square = (part * part).sum(1)
    for lo in range(0, n_home, 256):
        hi = min(lo + 256, n_home)
        a, b = np.nonzero(square[lo:hi, None] + square - 2 * part[lo:hi] @ part.T <= limit)
        a = a + lo
        ok = b > a
        if salt is not None:
            ok &= salt[a] != salt[b]
        yield a[ok], b[ok]


def _homes_first(tile: pa.RecordBatch) -> tuple[pa.RecordBatch, int, np.ndarray | None]:
    away = tile.column("visitor").to_numpy(zero_copy_only=False)
    tile = tile.take(pa.array(np.argsort(away, kind="stable")))
    one = tile.column("ti")[0].as_py() == tile.column("tj")[0].as_py()
    return tile, int((~away).sum()), None if one else tile.column("salt").to_numpy()


def _with_candidates(cosine: float, blocks: int) -> Callable:
    """Sorted rows of tiles -> those with a candidate in the tile, without coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            tile, n_home, salt = _homes_first(tile)
            dims, block = divmod(tile.column("place")[0].as_py(), 256)
            part = np.frombuffer(b"".join(tile.column("code").to_pylist()), "<i2").reshape(len(tile), -1) / UNIT
            limit = (np.sqrt(budgets(dims, blocks, cosine)[block]) + np.sqrt(part.shape[1]) / UNIT) ** 2 + SLACK
            live = np.zeros(len(tile), bool)
            for a, b in _near(part, limit, n_home, salt):
                live[a] = live[b] = True
            if live.any():
                yield tile.drop_columns(["code"]).take(pa.array(np.flatnonzero(live)))

    return run


def _verify(cosine: float, blocks: int) -> Callable:
    """Sorted rows of tiles with weights and vectors -> (rep, links, root) of each member
    of a tile that has a link there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            tile, n_home, salt = _homes_first(tile)
            dims, block = divmod(tile.column("place")[0].as_py(), 256)
            raw, rep, weight = _vectors(tile.column("vector")), tile.column("rep").to_numpy(), tile.column("weight").to_numpy()
            norm, turned = np.sqrt((raw * raw).sum(1)), _unit(raw) @ rotation(dims)
            edges, budget = block_edges(dims, blocks), budgets(dims, blocks, cosine)
            left, right = [], []
            for a, b in _near(turned[:, edges[block] : edges[block + 1]], budget[block] + SLACK, n_home, salt):
                for at in range(0, len(a), PAIRS):
                    i, j = a[at : at + PAIRS], b[at : at + PAIRS]
                    exact = (raw[i] * raw[j]).sum(1) / (norm[i] * norm[j]) >= cosine
                    i, j = i[exact], j[exact]
                    if len(i):
                        gaps = np.add.reduceat((turned[i] - turned[j]) ** 2, edges[:-1], axis=1)
                        first = (gaps <= budget).argmax(1) == block
                        left.append(i[first])
                        right.append(j[first])
            if sum(map(len, left)):
                left, right = np.concatenate(left), np.concatenate(right)
                links = np.bincount(left, weight[right], len(rep)) + np.bincount(right, weight[left], len(rep))
                has = np.flatnonzero(links)
                columns = (rep[has], links[has].astype(np.int64), _roots(rep, left, right)[has])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "links", "root"])

    return run


def _roots(rep: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least rep along links; minima spread until they stand still."""
    root = rep.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, left, before[right])
        np.minimum.at(root, right, root[left])
        if (root == before).all():
            return root


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def link_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid: int | None = None) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    good = F.coalesce(
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    single = isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), FloatType)
    rows = vectors.select(
        "vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label")
    ).withColumn("ok", good & F.col("vec_id").isNotNull())
    rows = rows.withColumn("k1", F.xxhash64("label", "embedding")).withColumn("k2", F.hash("embedding", "label"))
    scratch, valid = Scratch(vectors.sparkSession), rows.where("ok")
    light = scratch.store(valid.select("vec_id", "k1", "k2"), "vector-ids")
    reps = valid.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("vector")
    )
    reps = scratch.store(reps, "vectors")
    if grid is None:
        grid = grid_dims(reps.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0, cosine, blocks)
    cells = reps.select("rep", "label", "vector").mapInArrow(_cells(cosine, blocks, grid), "rep long, label long, place long, cell long, visitor boolean, code binary")
    cells = scratch.store(cells, "vector-cells")
    tiles = _by_tile(tiled(cells, KEYS[:3], "rep", "vector").drop("salts"))
    near = scratch.store(tiles.mapInArrow(_with_candidates(cosine, blocks), tiles.drop("code").schema), "vector-candidates")
    scratch.drop(cells)
    fetched = near.join(reps.select(F.col("rep").alias("of"), "weight", "vector"), F.col("rep") == F.col("of")).drop("of")
    found = scratch.store(_by_tile(fetched).mapInArrow(_verify(cosine, blocks), "rep long, links long, root long"), "vector-links")
    scratch.drop(near)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    named = (
        reps.select("k1", "k2", F.col("rep").alias("own"), "weight")
        .join(counts, F.col("own") == counts.rep, "left")
        .join(of_rep, F.col("own") == of_rep.id, "left")
        .select(
            F.col("k1").alias("j1"), F.col("k2").alias("j2"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "own").alias("component_id"),
        )
    )
    named = scratch.store(named, "vector-groups")
    scratch.drop(reps, found)
    linked = light.join(named, (light.k1 == named.j1) & (light.k2 == named.j2)).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle_sql(cosine: float = COSINE) -> str:
    return f"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
      where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {cosine}),
n as (select a, count(*)::bigint as n from l group by a),
r as (select vec_id, vec_id as root from embeddings union select r.vec_id, l.b from r join l on l.a = r.root),
c as (select vec_id, min(root) as component_id from r group by vec_id)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c using (vec_id) left join n on n.a = e.vec_id"""
