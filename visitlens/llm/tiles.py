"""Groups compared inside tiles of bounded size.

Rows of a group are dealt by a hash into S salts, S growing with the group; tile (i, j)
holds the rows of salts i and j. Every pair of the group meets in one tile, and no task
holds more than about two salts' rows, however large the group is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

TILE_ROWS = 1500
TILE_WEIGHT = 2_000_000


def salts_of(rows: DataFrame, keys: list[str], name: str, tile_rows: int = TILE_ROWS, weight: str | None = None, tile_weight: int = TILE_WEIGHT) -> DataFrame:
    """``keys`` and ``salts`` of the groups that have more rows, or a larger sum of
    ``weight``, than one salt should have."""
    load = F.count("*") / F.lit(tile_rows)
    if weight is not None:
        load = F.greatest(load, F.sum(weight) / F.lit(tile_weight))
    return stored(rows.groupBy(*keys).agg(F.ceil(load).cast("int").alias("salts")).where("salts > 1"), f"{name}-large")


def tiled(rows: DataFrame, keys: list[str], member: str, name: str, tile_rows: int = TILE_ROWS, weight: str | None = None) -> DataFrame:
    """``rows`` with salt, ti and tj added, each row once per tile that it is in."""
    large = salts_of(rows, keys, name, tile_rows, weight)
    rows = rows.join(large, keys, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(member), F.col("salts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    return rows.withColumn("other", other).withColumns({"ti": F.least("salt", "other"), "tj": F.greatest("salt", "other")}).drop("other", "salts")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of batches sorted by keys: batches of whole groups, with a number of the group for
    each row. What is held is a batch and the group that it ends in."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        group = _numbered(rows, keys)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield rows.slice(0, cut), group[:cut]
        rest = rows.slice(cut)
    if rest is not None:
        yield rest, np.zeros(rest.num_rows, np.int64)


def _numbered(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    for k in keys:
        column = rows.column(k)
        v = binary16(column) if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False).reshape(-1, 1)
        new[1:] |= (v[1:] != v[:-1]).any(1)
    return np.cumsum(new)


def binary16(column: pa.Array) -> np.ndarray:
    """Ids of 16 bytes as two columns of big-endian integers, which sort as the ids do."""
    if not len(column):
        return np.zeros((0, 2), ">u8")
    return np.frombuffer(column.buffers()[2], ">u8", 2 * len(column), 16 * column.offset).reshape(-1, 2)


def pairs_behind(group: np.ndarray, usable: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by group, all usable pairs of a group: rows against those a fixed
    distance behind them, distance by distance."""
    live, distance = np.arange(len(group)), 1
    while True:
        live = live[live + distance < len(group)]
        live = live[group[live] == group[live + distance]]
        if not len(live):
            return
        for lo in range(0, len(live), 1 << 16):
            i = live[lo : lo + (1 << 16)]
            ok = usable(i, i + distance)
            if ok.any():
                yield i[ok], i[ok] + distance
        distance += 1


class Roots:
    """Smallest row of each set of linked rows, within a batch."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that are not their own root, and their roots."""
        rows = np.flatnonzero(self.up != np.arange(len(self.up)))
        return rows, np.array([self.find(int(i)) for i in rows], np.int64)
