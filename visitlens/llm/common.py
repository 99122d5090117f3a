"""Shared pieces of the corpus operators: tables in the shared folder, vectorised
hashing of words in Arrow batches, repeat sketches and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
#: what a finished write has shuffled is not needed again, as the table is read instead
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---------------------------------------------------------------- shared tables

_OWN: dict[str, str] = {}  # by application: the folder of a session on a single machine

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a
    single machine (tests) may it be unset; a new temporary folder takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="visitlens-")
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back. This cuts the
    lineage: a lost executor costs only its running tasks."""
    return Scratch(df.sparkSession).store(df, name)


class Scratch:
    """Stored tables of one operator, which it deletes once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path is not None:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def row_keys(docs: DataFrame) -> DataFrame:
    """(row_key, row): a key of its own for each row, the same whenever it is read, and
    the columns of docs as a struct. Rows of files are keyed by file and place in it;
    others are stored first."""
    row = F.struct(*docs.columns).alias("row")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("row_key")
    try:
        return docs.select(place, row)
    except AnalysisException:
        return stored(docs.select(F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place")).alias("row_key"), row), "keyed-rows")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, m: int):
    """crc32 of the id as text, modulo m (held-out splits)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


def give_back() -> None:
    """At a task's end: hand memory that is free, but still the worker's, back to the
    machine, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- words of Arrow text


def text_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) of runs of whole texts of about
    ``chunk_bytes``; a longer text is a chunk of its own. Null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + chunk_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)


def word_spans(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and per text the index of its
    first word (one entry more than texts)."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~((b == 32) | ((b >= 9) & (b <= 13)))
    before = np.zeros(len(b) + 1, bool)
    before[1:] = w
    before[off] = False
    starts = np.flatnonzero(w & ~before[:-1])
    after = np.zeros(len(b) + 1, bool)
    after[:-1] = w
    after[off] = False
    ends = np.flatnonzero(w & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


_U = np.uint64
#: odd constants of the hashes, one for each seed
_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_LANE, _PLACE = 8, _U(0xD6E8FEB86659FD93)
_SHORT = 64  # bytes up to which words are hashed side by side, longer ones each for itself


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words: the scrambled sum of their scrambled lanes of eight
    bytes, each with its place. Up to eight bytes, unlike words of a length never agree."""
    n = ends - starts
    padded = np.concatenate([b, np.zeros(_LANE, np.uint8)])
    lanes = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    total = np.zeros(len(starts), _U)

    def scrambled(at: np.ndarray, left: np.ndarray, place) -> np.ndarray:
        rest = (np.clip(_LANE - left, 0, _LANE) * 8).astype(_U)
        return mix(((lanes[at] << rest) >> rest) + (place + _U(1)) * _PLACE + _SEEDS[seed])

    live = np.flatnonzero((n > 0) & (n <= _SHORT))
    k = 0
    while len(live):
        total[live] += scrambled(starts[live] + _LANE * k, n[live] - _LANE * k, np.array([k], _U))
        k += 1
        live = live[n[live] > _LANE * k]
    for i in np.flatnonzero(n > _SHORT):
        for lo in range(0, int(n[i]), CHUNK_BYTES):
            at = np.arange(lo, min(int(n[i]), lo + CHUNK_BYTES), _LANE)
            total[i] += scrambled(starts[i] + at, n[i] - at, (at // _LANE).astype(_U)).sum(dtype=_U)
    return mix(total + n.astype(_U) * _SEEDS[1 - seed])


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries, by doubling; windows over text borders are
    included and have to be left out by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, done, run, size = np.full(n, _SEEDS[seed]), 0, words, 1
    while True:
        if k & size:
            out = mix(out * _PLACE + run[done : done + n])
            done += size
        if done == k:
            return out
        run, size = mix(run[:-size] * _SEEDS[seed] + run[size:]), size * 2


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one after the other."""
    n = np.maximum(hi - lo, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    return np.arange(total) - np.repeat(first - lo, n)


# ---------------------------------------------------------------- repeat sketches


BLOCK_BITS = 20  # cells of one block of a sketch
REPEATED = (2,)
SKETCH_FILES = 4
_LOADED: dict[str, list[np.ndarray]] = {}  # the sketch that this worker read last


@dataclass(frozen=True)
class Sketch:
    """A merged count-min sketch, as files which every executor fetches once from the
    shared folder. A cell keeps the level of its count: how many of ``levels`` it has
    reached (one or two bits). The level of a value is never below that of its count.
    What the driver holds, and what tasks are sent, are file names. ``shift``: the low
    bits by which values are cut, if it was made by ``repeat_filter``."""

    bits: int
    depth: int
    levels: tuple[int, ...]
    files: tuple[str, ...]
    shift: int = 0

    def _rows(self) -> list[np.ndarray]:
        if self.files[0] not in _LOADED:
            import pyarrow.parquet as pq

            _LOADED.clear()
            width = _packed_bits(self.levels) << (BLOCK_BITS - 3)
            rows = [np.zeros(width << (self.bits - BLOCK_BITS), np.uint8) for _ in range(self.depth)]
            for name in self.files:
                for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(16):
                    for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                        r, k = divmod(block, 1 << (self.bits - BLOCK_BITS))
                        rows[r][k * width : (k + 1) * width] = np.frombuffer(packed.as_buffer(), np.uint8)
            _LOADED[self.files[0]] = rows
        return _LOADED[self.files[0]]

    def level(self, h: np.ndarray) -> np.ndarray:
        """The least level of each value's cells."""
        h = mix(h >> _U(self.shift)) if self.shift else h
        out = np.full(len(h), len(self.levels), np.uint8)
        for r, packed in enumerate(self._rows()):
            cell = sketch_cell(h, r, self.bits)
            if _packed_bits(self.levels) == 1:
                here = (packed[cell >> _U(3)] >> (cell & _U(7)).astype(np.uint8)) & np.uint8(1)
            else:
                here = (packed[cell >> _U(2)] >> ((cell & _U(3)) * _U(2)).astype(np.uint8)) & np.uint8(3)
            out = np.minimum(out, here)
        return out

    def repeated(self, h: np.ndarray) -> np.ndarray:
        return self.level(h) > 0


def _packed_bits(levels: tuple[int, ...]) -> int:
    return 1 if len(levels) == 1 else 2


def sketch_cell(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h if row == 0 else mix(h ^ _U(0x5851F42D4C957F2D))) >> _U(64 - bits)


def sketch_parts(hashes: np.ndarray, bits: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """Of one task's values: (block, payload) with the cells hit, as sorted differences,
    and the counts of those hit more than once, up to 255."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for r in range(depth):
        cell, n = np.unique(sketch_cell(hashes, r, bits), return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)
        edges = np.searchsorted(cell, np.arange(0, (1 << bits) + 1, 1 << BLOCK_BITS).astype(_U))
        for k in range(len(edges) - 1):
            part, count = cell[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]
            if len(part):
                d = np.diff(part - _U(k << BLOCK_BITS), prepend=_U(0))
                small = np.minimum(d, 255).astype(np.uint8)
                large, many = d[d >= 255].astype(np.uint32), count > 1
                head = np.array([len(d), len(large)], np.int32).tobytes()
                yield (r << (bits - BLOCK_BITS)) + k, pack(head + small.tobytes() + large.tobytes() + np.packbits(many).tobytes() + count[many].tobytes())


def _cells(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    payload = zstandard.decompress(payload)
    n, wide = (int(x) for x in np.frombuffer(payload, np.int32, 2))
    d = np.frombuffer(payload, np.uint8, n, 8).astype(np.int64)
    d[d == 255] = np.frombuffer(payload, np.uint32, wide, 8 + n)
    at = 8 + n + 4 * wide
    many = np.unpackbits(np.frombuffer(payload, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
    count = np.ones(n, np.uint32)
    count[many] = np.frombuffer(payload, np.uint8, -1, at + (n + 7) // 8)
    return np.cumsum(d), count


def merge_sketch(parts: DataFrame, bits: int, depth: int, levels: tuple[int, ...] = REPEATED) -> Sketch:
    """Merge the (block, payload) rows of all tasks, block by block, in a stream with
    the memory of one block. The blocks, 2**bits * depth cells at most, are written to a
    few files of the shared folder; nothing of them passes through the driver's memory."""
    n_blocks = depth << (bits - BLOCK_BITS)
    if not 1 <= len(levels) <= 3:
        raise ValueError("one to three levels")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def row():
            level = np.searchsorted(np.array(levels), count, "right").astype(np.uint8)
            if _packed_bits(levels) == 1:
                packed = np.packbits(level, bitorder="little")
            else:
                packed = level[0::4] | level[1::4] << 2 | level[2::4] << 4 | level[3::4] << 6
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed.tobytes()])], names=["block", "bits"])

        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now:
                    if now is not None:
                        yield row()
                    now, count = block, np.zeros(1 << BLOCK_BITS, np.uint32)
                cell, n = _cells(payload.as_py())
                count[cell] += n
        if now is not None:
            yield row()

    sc = parts.sparkSession.sparkContext
    merged = parts.select("block", "payload").repartition(min(n_blocks, 64), "block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    scratch = Scratch(parts.sparkSession)
    blocks = scratch.store(merged, "sketch-blocks")
    files = scratch.store(blocks.coalesce(SKETCH_FILES), "sketch").inputFiles()
    scratch.drop(blocks)
    for f in files:
        sc.addFile(f)
    return Sketch(bits, depth, tuple(levels), tuple(sorted(f.rsplit("/", 1)[1] for f in files)))


def sketch_bits(n_values: int, per_value: float, most: int) -> int:
    """log2 of the cells of a row: ``per_value`` cells a value, between 2**BLOCK_BITS
    and 2**most."""
    return int(min(most, max(BLOCK_BITS, np.ceil(np.log2(max(1, n_values * per_value))))))


# ---------------------------------------------------------------- repeats among any number of values


SPARE = 6  # of values that occur once, one in 2**SPARE at most shares its cell
LOCAL_BITS = BLOCK_BITS + SPARE  # log2 of the cells of a block
COUNT_BITS = 8
FLUSH = 1_500_000  # values which a task holds before it sends its counts


@dataclass(frozen=True)
class Space:
    """2**blocks blocks of 2**LOCAL_BITS cells, by the first bits of a value. It grows
    with the values, as no task ever holds more than one block, and only cells that occur."""

    blocks: int

    @property
    def shift(self) -> int:
        return 64 - LOCAL_BITS - self.blocks


def cell_space(n_values: int) -> Space:
    """Of 2**BLOCK_BITS values a block, or fewer."""
    return Space(int(min(63 - LOCAL_BITS, max(0, np.ceil(np.log2(max(1, n_values))) - BLOCK_BITS))))


def cell_parts(hashes: np.ndarray, space: Space) -> Iterator[tuple[int, bytes]]:
    """Of one task's values: (block, payload) with the cells that occur, as sorted
    differences laid out byte by byte, and the counts of those hit more than once, up to 255."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    cell, n = np.unique(hashes >> _U(space.shift), return_counts=True)
    n = np.minimum(n, 255).astype(np.uint8)
    edges = np.searchsorted(cell, np.arange(0, (1 << space.blocks) + 1, dtype=_U) << _U(LOCAL_BITS))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        part, count = cell[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]
        d, many = np.diff(part, prepend=_U(k << LOCAL_BITS)).astype("<u4"), count > 1
        width = max(1, -(-int(d.max()).bit_length() // 8))
        planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4)[:, :width].T)
        yield k, pack(np.array([len(d), width], np.int32).tobytes() + planes.tobytes() + np.packbits(many).tobytes() + count[many].tobytes())


def _local_cells(payload: bytes) -> np.ndarray:
    """A payload's cells inside their block, each with its count in the lowest bits."""
    import zstandard

    payload = zstandard.decompress(payload)
    n, width = (int(x) for x in np.frombuffer(payload, np.int32, 2))
    d = np.zeros((n, 4), np.uint8)
    d[:, :width] = np.frombuffer(payload, np.uint8, n * width, 8).reshape(width, n).T
    at = 8 + n * width
    many = np.unpackbits(np.frombuffer(payload, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
    out = np.cumsum(d.view("<u4").ravel(), dtype=_U) << _U(COUNT_BITS)
    out += _U(1)
    out[many] += np.frombuffer(payload, np.uint8, -1, at + (n + 7) // 8).astype(_U) - _U(1)
    return out


def repeat_filter(parts: DataFrame, space: Space, per_repeat: float, most_bits: int, depth: int, levels: tuple[int, ...] = REPEATED) -> Sketch:
    """Count all values of the (block, payload) rows of all tasks, block by block, in
    cells so many that hardly two values share one, and put only the cells that occur
    more than once, with their counts, into a sketch: ``per_repeat`` cells a row for each,
    2**most_bits at most. So what fills the sketch is repeats, however many values occur
    once; what is sent to count them is about two bytes a value."""
    n_blocks = 1 << space.blocks

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held))
            cell = x >> _U(COUNT_BITS)
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            count = np.add.reduceat(x & _U((1 << COUNT_BITS) - 1), first)
            again = count > 1
            cells = cell[first[again]] + _U(now << LOCAL_BITS)
            times = np.minimum(count[again], levels[-1]).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([len(cells)], pa.int64()), pa.array([cells.tobytes()]), pa.array([times.tobytes()])], names=["n", "cells", "times"])

        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now:
                    if now is not None:
                        yield row()
                    now, held = block, []
                held.append(_local_cells(payload.as_py()))
        if now is not None:
            yield row()
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            out = list(sketch_parts(np.concatenate(held), bits, depth))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int32()), pa.array([p[1] for p in out], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for cells, times in zip(batch.column(1), batch.column(2)):
                cells = mix(np.frombuffer(cells.as_buffer(), _U))
                held.append(np.repeat(cells, np.frombuffer(times.as_buffer(), np.uint8)))
                n += len(held[-1])
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        give_back()

    scratch = Scratch(parts.sparkSession)
    dealt = parts.select("block", "payload").repartition(min(n_blocks, max(64, n_blocks // 4)), "block").sortWithinPartitions("block")
    repeated = scratch.store(dealt.mapInArrow(merge, "n long, cells binary, times binary"), "repeated-cells")
    bits = sketch_bits(repeated.agg(F.sum("n")).first()[0] or 0, per_repeat, most_bits)
    sketch = merge_sketch(repeated.select("n", "cells", "times").mapInArrow(count, "block int, payload binary"), bits, depth, levels)
    scratch.drop(repeated)
    return replace(sketch, shift=space.shift)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b) -> (id, component): the smallest id reachable. Labels spread over
    the edges and then along themselves, so that the rounds grow with the logarithm
    of the longest path. Each round is a stored table; minima are combined before
    the shuffle, and the joins are of two stored tables, which lets Spark split a
    hot vertex."""
    scratch = Scratch(edges.sparkSession)
    ab, ba = edges.select("a", "b").where("a <> b"), edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")
    both = scratch.store(ab.unionByName(ba), f"{name}-edges")
    labels = scratch.store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("id"), "l"), f"{name}-labels")
    last = labels
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("l").alias("m"))
        step = scratch.store(labels.join(near, labels.id == near.a).select("id", "l", F.least("l", "m").alias("n")), f"{name}-step")
        up = step.select(F.col("id").alias("parent"), F.col("n").alias("root"))
        new = scratch.store(step.join(up, step.n == up.parent).select("id", "l", F.least("n", "root").alias("n")), f"{name}-jump")
        scratch.drop(last, step)
        if new.where("l <> n").isEmpty():
            scratch.drop(both)
            return new.select("id", F.col("n").alias("component"))
        labels, last = new.select("id", F.col("n").alias("l")), new
