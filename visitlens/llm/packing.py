"""Packing of tokenised documents into fixed windows by non-negative least squares.

Every text is tokenised once, inside tasks, and cut into whole windows and one
remainder. Only the histogram of piece lengths (at most ``window`` numbers) reaches the
driver. There the combinations of up to three lengths that fill a window exactly are
enumerated, their repeat counts are solved by non-negative least squares against the
histogram and rounded down, and what is left is packed greedily, largest length first,
always taking the longest piece that still fits. The plan is a table of runs: "of the
pieces of this length, ranks lo to hi go to that slot of sequences base, base+1, ...".
Its size depends on ``window``, never on the data, so it is broadcast. Ranks come from
counts by (length, salt) and row numbers inside a salt, so that no length, however
common, meets in one task.

Defined results: a null or empty text is the single end id; repeated rows are packed as
often as they occur; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, stored, text_chunks

#: bytes without a change between blank and other text up to which the fast coder is used
LONGEST_RUN = 1000

_ENCODERS: dict[str, "_Encoder"] = {}


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: visible Latin-1
    characters stand for themselves, the others follow after 255 in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Encoder:
    """A worker's tokenizer. Where a vocabulary's merges are in the order of its ids, a
    second library's byte-pair coder gives the same ids in two thirds of the time, and
    takes the texts for which that holds: those without an added token's literal, without
    letters from U+0240 on, where the libraries' character tables may differ, and without
    very long runs, on which it takes more than linear time. Others are the tokenizer's."""

    def __init__(self, name: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file(name))
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(tokenizer_file(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        self.fast = None
        if model["type"] == "BPE" and merged == sorted(merged):
            byte = {letter: b for b, letter in _byte_letters().items()}
            ranks = {bytes(byte[x] for x in word): i for word, i in model["vocab"].items() if word not in self.added}
            self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, null counting as empty."""
        for lo, hi, data, off in text_chunks(texts):
            slow = _slow(data, off) if self.fast else np.ones(hi - lo, bool)
            for text, by_tokenizer in zip(texts.slice(lo, hi - lo).to_pylist(), slow.tolist()):
                if not text:
                    yield b""
                elif by_tokenizer or any(x in text for x in self.added):
                    yield self.whole(text)
                else:
                    yield self.fast(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _slow(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold a letter from U+0240 on, or may hold more than LONGEST_RUN bytes of
    blanks or of other text on end: then some aligned half of that length has no change."""
    out = np.zeros(len(off) - 1, bool)
    half, blank = LONGEST_RUN // 2, data <= 32
    change = np.ones(-(-len(data) // half) * half, bool)
    change[: len(data) - 1] = blank[1:] != blank[:-1]
    still = np.flatnonzero(~change.reshape(-1, half).any(1)) * half
    at = np.concatenate([np.flatnonzero(data >= 0xC9), still])
    out[np.searchsorted(off, at, "right") - 1] = True
    past = np.minimum(still + half - 1, len(data) - 1)
    for i, j in zip(np.searchsorted(off, still, "right") - 1, np.searchsorted(off, past, "right") - 1):
        out[i : j + 1] = True
    return out


def encoder(name: str = "byte_bpe_50k.json") -> _Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = _Encoder(name)
    return _ENCODERS[name]


def pieces(docs: DataFrame, window: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1) -> DataFrame:
    """(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens): whole windows
    and a remainder of each document."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, data in zip(batch.column(0).to_pylist(), encode.texts(batch.column(1))):
                data += end
                n = len(data) // 4
                for s in range(0, n, window):
                    part = data[4 * s : 4 * (s + window)]
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), n))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(have: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the lengths at hand that fill the window exactly: an
    array of three columns, 0 for no piece."""
    there = np.zeros(window + 1, bool)
    there[have] = True
    pairs = have[(have <= window - have) & there[window - have]]
    rows = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    for a in have[have * 3 <= window]:
        b = have[(have >= a) & (a + 2 * have <= window)]
        b = b[there[window - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(rows)


def solve_counts(strategies: np.ndarray, hist: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used near the histogram in least
    squares, by multiplicative updates, which keep x non-negative."""
    if not len(strategies):
        return np.zeros(0)
    h = hist.astype(float)
    h[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(strategies[:, k], x, len(h)) for k in range(strategies.shape[1]))
        out[0] = 0
        return out

    def back(v: np.ndarray) -> np.ndarray:
        return v[strategies].sum(1)

    target = back(h)
    x = np.minimum.reduce([np.where(strategies[:, k] > 0, h[strategies[:, k]], np.inf) for k in range(strategies.shape[1])])
    x *= h.sum() / max(used(x).sum(), 1e-9)
    for _ in range(rounds):
        x *= target / np.maximum(back(used(x)), 1e-9)
    return x


def plan_packs(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often) of all sequences; each piece of the histogram is used once."""
    left = hist.astype(np.int64).copy()
    packs: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        packs.append(((window,), int(left[window])))
        left[window] = 0
    strategies = combinations(np.flatnonzero(left), window)
    x = solve_counts(strategies, left)
    for k in np.argsort(-x, kind="stable"):
        n = int(x[k] + 1e-9)
        if n < 1:
            break
        lengths, many = np.unique(strategies[k][strategies[k] > 0], return_counts=True)
        n = min(n, *(int(left[a]) // int(m) for a, m in zip(lengths, many)))
        if n > 0:
            left[lengths] -= many * n
            packs.append((tuple(int(v) for v in strategies[k] if v), n))
    while left.any():
        room, pack, taken = window, [], np.zeros_like(left)
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] - taken[: room + 1] > 0)
            if not len(fits):
                break
            a = int(fits[-1])
            pack.append(a)
            taken[a] += 1
            room -= a
        used = np.flatnonzero(taken)
        n = int((left[used] // taken[used]).min())
        left -= taken * n
        packs.append((tuple(pack), n))
    return packs


def plan_runs(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset): where the pieces of a length of rank
    lo to hi - 1 go."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for lengths, n in packs:
        at = 0
        for a in lengths:
            lo = used.get(a, 0)
            used[a] = lo + n
            runs.append((a, lo, lo + n, sequence, at))
            at += a
        sequence += n
    return runs


def pack(docs: DataFrame, window: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, salt_rows: int = 200_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A length with more than ``salt_rows`` pieces is dealt over as many salts as
    keep each near that number."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, window, tokenizer, end_id).withColumn("fp", F.xxhash64("doc_id", "start", "ids_crc32")), "pieces")
    of_length = {a: n for a, n in cut.groupBy("length").count().collect()}  # at most `window` rows
    many = {0: 1} | {a: -(-n // salt_rows) for a, n in of_length.items() if n > salt_rows}
    salts = F.create_map(*[F.lit(x).cast("long") for pair in many.items() for x in pair])
    cut = cut.withColumn("salt", F.pmod("fp", F.coalesce(salts[F.col("length")], F.lit(1))).cast("int")).drop("fp")
    counts = cut.groupBy("length", "salt").count()
    hist = np.zeros(window + 1, np.int64)
    for a, n in of_length.items():
        hist[a] = n
    runs = spark.createDataFrame(plan_runs(plan_packs(hist, window)), "length long, lo long, hi long, base long, offset long")
    before = counts.select(
        "length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).alias("before")
    )
    in_salt = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    # `before` has a row for each salt_rows pieces and one a length; `runs` is bounded by the plan
    ranked = cut.join(before, ["length", "salt"]).withColumn("rank", in_salt - 1 + F.coalesce("before", F.lit(0)))
    return ranked.join(F.broadcast(runs), (ranked.length == runs.length) & (ranked["rank"] >= runs.lo) & (ranked["rank"] < runs.hi)).select(
        "doc_id", "start", ranked.length, "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )
