"""A quality classifier: gradient-boosted trees on histograms of document statistics.

The statistics are taken of every whole text by vectorised passes over Arrow batches.
The trees are fitted on a bounded sample of labelled rows (``sample_rows``, picked by a
hash of doc_id): features are binned by quantiles, and each level of a tree is found
from per-bin sums of gradients. A fitted model is a handful of flat arrays; all trees
are walked for a batch at once, level by level, with numpy.

Defined results: a null text counts as empty, and is scored like any other; unlabelled
rows are scored but not learnt from; documents labelled more than once, or of which one
doc_id occurs repeatedly, count once for each; with no labelled row, or one label only,
the score is that label's share (0.5 if there is none); an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_chunks, window_hashes, word_hashes, word_spans

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digit", "symbol", "bang", "bar", "stop_mark", "comma", "other_punctuation",
    "beyond_ascii", "newline", "distinct_words", "same_as_before", "words_per_line", "words_with_symbol", "distinct_pairs", "long_words", "capital_words",
)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&<>{}[]^~=+@\\_"]] = True
_OTHER = np.zeros(256, bool)
_OTHER[[ord(c) for c in "\"'()-/:;?`"]] = True


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each text."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text."""
    out = [np.zeros((0, len(FEATURES)))]
    for _, _, b, off in text_chunks(texts):
        n = len(off) - 1
        size = np.diff(off).astype(float)
        starts, ends, first = word_spans(b, off)
        words = np.diff(first).astype(float)
        doc = np.repeat(np.arange(n), np.diff(first))
        h = word_hashes(lower_ascii(b), starts, ends)
        per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)

        def share(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(b) + 1)
            np.cumsum(mask, out=total[1:])
            return (total[off[1:]] - total[off[:-1]]) / per_byte

        def words_where(mask: np.ndarray) -> np.ndarray:
            return np.bincount(doc[mask], minlength=n) / per_word

        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        pair, pair_doc = window_hashes(h, 2), doc[:-1] if len(h) > 1 else doc[:0]
        inside = pair_doc == doc[1:] if len(h) > 1 else np.zeros(0, bool)
        symbol = np.zeros(len(b) + 1)
        np.cumsum(_SYMBOLS[b] | (b == 33) | (b == 124), out=symbol[1:])
        newline = b == 10
        lines = share(newline) * per_byte + 1
        upper = (b >= 65) & (b <= 90)
        caps = np.zeros(len(b) + 1)
        np.cumsum(upper, out=caps[1:])
        out.append(
            np.stack(
                [
                    np.log1p(size), np.log1p(words), size / per_word, share(upper), share((b >= 48) & (b <= 57)), share(_SYMBOLS[b]),
                    share(b == 33), share(b == 124), share(b == 46), share(b == 44), share(_OTHER[b]), share(b >= 128), share(newline),
                    _distinct(h, doc, n) / per_word, words_where(again), words / lines, words_where(symbol[ends] > symbol[starts]),
                    (_distinct(pair[inside], pair_doc[inside], n) + 1) / per_word, words_where(ends - starts > 20), words_where((caps[ends] - caps[starts]) > 1),
                ],
                1,
            )
        )
    return np.concatenate(out)


@dataclass
class Trees:
    """Complete binary trees of one depth. Node k of a tree has the children 2k+1 and
    2k+2; a row goes right if its feature is above the threshold. A node which is not
    split has an infinite threshold."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.leaf):
            rows, depth = np.arange(len(x))[:, None], int(np.log2(self.leaf.shape[1]))
            tree = np.arange(len(self.leaf))[None, :]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
            total += self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(1)
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 3.0, ridge: float = 2.0) -> Trees:
    """Boost ``trees`` trees for the log loss; leaves hold Newton steps."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)  # bin <= k: value <= cut k
    n_feat = x.shape[1]
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    f = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = node - first
            G, H = np.zeros((n_feat, n, bins)), np.zeros((n_feat, n, bins))
            for k in range(n_feat):
                cell = local * bins + binned[:, k]
                G[k] = np.bincount(cell, g, n * bins).reshape(n, bins)
                H[k] = np.bincount(cell, h, n * bins).reshape(n, bins)
            gl, hl = G.cumsum(2), H.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = -1
            for k in range(n_feat):
                gain[k, :, len(cuts[k]) :] = -1
            best = gain.transpose(1, 0, 2).reshape(n, -1)
            at = best.argmax(1)
            for m in np.flatnonzero(best[np.arange(n), at] > 1e-6):
                k, c = divmod(int(at[m]), bins)
                feature[t, first + m], threshold[t, first + m] = k, cuts[k][c]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        local = node - inner
        leaf[t] = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        f += leaf[t, local]
    return Trees(base, feature, threshold, leaf)


def learn(labelled: DataFrame, sample_rows: int = 20_000, **options) -> Trees:
    """(doc_id, text, quality) -> trees. The sample is the rows of the smallest hashes;
    only their statistics reach the driver."""
    labelled = labelled.where("quality is not null").select("doc_id", "text", F.col("quality").cast("double").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "quality"]
            )

    total = labelled.count()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = labelled.where(u < int(min(1.0, 1.2 * sample_rows / max(1, total) + 1e-4) * (1 << 30)))
    rows = near.mapInArrow(run, "doc_id long, x array<double>, quality double").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows]), **options)


def score(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees * 2**depth numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            s = np.concatenate([shared.value.score(x[k : k + 1000]) for k in range(0, len(x), 1000)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
