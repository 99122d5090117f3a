"""Scoring of texts by a hierarchical Pitman-Yor language model.

Two levels: a root restaurant over all words, and one restaurant per context, which all
share the root as their parent. The contexts are all observed previous words and the
beginning of a text. Customers are the training tokens, counted over all of them. The
state is the number of tables of each word in each restaurant. A sweep of the Gibbs
sampler takes all customers of each word out and seats them again given all others, by a
draw of the number of their tables from its distribution, the generalised Stirling number
times the masses of the tables opened. It needs no sizes, so none are kept, and costs the
same for any count of more than TABLE. The tables are the root's customers, and the root
is swept alike. Totals of a restaurant and the root's probabilities are those at the
sweep's beginning, corrected by the word's own changes.
Each level has one discount and one strength, drawn in each sweep from their conditional
distribution on a grid, which needs only how often each pair of customers and tables,
restaurant size and number of tables occurs. After ``burn`` sweeps, the predictive probabilities of the
sweeps are averaged. Draws are hashes of word, context, sweep and customer, so a task
that is run again seats alike.
Before the sweeps each word has one table. ``seat`` and ``gibbs``, which move customers one
by one or in blocks and keep sizes, are no part of the model: tests hold the draws against them.

Most words and most pairs of a context and a word occur once. A single customer always
has one table, so these need no seating, and they are not stored: words and pairs are
counted over the training texts and the texts to be scored, and those with a count of
one are left out, most of them before the shuffle by a count-min sketch that never
misses a repeat. A pair that is not in the table is then the training text's own, with
one customer, or is new if the text is not learnt from; likewise a word. Restaurants'
totals follow from the counts of words.

Seatings are rows (context, word, count, tables); totals by context and by word are tables
of their own. Those of the ``heavy`` most frequent words, and the ``pairs`` most frequent
pairs of these, are broadcast (fixed bounds): caches only, all others are joined, so no
join has a hot key. The tokens that need a join are looked up in ``slices`` by hash of
their pair, each summed up by text and deleted before the next.

Defined results: a null or empty text is the end token alone; repeated rows are scored
alike, each; with no training token every word has the one unknown symbol's probability;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, Sketch, give_back, lower_ascii, merge_sketch, mix, ranges, sketch_bits, sketch_parts, text_chunks, word_hashes, word_spans

HEAVY = 1 << 17
PAIRS = 1 << 21
SWEEPS, BURN = 4, 1
#: where discounts and strengths are drawn
DISCOUNTS, STRENGTHS = tuple(np.round(np.linspace(0.05, 0.95, 19), 2)), tuple(np.round(np.geomspace(0.1, 100.0, 16), 4))
END = np.uint64(0x9D2C5680EFC60000)  # the end token
BEGIN = np.uint64(0x6A09E667F3BCC908)  # the context at a text's beginning
FLUSH = 1_500_000
CELLS = 1 << 20  # places at tables that are laid out at a time
SLICES = 6  # of the pairs to look up, one after the other, so that only one of them is shuffled and stored at a time
WHOLE = 64  # customers of a dish that ``gibbs`` takes out together
TABLE = 1024  # customers up to which Stirling numbers are tabled, 8 MB a discount
NODES, POINTS = 33, 16  # of an integral, and of a function that is interpolated
WIDTHS = np.unique(np.round(2 ** (np.arange(2, 21) / 2)).astype(np.int64))  # cells that dishes of like size are laid out in
CELLS_PER_PAIR, MOST_BITS = 2.0, 28
_U = np.uint64


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: first row, word hashes with an end after each text, and where
    each text begins."""
    for lo, _, b, off in text_chunks(texts):
        b = lower_ascii(b)
        starts, ends, first = word_spans(b, off)
        n = len(off) - 1
        out = np.full(len(starts) + n, END, _U)
        out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = word_hashes(b, starts, ends)
        yield lo, out, first + np.arange(n + 1)


@dataclass
class Lexicon:
    """The heavy words and the beginning, sorted by hash."""

    heavy: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index in ``heavy`` or -1."""
        return _find(self.heavy, h)


def contexts_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context of each token."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[first[:-1]] = BEGIN
    return out


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted keys or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def word_counts(texts: DataFrame, sketch: Sketch) -> DataFrame:
    """(w, c): how often each token is in the texts; those that surely occur only once in
    all texts are summed up under null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, single = [], 0, 0

        def flush() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(held) if held else np.zeros(0, _U), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([*w.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(c, single))], names=["w", "c"])

        for batch in batches:
            for _, h, _ in tokens(batch.column(0)):
                again = sketch.repeated(_word_key(h))
                held.append(h[again])
                single += len(h) - len(held[-1])
                n += len(h)
                if n >= FLUSH:
                    yield flush()
                    held, n, single = [], 0, 0
        yield flush()
        give_back()

    return texts.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def repeat_sketch(rows: DataFrame) -> Sketch:
    """Which words, and pairs of a context and a word, surely occur only once in all texts."""
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(n_bytes // 6, CELLS_PER_PAIR, MOST_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            parts = list(sketch_parts(np.concatenate(held), bits, 1)) if held else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for _, h, first in tokens(batch.column(0)):
                held += [_pair_hash(contexts_of(h, first), h), _word_key(h)]
                n += 2 * len(h)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        yield flush()
        give_back()

    return merge_sketch(rows.select("text").mapInArrow(count, "block int, payload binary"), bits, 1)


def _pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u) + w)


def _word_key(w: np.ndarray) -> np.ndarray:
    return mix(w ^ BEGIN)


def repeats(sketch: Sketch, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens and their contexts: whether the context, the word and the pair may occur
    more than once."""
    again_w = sketch.repeated(_word_key(w))
    again_u = np.append(True, again_w[:-1]) | (u == BEGIN)
    both = np.flatnonzero(again_u & again_w)
    pair = np.zeros(len(w), bool)
    pair[both] = sketch.repeated(_pair_hash(u[both], w[both]))
    return again_u, again_w, pair


def pair_counts(rows: DataFrame, lexicon: Lexicon, sketch: Sketch) -> DataFrame:
    """(text, learns) -> (u, w, hot_u, hot_w, c): how often each word follows each context
    where ``learns``, of the pairs that occur more than once in all texts."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            w, u, c = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))
            w, u, c, every = _summed(w, u, c)
            hot = (shared.value.find(u) >= 0) + 2 * (shared.value.find(w) >= 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(w.view(np.int64)), pa.array(hot, pa.int32()), pa.array(c, pa.int64()), pa.array(every, pa.int64())], names=["u", "w", "hot", "c", "every"]
            )

        for batch in batches:
            learns = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, h, first in tokens(batch.column(0)):
                u, own = contexts_of(h, first), np.repeat(learns[lo : lo + len(first) - 1], np.diff(first))
                again = repeats(sketch, u, h)[2]
                held.append((h[again], u[again], own[again]))
                n += len(h)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        yield flush()
        give_back()

    flat = rows.select("text", "learns").mapInArrow(count, "u long, w long, hot int, c long, every long")
    summed = flat.groupBy("u", "w").agg(F.max("hot").alias("hot"), F.sum("c").alias("c"), F.sum("every").alias("every")).where("every > 1")
    return _flags(summed.drop("every"))


def _flags(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"hot_u": F.col("hot").bitwiseAND(1) > 0, "hot_w": F.col("hot").bitwiseAND(2) > 0}).drop("hot")


def _summed(w: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs with the sum of c and the number of rows."""
    order = np.lexsort((u, w))
    w, u, c = w[order], u[order], c[order]
    if not len(w):
        return w, u, c, c
    start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])]))
    return w[start], u[start], np.add.reduceat(c, start), np.diff(np.append(start, len(w)))


# ---------------------------------------------------------------- restaurants


def _looked_up(rows: DataFrame, key: str, light: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``light``: a join for the keys which are not hot;
    hot ones get nulls, which tasks fill from the broadcast."""
    new = [f for f in light.schema if f.name != key]
    near = rows.where(f"hot_{key}").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    away = rows.where(f"not hot_{key}").join(light.where(f"not hot_{key}") if f"hot_{key}" in light.columns else light, key, "left")
    return near.unionByName(away.select(*near.columns))


@dataclass
class Hot:
    """Of the lexicon's heavy words, sorted as there, a column of numbers by name."""

    lexicon: Lexicon
    columns: dict[str, np.ndarray]

    def fill(self, name: str, keys: np.ndarray, values: pa.Array, default: float = 1.0) -> np.ndarray:
        """Joined values, those of heavy keys from the broadcast, ``default`` without any."""
        out = values.to_numpy(zero_copy_only=False).astype(float)
        at = self.lexicon.find(keys)
        out = np.where(at >= 0, self.columns[name][at], out)
        return np.where(np.isnan(out), default, out)


def _hot(lexicon: Lexicon, *tables: tuple[DataFrame, str]) -> Hot:
    """The rows of the heavy keys, at most as many as these."""
    columns = {}
    for rows, key in tables:
        got = rows.toArrow()
        at = lexicon.find(got[key].to_numpy().view(_U))
        for name in got.column_names:
            if name != key:
                columns[name] = np.full(len(lexicon.heavy), np.nan)
                columns[name][at] = got[name].to_numpy()
    return Hot(lexicon, columns)


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (mix(key + _U(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(11)).astype(np.float64) / float(1 << 53)


def seat(c: np.ndarray, base: np.ndarray, discount: np.ndarray, open_mass: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables after c customers of one dish sat down, each at a new table with the odds
    of open_mass * base (strength and the discounts of all the restaurant's tables,
    times the parent's probability) against the seats taken less discounts."""
    tables = np.minimum(c, 1).astype(np.float64)
    live, j, step = np.flatnonzero(c > 1), 1, 0
    while len(live):
        block = np.minimum(max(1, j // 10) if j >= 64 else 1, c[live] - j)
        new = open_mass[live] * base[live]
        share = new / (np.maximum(j - discount[live] * tables[live], 1e-9) + new)
        tables[live] += np.floor(block * share + _uniform(key[live], step))
        j += max(1, j // 10) if j >= 64 else 1
        step += 1
        live = live[c[live] > j]
    return tables


def first_sizes(c: np.ndarray, tables: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """A first state of c customers at so many tables: (sizes, offsets), large tables
    first, falling as those of a Pitman-Yor restaurant do."""
    tables = np.minimum(tables, c).astype(np.int64)
    off = np.append(0, np.cumsum(tables))
    place = np.arange(off[-1]) - np.repeat(off[:-1], tables)
    share = (place + 1.0) ** (-1.0 / discount)
    left = np.repeat(c - tables, tables)
    size = 1 + np.floor(left * share / np.repeat(_sums(share, off), tables)).astype(np.int64)
    seated = tables > 0
    size[off[:-1][seated]] += (c - _sums(size, off))[seated]
    return size, off


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(x))[off])


@lru_cache(4)
def stirling(discount: float) -> np.ndarray:
    """Entry (c, t): the weights of all ways to seat c <= WHOLE customers at t tables, summed."""
    out = np.zeros((WHOLE + 1, WHOLE + 1))
    out[0, 0] = 1.0
    for c in range(WHOLE):
        out[c + 1, 1:] = out[c, :-1] + np.maximum(c - discount * np.arange(1, WHOLE + 1), 0) * out[c, 1:]
    return out


@lru_cache(4)
def log_stirling_table(discount: float) -> np.ndarray:
    """Logarithms of ``stirling`` up to TABLE customers."""
    out = np.full((TABLE + 1, TABLE + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(TABLE):
            stay = np.log(np.maximum(c - discount * np.arange(1, c + 2), 0))
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay + out[c, 1 : c + 2])
    return out


def _slopes(eta: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """At x = 1 / (1 + exp(-eta)), with D = x d/dx: x / (1 - x), log x, and D and D D of
    the logarithm of phi(x) / x (see ``log_way``)."""
    p, log_y = np.exp(eta), -np.logaddexp(0, eta)
    r = d * np.exp(eta + d * log_y) / -np.expm1(d * log_y)
    small, first = p < 1e-5, (1 - d) * p / 2
    return p, eta + log_y, np.where(small, first, r - 1), np.where(small, first, r * (1 + (1 - d) * p - r))


def log_way(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithm of S(c, t) * gamma(t) / gamma(c), S being the generalised Stirling numbers:
    the coefficient of x**(c - t) in (phi(x) / x)**(t - 1) * (1 - x)**(d - 1), where phi(x) =
    (1 - (1 - x)**d) / d. Cauchy's integral over s = log x, by the trapezoidal rule, on a
    hyperbola through the saddle point that opens around the cut; on the whole circle where
    c - t is a few. Ten digits."""
    c, t = np.asarray(c, float), np.asarray(t, float)
    left, eta = np.maximum(c - t, 0.5), np.zeros(len(c))
    eta = np.log(left / ((t - 1) * (1 - d) / 2 + 1 - d))
    for _ in range(60):
        p, _, q1, q2 = _slopes(eta, d)
        f = (t - 1) * q1 + (1 - d) * p
        step = np.clip(np.log(left / f) * f * (1 + p) / ((t - 1) * q2 + (1 - d) * p * (1 + p)), -20, 20)
        eta = eta + step
        if np.abs(step).max(initial=0) < 1e-9:
            break
    p, s0, q1, q2 = _slopes(eta, d)
    q3 = np.where(p < 1e-5, q2, q2 * (1 + (1 - d) * p - q1 - 1) + (q1 + 1) * ((1 - d) * p * (1 + p) - q2))
    second = (t - 1) * q2 + (1 - d) * p * (1 + p)
    third = (t - 1) * q3 + (1 - d) * p * (1 + p) * (1 + 2 * p)
    width, b = 1 / np.sqrt(second), 1.2 * 3 * second / np.maximum(third, 1e-300)
    ring = 12 * width >= np.pi
    reach = np.arcsinh(8.5 * width / b)
    reach = np.where(s0 > -1, np.maximum(reach, np.arccosh(1 + 32 / (left * 1.2 * b))), reach)
    reach = np.minimum(reach, np.arcsinh(np.pi / b))
    v = np.linspace(0, 1, NODES)
    sinh, cosh = np.sinh(v * reach[:, None]), np.cosh(v * reach[:, None])
    s = s0[:, None] + b[:, None] * (1j * sinh + 1.2 * (cosh - 1))
    ds = b[:, None] * (cosh - 1.2j * sinh) * (reach[:, None] / (NODES - 1))
    s[ring], ds[ring] = s0[ring, None] + 1j * np.pi * v, np.pi / (NODES - 1)
    ds[:, 0] /= 2
    ds[ring, -1] /= 2
    x = np.exp(s)
    u, low = np.empty_like(x), s0 < -0.7  # log(1 - x)
    u[low] = 0.5 * np.log1p(x[low].real * (x[low].real - 2) + x[low].imag ** 2) + 1j * np.arctan2(-x[low].imag, 1 - x[low].real)
    u[~low] = np.log(-np.expm1(s[~low]))
    g = (t[:, None] - 1) * np.log(-np.expm1(d * u) / (d * x)) + (d - 1) * u - (c - t)[:, None] * s
    top = g[:, 0].real
    return np.where(c > t, top + np.log(np.maximum((np.exp(g - top[:, None]) * ds).real.sum(1) / np.pi, 1e-300)), 0.0)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers, 1 <= t <= c."""
    out, few = np.empty(len(c)), c <= TABLE
    out[few] = log_stirling_table(float(d))[c[few], t[few]]
    many = np.flatnonzero(~few)
    for lo in range(0, len(many), CELLS // NODES):
        rows = many[lo : lo + CELLS // NODES]
        out[rows] = log_way(c[rows], t[rows], d) + _lgamma(c[rows]) - _lgamma(t[rows])
    return out


@lru_cache(32)
def _through(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among ``width`` cells, and the matrix that takes values there, of a smooth
    function, to all cells."""
    if width <= 2 * POINTS:
        return np.arange(width), np.eye(width)
    at = np.round((width - 1) * (1 - np.cos(np.pi * np.arange(POINTS) / (POINTS - 1))) / 2).astype(np.int64)
    cells = np.polynomial.chebyshev.chebvander(2 * np.arange(width) / (width - 1) - 1, POINTS - 1)
    return at, np.linalg.solve(cells[at].T, cells.T)


def _chosen(log_odds: np.ndarray, key: np.ndarray) -> np.ndarray:
    odds = np.cumsum(np.exp(log_odds - log_odds.max(1, keepdims=True)), 1)
    return np.minimum((odds <= (_uniform(key, 1) * odds[:, -1])[:, None]).sum(1), odds.shape[1] - 1)


def draw_tables(c: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, key: np.ndarray) -> np.ndarray:
    """All customers of each dish are taken out and seated again together: the number of
    their tables, drawn given those of the restaurant's other dishes, with odds S(c, t)
    times the masses of the tables opened. Up to TABLE customers all t are weighed; of more,
    a window around the mode beyond which less than 1e-12 lies."""
    tables = np.minimum(c, 1).astype(np.int64)
    kind = np.searchsorted(WIDTHS, c)
    for m in np.unique(kind[(c > 1) & (c <= TABLE)]).tolist():
        every, m = np.flatnonzero((kind == m) & (c > 1)), int(WIDTHS[m])
        step, ways = max(1, CELLS // m), log_stirling_table(float(discount))[:, 1 : m + 1]
        for lo in range(0, len(every), step):
            rows = every[lo : lo + step]
            odds = np.zeros((len(rows), m))
            np.cumsum(np.log((strength + discount * (others[rows, None] + np.arange(1, m))) * base[rows, None]), 1, out=odds[:, 1:])
            tables[rows] = _chosen(odds + ways[c[rows]], key[rows]) + 1
    many = np.flatnonzero(c > TABLE)
    if not len(many):
        return tables
    d, n = discount, c[many].astype(float)
    rest, p_new = others[many] + strength / d, np.minimum(base[many], 1 - 1e-9)

    def mode(eta: np.ndarray) -> np.ndarray:
        share = p_new * -np.expm1(-d * np.logaddexp(0, eta))
        return np.maximum(rest * share / (1 - share), 1.0)

    low, high = np.full(len(many), -60.0), np.log(n / (1 - d)) + 1
    for _ in range(50):
        eta = (low + high) / 2
        p, _, q1, _ = _slopes(eta, d)
        t = mode(eta)
        over = t + (t - 1) * q1 + (1 - d) * p > n
        low, high = np.where(over, low, eta), np.where(over, eta, high)
    t, (p, _, q1, q2) = mode(low), _slopes(low, d)
    bend = (q1 + 1) ** 2 / ((t - 1) * q2 + (1 - d) * p * (1 + p)) + 1 / t - 1 / (rest + t)
    wide = 18 / np.sqrt(np.maximum(bend, 4 / n)) + 24
    wide = 1 << np.ceil(np.log2(wide)).astype(np.int64)
    first = np.maximum(np.minimum(np.round(t).astype(np.int64) - wide // 2, c[many] - wide + 1), 1)
    for w in np.unique(wide).tolist():
        every, (at, through) = np.flatnonzero(wide == w), _through(w)
        step = max(1, CELLS // max(w, NODES * len(at)))
        for lo in range(0, len(every), step):
            i = every[lo : lo + step]
            asked, ns = (first[i, None] + at).astype(float), np.repeat(n[i], len(at))
            # smooth, so that it may be interpolated: times the factorial of c - t
            odds = (log_way(ns, asked.ravel(), d) + _lgamma(ns - asked.ravel() + 1)).reshape(len(i), -1) @ through
            t = first[i, None] + np.arange(w - 1.0)
            opened = np.log((rest[i, None] + t) / t * (n[i, None] - t)) + np.log(d * base[many[i]])[:, None]
            odds[:, 1:] += np.cumsum(opened, 1)
            tables[many[i]] = first[i] + _chosen(odds, key[many[i]])
    return tables


def partition(c: np.ndarray, tables: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """How c <= WHOLE customers share so many tables, drawn: one row of sizes, zeros behind."""
    most, ways = int(c.max(initial=0)), stirling(discount)
    opens, left = np.zeros((len(c), most), bool), tables.astype(np.int64).copy()
    for i in range(most, 0, -1):  # from the last customer back: whether they opened a table
        r = np.flatnonzero(c >= i)
        opens[r, i - 1] = _uniform(key[r], 2 * i) * ways[i, left[r]] < ways[i - 1, left[r] - 1]
        left -= opens[:, i - 1]
    out, used = np.zeros((len(c), max(1, int(tables.max(initial=0))))), np.zeros(len(c), np.int64)
    for i in range(most):
        r = np.flatnonzero(opens[:, i])
        out[r, used[r]] = 1
        used[r] += 1
        r = np.flatnonzero(~opens[:, i] & (c > i))
        sums = np.cumsum(np.where(out[r] > 0, out[r] - discount, 0), 1)
        out[r, np.minimum((sums <= (_uniform(key[r], 2 * i + 1) * sums[:, -1])[:, None]).sum(1), used[r] - 1)] += 1
    return out


def gibbs(size: np.ndarray, off: np.ndarray, c: np.ndarray, moves: int, base: np.ndarray, others: np.ndarray, discount: float, strength: float, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sweep over all customers of each dish: they are taken out and seated again, all
    given the rest. Up to WHOLE are taken out at once; of more, blocks of up to ``moves``
    (at most half of WHOLE) leave and return together, until as many have moved as there
    are. First those are added or taken away that bring the customers to ``c``. ``others``
    counts the tables of the restaurant's other dishes, ``base`` is the parent's
    probability of the dish. Returns sizes and offsets."""
    tables, have, moves = np.diff(off), _sums(size, off), min(moves, WHOLE // 2)
    kind = np.where(c <= WHOLE, -1, np.ceil(np.log2(np.maximum(tables + 2, 2))).astype(np.int64))
    at, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(kind):
        every = np.flatnonzero(kind == k)
        every = every[np.argsort(-c[every], kind="stable")]  # those that move longest first
        step = max(1, CELLS >> (int(k) if k >= 0 else 6))
        for lo in range(0, len(every), step):
            rows = every[lo : lo + step]
            if k < 0:
                s = partition(c[rows], draw_tables(c[rows], base[rows], others[rows], discount, strength, key[rows]), discount, ~key[rows])
            else:
                s = np.zeros((len(rows), 1 << int(k)))
                s[np.repeat(np.arange(len(rows)), tables[rows]), ranges(np.zeros(len(rows), np.int64), tables[rows])] = size[ranges(off[rows], off[rows + 1])]
                s[have[rows] == 0, 0] = 1
                s = _sweep(s, c[rows], moves, base[rows], others[rows], discount, strength, key[rows])
            i, j = np.nonzero(s)
            at.append(rows[i])
            sizes.append(s[i, j].astype(np.int64))
    at, sizes = np.concatenate(at), np.concatenate(sizes)
    return sizes[np.argsort(at, kind="stable")], np.append(0, np.cumsum(np.bincount(at, minlength=len(c))))


def _sweep(s: np.ndarray, want: np.ndarray, moves: int, base: np.ndarray, others: np.ndarray, d: float, strength: float, key: np.ndarray) -> np.ndarray:
    """Sizes ``s`` (zeros where there is no table) after a sweep of blocks; returns them
    wider where tables needed room."""
    draw, ways = 0, stirling(d)[: moves + 1, : moves + 1]
    choose = np.array([[math.comb(e, j) for j in range(moves + 1)] for e in range(moves + 1)], float)
    nth = np.arange(moves)

    def uniforms(rows: np.ndarray, n: int) -> np.ndarray:
        nonlocal draw
        draw += 1
        return _uniform(mix(key[rows] + _U(draw))[:, None] + nth[:n].astype(_U) * _U(0x9E3779B97F4A7C15), 1)

    def leave(x: np.ndarray, rows: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Up to r unlike customers of each row of x, of all alike; returns how many."""
        sums = np.cumsum(x, 1)
        picked = np.where(nth < r[:, None], np.floor(uniforms(rows, moves) * sums[:, -1:]), np.inf)
        picked.sort(1)
        new = np.isfinite(picked)
        new[:, 1:] &= picked[:, 1:] != picked[:, :-1]
        i, _ = np.nonzero(new)
        start = np.append(0, np.cumsum(sums[:, -1]))[:-1]
        flat = np.searchsorted((sums + start[:, None]).ravel(), picked[new] + start[i], "right")
        x -= np.bincount(flat, minlength=x.size).reshape(x.shape)
        return new.sum(1)

    def enter(x: np.ndarray, rows: np.ndarray, e: np.ndarray) -> np.ndarray:
        """e customers of each row of x sit down, given all that sit there. Of the ways to
        do so, j of them sit at new tables with weight choose * rising(e - j) * opened."""
        t = (x > 0).sum(1)
        weight = np.where(x > 0, x - d, 0)
        sums = np.cumsum(weight, 1)
        w = sums[:, -1:]
        mass = np.ones((len(x), moves + 1))
        np.cumprod((strength + d * ((others[rows] + t)[:, None] + nth)) * base[rows, None], 1, out=mass[:, 1:])
        rising = np.ones((len(x), moves + 1))
        np.cumprod(1 + nth / w, 1, out=rising[:, 1:])
        stay = e[:, None] - np.arange(moves + 1)
        odds = choose[e] * np.take_along_axis(rising, np.maximum(stay, 0), 1) * (mass @ ways.T) * (1 / w) ** np.arange(moves + 1)
        odds = np.cumsum(odds, 1)
        u = uniforms(rows, 2)
        j = np.minimum((odds <= u[:, :1] * odds[:, -1:]).sum(1), e)
        # the others copy one that came before, or choose a table that stood
        v = uniforms(rows, moves) * (w + nth)
        first = np.where(v < w, nth, np.minimum(np.floor(v - w), np.maximum(nth - 1, 0))).astype(np.int64)
        for _ in range(max(1, (moves - 1).bit_length())):
            first = np.take_along_axis(first, first, 1)
        start = np.append(0.0, np.cumsum(w[:, 0]))[:-1]
        flat = np.searchsorted((sums + start[:, None]).ravel(), (uniforms(rows, moves) * w + start[:, None]).ravel(), "right").reshape(len(x), moves)
        flat = np.take_along_axis(np.minimum(flat, x.size - 1), first, 1)[nth < (e - j)[:, None]]
        x += np.bincount(flat, minlength=x.size).reshape(x.shape)
        i = np.flatnonzero(j)
        if len(i):
            odds = np.cumsum(ways[j[i]] * mass[i], 1)
            opened = np.minimum((odds <= u[i, 1:] * odds[:, -1:]).sum(1), j[i])
            z = partition(j[i], opened, d, mix(key[rows[i]] + _U(draw)) + _U(1))
            if (t[i] + opened).max() > x.shape[1]:
                x = np.pad(x, ((0, 0), (0, max(moves, x.shape[1]))))
            free = np.argsort(x[i] > 0, 1, kind="stable")[:, : z.shape[1]]
            at, k = np.nonzero(z)
            x[i[at], free[at, k]] = z[at, k]
        return x

    def put(rows: np.ndarray | slice, x: np.ndarray) -> None:
        nonlocal s
        if x.shape[1] > s.shape[1]:
            s = np.pad(s, ((0, 0), (0, x.shape[1] - s.shape[1])))
        s[rows] = x

    while True:
        n = s.sum(1)
        more, less = np.flatnonzero(n < want), np.flatnonzero(n > want)
        if not len(more) and not len(less):
            break
        if len(less):
            x = s[less]
            leave(x, less, np.minimum(n[less] - want[less], moves).astype(np.int64))
            put(less, x)
        if len(more):
            put(more, enter(s[more], more, np.minimum(want[more] - n[more], moves).astype(np.int64)))
    left = np.ceil(want / (want * -np.expm1(moves * np.log1p(-1 / want)))).astype(np.int64)  # blocks, less those drawn twice
    place, done = np.arange(len(want)), 0
    while True:
        live = int(np.searchsorted(-left, -done, "left"))
        if not live:
            return s
        x, rows = s[:live].copy(), place[:live]
        put(slice(0, live), enter(x, rows, leave(x, rows, np.full(live, moves))))
        done += 1


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers (Stirling's series from 8 on)."""
    x = np.asarray(x, float)
    y = x + 8
    low = np.log(x)
    for i in range(1, 8):
        low = low + np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


Histogram = tuple[np.ndarray, np.ndarray]  # values and how often each occurs


def draw_level(
    sizes: Histogram, tables: Histogram, customers: Histogram, discount: float, strength: float, seed: int, discounts: tuple = DISCOUNTS, strengths: tuple = STRENGTHS,
    ways: np.ndarray | None = None,
) -> tuple[float, float]:
    """Discount and strength of a level, each drawn given the other and all seatings:
    ``sizes`` of tables or, where only their numbers are kept, the summed logarithms of the
    ``ways`` to share them, of each of the discounts."""
    (s, ns), (t, nt), (c, nc) = sizes, tables, customers
    rng = np.random.default_rng(seed)

    def log_odds(d: float, a: float) -> float:
        opened = ((t - 1) * np.log(d) + _lgamma(a / d + t) - _lgamma(a / d + 1)) @ nt
        return opened - (_lgamma(a + c) - _lgamma(a + 1)) @ nc + (_lgamma(s - d) - _lgamma(1 - d)) @ ns + (ways[discounts.index(d)] if ways is not None else 0.0)

    def drawn(values: tuple, odds: list[float]) -> float:
        p = np.exp(np.array(odds) - max(odds))
        return float(values[min(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum())), len(values) - 1)])

    discount = drawn(discounts, [log_odds(d, strength) for d in discounts])
    return discount, drawn(strengths, [log_odds(discount, a) for a in strengths])


def _key(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(_U)


def _histogram(rows: DataFrame, value, more: dict[int, float]) -> Histogram:
    """How often each value occurs. Values are parts of the number of tokens, so there are
    at most as many unlike ones as the square root of twice the tokens."""
    got = {int(v): float(n) for v, n in rows.groupBy(value.cast("long").alias("v")).count().where("v > 0").toArrow().to_pandas().itertuples(index=False)}
    for v, n in more.items():
        got[v] = got.get(v, 0.0) + n
    return np.array(list(got), float), np.array(list(got.values()), float)


def _ways(rows: DataFrame, c: str, t: str, discounts: tuple) -> np.ndarray:
    """The summed logarithms of the ways to seat each row's customers at its tables, of each
    discount. Unlike pairs of customers and tables are weighed once, those of more than
    TABLE customers in tasks."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c_, t_, n = (x.to_numpy() for x in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(discounts)), pa.int32()), pa.array([float(log_stirling(c_, t_, d) @ n) for d in discounts])], names=["k", "ways"])
        give_back()

    alike = rows.where(f"{c} > 1").groupBy(F.col(c).alias("c"), F.col(t).alias("t")).count()
    few = alike.where(F.col("c") <= TABLE).toArrow()  # under TABLE**2 / 2 rows, of numbers only
    c_, t_, n = (few[x].to_numpy() for x in ("c", "t", "count"))
    out = np.array([log_stirling(c_, t_, d) @ n for d in discounts], float)
    many = alike.where(F.col("c") > TABLE).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    for k, x in many.mapInArrow(weigh, "k int, ways double").groupBy("k").agg(F.sum("ways")).collect():  # one row a discount
        out[k] += x
    return out


@dataclass
class Level:
    discount: float
    strength: float


@dataclass
class Model:
    """The tables after the last sweep: ``pairs`` (u, w, hot_u, hot_w, c, own), own being
    the mean share of its own tables in the kept sweeps, where c > 1; ``contexts`` (u,
    hot_u, n, back0, ...); ``words`` (w, hot_w, cw, root0, ...), roots already divided by
    the number of kept sweeps. Of these sweeps: the levels of the contexts, the roots of
    a word with one customer, and of the unknown word."""

    pairs: DataFrame
    contexts: DataFrame
    words: DataFrame
    levels: list[Level]
    single: list[float]
    unseen: list[float]
    n_tokens: int
    vocabulary: int
    stored: tuple[DataFrame, ...]


def train(
    pairs: DataFrame, counts: DataFrame, lexicon: Lexicon, scratch: Scratch, sweeps: int = SWEEPS, burn: int = BURN,
    discounts: tuple = DISCOUNTS, strengths: tuple = STRENGTHS,
) -> Model:
    """Sweeps over the stored tables of ``pair_counts`` and ``word_counts``. Of each, the
    driver receives totals, histograms and the numbers of heavy words."""
    spark = pairs.sparkSession
    heavy = F.broadcast(spark.createDataFrame(pa.table({"x": pa.array(lexicon.heavy.view(np.int64))})).withColumn("hot", F.lit(True)))  # `heavy` rows
    end, begin = (F.lit(int(x.view(np.int64))) for x in (END, BEGIN))
    alone = counts.where("w is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]  # words that occur once
    counts = counts.where("w is not null")

    def totals(rows: DataFrame, key: str, n: str) -> DataFrame:
        """Beside the count: pairs of one customer, and all pairs."""
        many = pairs.where("c > 1").groupBy(key).agg(F.sum("c").alias("in_many"), F.count("*").alias("pairs"))
        one = F.col(n) - F.coalesce("in_many", F.lit(0))
        rows = rows.join(many, key, "left").join(heavy, F.col(key) == F.col("x"), "left")
        return rows.select(key, F.coalesce("hot", F.lit(False)).alias(f"hot_{key}"), n, one.alias("one"), (one + F.coalesce("pairs", F.lit(0))).alias("t"))

    contexts = scratch.store(totals(counts.select(F.when(F.col("w") == end, begin).otherwise(F.col("w")).alias("u"), F.col("c").alias("n")), "u", "n"), "contexts")
    words = scratch.store(totals(counts, "w", "c").select("w", "hot_w", "c", "one", F.col("t").alias("customers"), F.lit(1).cast("long").alias("tables")), "words")
    stored_words = words
    n, v, total = (x or 0 for x in words.agg(F.sum("c"), F.count("*"), F.sum("customers")).first())
    n, v, total, total_tables = n + alone, v + alone, total + alone, v + alone
    customers = _histogram(contexts, F.col("n"), {1: alone} if alone else {})
    leaf, top = Level(float(np.median(discounts)), float(strengths[len(strengths) // 2])), Level(float(np.median(discounts)), float(strengths[len(strengths) // 2]))
    many, levels, single, unseen = sweeps - burn, [], [], []
    seats = pairs.where("c > 1").select("u", "w", "hot_u", "hot_w", "c", F.lit(0.0).alias("own"), F.lit(1).cast("long").alias("tables"))
    stored_seats = None

    def below() -> float:
        return (top.strength + top.discount * total_tables) / (v + 1)

    for k in range(1, sweeps + 1):
        base = words.select("w", "hot_w", ((F.col("customers") - top.discount * F.col("tables") + below()) / F.lit(top.strength + total)).alias("base"))
        hot = _hot(lexicon, (contexts.where("hot_u").select("u", F.col("n").cast("double").alias("n"), F.col("t").cast("double").alias("t")), "u"), (base.where("hot_w").drop("hot_w"), "w"))
        shared = spark.sparkContext.broadcast(hot)

        def sit(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared, d: float = leaf.discount, a: float = leaf.strength) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, w, c = _key(batch, "u"), _key(batch, "w"), batch.column("c").to_numpy()
                n_, t = (shared.value.fill(x, u, batch.column(x)) for x in ("n", "t"))
                p, seed = shared.value.fill("base", w, batch.column("base")), mix(w ^ mix(u + _U(1000 * k)))
                now = batch.column("tables").to_numpy()
                others = np.maximum(t - now, 0)  # at first each dish has counted as one table
                now = draw_tables(c, p, others, d, a, seed)
                own = batch.column("own").to_numpy() + ((c - d * now) / (a + n_) / many if k > burn else 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own), pa.array(now)], names=batch.schema.names[:7])
            give_back()

        found = _looked_up(_looked_up(seats, "u", contexts.where("not hot_u").select("u", F.col("n").cast("double").alias("n"), F.col("t").cast("double").alias("t"))), "w", base.where("not hot_w").drop("hot_w"))
        found = found.select("u", "w", "hot_u", "hot_w", "c", "own", "tables", "n", "t", "base")
        now = scratch.store(found.mapInArrow(sit, seats.schema), "seats")
        scratch.drop(stored_seats)
        seats = stored_seats = now
        opened = F.sum("tables").alias("more")
        total_of = (F.col("one") + F.coalesce("more", F.lit(0))).alias("t")
        kept = [c for c in contexts.columns if c.startswith("back")]
        back = [((leaf.strength + leaf.discount * total_of) / (leaf.strength + F.col("n"))).alias(f"back{k - burn - 1}")] if k > burn else []
        now = scratch.store(contexts.join(seats.groupBy("u").agg(opened), "u", "left").select("u", "hot_u", "n", "one", total_of, *kept, *back), "contexts")
        scratch.drop(contexts)
        contexts = now

        def root(batches: Iterator[pa.RecordBatch], k: int = k, d: float = top.discount, a: float = top.strength, in_all: float = float(total_tables), p: float = 1.0 / (v + 1)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w, c, before = _key(batch, "w"), batch.column("customers").to_numpy(), batch.column("tables").to_numpy()
                now = draw_tables(c, np.full(len(w), p), in_all - before, d, a, mix(w ^ _U(76 + k)))
                columns = {"tables": pa.array(now)}
                yield pa.RecordBatch.from_arrays([columns.get(x, batch.column(x)) for x in batch.schema.names], names=batch.schema.names)
            give_back()

        kept = [c for c in words.columns if c.startswith("root")]
        now = words.join(seats.groupBy("w").agg(opened), "w", "left").select("w", "hot_w", "c", "one", total_of.alias("customers"), "tables", *kept)
        now = scratch.store(now.mapInArrow(root, now.schema), "words")
        scratch.drop(stored_words)
        stored_words = words = now
        total, total_tables = (int(x or 0) + alone for x in words.agg(F.sum("customers"), F.sum("tables")).first())
        if k > burn:
            of_word = (F.col("customers") - top.discount * F.col("tables") + below()) / F.lit((top.strength + total) * many)
            words = words.withColumn(f"root{k - burn - 1}", of_word)
            levels.append(leaf)
            single.append((1 - top.discount + below()) / (top.strength + total) / many)
            unseen.append(below() / (top.strength + total) / many)
        if k < sweeps and n:
            one, none = np.ones(1), (np.zeros(0), np.zeros(0))
            leaf = Level(*draw_level(none, _histogram(contexts, F.col("t"), {1: alone}), customers, leaf.discount, leaf.strength, 2 * k, discounts, strengths, _ways(seats, "c", "tables", discounts)))
            top = Level(*draw_level(none, (one * total_tables, one), (one * total, one), top.discount, top.strength, 2 * k + 1, discounts, strengths, _ways(words, "customers", "tables", discounts)))
    whole = pairs.where("c < 2").withColumn("own", F.lit(None).cast("double")).unionByName(seats.drop("tables"))
    return Model(
        whole, contexts.select("u", "hot_u", F.col("n").cast("double").alias("n"), *[f"back{i}" for i in range(many)]),
        words.select("w", "hot_w", F.col("c").cast("double").alias("cw"), *[f"root{i}" for i in range(many)]), levels, single, unseen, n, v,
        (stored_seats, contexts, stored_words),
    )


# ---------------------------------------------------------------- scoring


@dataclass
class Cache:
    """Numbers of heavy words, of words that occur once, and the pairs of heavy words: key
    (context's index * words + word's index), sorted, and log-probability; ``complete`` if
    no observed pair of heavy words is missing."""

    hot: Hot
    key: np.ndarray
    logp: np.ndarray
    complete: bool
    levels: list[Level]
    single: list[float]
    unseen: list[float]

    def new_pair(self, n: np.ndarray, back: list[np.ndarray], root: list[np.ndarray], learns: np.ndarray) -> np.ndarray:
        """Log-probability where the pair has the text's own customer alone, or none."""
        p = np.where(learns & ~np.isnan(n), _single(np.nan_to_num(n, nan=1.0), self.levels), 0.0)
        for b, r in zip(back, root):
            p = p + b * r
        return np.log10(np.minimum(np.maximum(p, 1e-300), 1.0))

    def context(self, n: np.ndarray, backs: list[np.ndarray], once: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The same with the numbers of contexts that occur once, and of unknown ones."""
        n = np.where(once, np.where(learns, 1.0, np.nan), n)
        own = [(x.strength + x.discount) / (x.strength + 1) for x in self.levels]
        return n, [np.where(np.isnan(n), 1.0, np.where(once, o, np.nan_to_num(b, nan=1.0))) for b, o in zip(backs, own)]

    def roots(self, roots: list[np.ndarray], once: np.ndarray, learns: np.ndarray) -> list[np.ndarray]:
        return [np.where(once & learns, s, np.where(once | np.isnan(r), x, r)) for r, s, x in zip(roots, self.single, self.unseen)]

    def find(self, h: np.ndarray, u: np.ndarray, learns: np.ndarray, sketch: Sketch) -> Found:
        columns, size = self.hot.columns, len(self.hot.lexicon.heavy)
        again_u, again_w, pair = repeats(sketch, u, h)
        iw, iu = self.hot.lexicon.find(h), self.hot.lexicon.find(u)
        both = (iw >= 0) & (iu >= 0)
        at = np.where(both, _find(self.key, iu * size + iw), -1)
        near = ((iw >= 0) | ~again_w) & ((iu >= 0) | ~again_u)
        logp = np.where(at >= 0, self.logp[at] if len(self.logp) else 0.0, 0.0)
        rest = np.flatnonzero(near & (at < 0) & (~pair | (both if self.complete else False)))

        def of(name: str, i: np.ndarray) -> np.ndarray:
            return np.where(i[rest] >= 0, columns[name][i[rest]], np.nan)

        many = range(len(self.levels))
        n, back = self.context(of("n", iu), [of(f"back{i}", iu) for i in many], ~again_u[rest], learns[rest])
        logp[rest] = self.new_pair(n, back, self.roots([of(f"root{i}", iw) for i in many], ~again_w[rest], learns[rest]), learns[rest])
        hit = at >= 0
        hit[rest] = True
        count = np.where(iw >= 0, np.nan_to_num(columns["cw"])[iw], np.where(~again_w & learns, 1.0, 0.0))
        return Found(hit, logp, (iw >= 0) | ~again_w, count, (iu >= 0) | ~again_u, pair)


@dataclass
class Found:
    """Of each token: whether its log-probability is known here, and that; whether its
    word's numbers are, and its count; whether its context's are; whether the pair may be
    in the table."""

    hit: np.ndarray
    logp: np.ndarray
    near_w: np.ndarray
    count: np.ndarray
    near_u: np.ndarray
    pair: np.ndarray


def _single(n: np.ndarray, levels: list[Level]) -> np.ndarray:
    """The share of a pair's own table if it has one customer."""
    return sum((1 - x.discount) / (x.strength + n) for x in levels) / max(len(levels), 1)


def score(
    docs: DataFrame, training: DataFrame | str, heavy: int = HEAVY, sweeps: int = SWEEPS, burn: int = BURN, pairs: int = PAIRS,
    discounts: tuple = DISCOUNTS, strengths: tuple = STRENGTHS, slices: int = SLICES,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score, one row per row of
    docs; ``training`` has the texts to learn from, or is the name of the boolean column
    of docs that says which rows are learnt from."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    if isinstance(training, str):
        docs = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("learns"))
        every, training = docs.select("text", "learns"), docs.where("learns")
    else:
        docs = docs.select("doc_id", "text", F.lit(False).alias("learns"))
        every = training.select("text", F.lit(True).alias("learns")).unionByName(docs.select("text", "learns"))
    sketch = repeat_sketch(every)
    by_word = scratch.store(word_counts(training, sketch), "word-counts")
    top = by_word.where("w is not null").orderBy(F.desc("c"), "w").select("w").limit(heavy).toArrow()["w"].to_numpy()  # `heavy` rows
    lexicon = Lexicon(np.unique(np.append(top.astype(np.int64).view(_U), BEGIN)))
    counts = scratch.store(pair_counts(every, lexicon, sketch), "pair-counts")
    model = train(counts, by_word, lexicon, scratch, sweeps, burn, discounts, strengths)
    n, total, many = model.n_tokens, model.n_tokens + model.vocabulary + 1, sweeps - burn
    hot = _hot(lexicon, (model.contexts.where("hot_u").drop("hot_u"), "u"), (model.words.where("hot_w").drop("hot_w"), "w"))
    none = np.zeros(0)
    filler = spark.sparkContext.broadcast(Cache(hot, none.astype(np.int64), none, False, model.levels, model.single, model.unseen))
    light_u, light_w = model.contexts.where("not hot_u").drop("hot_u"), model.words.where("not hot_w").drop("hot_w")

    def numbers(batch: pa.RecordBatch, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of rows with joined numbers: the context's customers, its shares, the roots."""
        fill = filler.value.hot.fill
        back = [fill(f"back{i}", u, batch.column(f"back{i}"), np.nan) for i in range(many)]
        return fill("n", u, batch.column("n"), np.nan), back, [fill(f"root{i}", w, batch.column(f"root{i}"), np.nan) for i in range(many)]

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, own = batch.column("c").to_numpy(), np.nan_to_num(batch.column("own").to_numpy(zero_copy_only=False).astype(float))
            n_, back, root = numbers(batch, _key(batch, "u"), _key(batch, "w"))
            no = np.zeros(len(c), bool)
            n_, back = filler.value.context(n_, back, no, no)
            p = np.where(c > 1, own, np.where(c == 1, _single(np.nan_to_num(n_, nan=1.0), model_levels), 0.0))
            for b, r in zip(back, filler.value.roots(root, no, no)):
                p = p + b * r
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("u", "w", "hot_u", "hot_w", "c", "cw")), pa.array(np.log10(np.minimum(p, 1.0)))],
                names=["u", "w", "hot_u", "hot_w", "c", "cw", "logp"],
            )

    model_levels = model.levels
    known = _looked_up(_looked_up(model.pairs, "u", light_u), "w", light_w)
    known = scratch.store(known.mapInArrow(observed, "u long, w long, hot_u boolean, hot_w boolean, c long, cw double, logp double"), "observed")
    scratch.drop(counts, by_word, model.stored[0])
    both = known.where("hot_u and hot_w").withColumn("size", F.floor(8 * F.log2(F.greatest("c", F.lit(1)))).cast("int"))
    least, room, complete = 0, pairs, True
    for size, m in sorted((tuple(r) for r in both.groupBy("size").count().collect()), reverse=True):  # under 512 rows
        room -= m
        if room < 0:
            least, complete = size + 1, False
            break
    cached = both.where(F.col("size") >= least).select("u", "w", "logp").toArrow()  # at most `pairs` rows
    key = lexicon.find(cached["u"].to_numpy().view(_U)) * len(lexicon.heavy) + lexicon.find(cached["w"].to_numpy().view(_U))
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast(Cache(hot, key[order], cached["logp"].to_numpy()[order], complete, model.levels, model.single, model.unseen))
    del cached, key, order

    ids = docs.select("doc_id", F.coalesce(F.xxhash64("text", "learns"), F.lit(0)).alias("fp"), "text", "learns")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text a row of sums over the tokens that are known here, and a row of each of the others."""
        schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "fp", "u", "w")] + [("hot", pa.int32()), ("pair", pa.bool_()), ("n_tokens", pa.int64()), ("n_near", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

        def rows(**columns: pa.Array) -> pa.RecordBatch:
            n = len(columns["fp"])
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        for batch in batches:
            fps, learn = batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for lo, h, first in tokens(batch.column(2)):
                k = len(first) - 1
                u, doc = contexts_of(h, first), np.repeat(np.arange(k), np.diff(first))
                learns = learn[lo + doc]
                x = shared.value.find(h, u, learns, sketch)
                base = np.where(x.near_w, np.log10((x.count + 1) / total), 0.0)
                yield rows(
                    doc_id=batch.column(0).slice(lo, k), fp=batch.column(1).slice(lo, k), n_tokens=pa.array(np.diff(first)),
                    n_near=pa.array(np.bincount(doc[x.count > 0], minlength=k)), base=pa.array(np.bincount(doc, base, k)), score=pa.array(np.bincount(doc, x.logp, k)),
                )
                away = np.flatnonzero(~x.hit)
                doc = doc[away] + lo
                hot = (x.near_u[away] + 2 * x.near_w[away] + 4 * learns[away]).astype(np.int32)
                yield rows(
                    doc_id=batch.column(0).take(pa.array(doc)), fp=pa.array(fps[doc]), u=pa.array(u[away].view(np.int64)), w=pa.array(h[away].view(np.int64)),
                    hot=pa.array(hot), pair=pa.array(x.pair[away]),
                )
        give_back()

    def new_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w = _key(batch, "u"), _key(batch, "w")
            learns, once_u, once_w = (batch.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("learns", "hot_u", "hot_w"))
            once_u, once_w = once_u & (filler.value.hot.lexicon.find(u) < 0), once_w & (filler.value.hot.lexicon.find(w) < 0)
            n_, back, root = numbers(batch, u, w)
            n_, back = filler.value.context(n_, back, once_u, learns)
            logp = filler.value.new_pair(n_, back, filler.value.roots(root, once_w, learns), learns)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "fp", "hot_w", "cw")), pa.array(logp)], names=["doc_id", "fp", "hot_w", "cw", "logp"])

    both = scratch.store(ids.mapInArrow(looked_up, "doc_id long, fp long, u long, w long, hot int, pair boolean, n_tokens long, n_near long, base double, score double"), "away")
    each = scratch.store(both.where("n_tokens is not null").select("doc_id", "fp", "n_tokens", "n_near", "base", "score"), "texts")
    away = both.where("n_tokens is null").select("doc_id", "fp", "u", "w", "hot", "pair")
    light, parts = ~F.col("hot_w"), []
    for k in range(slices):

        def sliced(rows: DataFrame, k: int = k) -> DataFrame:
            return rows.where(F.pmod(F.xxhash64("u", "w"), F.lit(slices)) == k)

        mine = sliced(away)
        asked = mine.where("pair").drop("pair").join(sliced(known.select("u", "w", "cw", "logp")), ["u", "w"], "left")
        asked = scratch.store(_flags(asked.withColumn("learns", F.col("hot").bitwiseAND(4) > 0)), "asked")
        rest = _flags(mine.where("not pair").drop("pair").withColumn("learns", F.col("hot").bitwiseAND(4) > 0))
        fresh = asked.where("logp is null").drop("cw", "logp").unionByName(rest)
        fresh = _looked_up(_looked_up(fresh, "u", light_u), "w", light_w)
        fresh = fresh.mapInArrow(new_pairs, "doc_id long, fp long, hot_w boolean, cw double, logp double")
        sums = (
            asked.where("logp is not null").select("doc_id", "fp", "hot_w", "cw", "logp").unionByName(fresh)
            .select(
                "doc_id", "fp", (light & F.col("cw").isNotNull()).cast("long").alias("more_known"),
                F.when(light, F.log10((F.coalesce("cw", F.lit(0.0)) + 1) / F.lit(float(total)))).otherwise(F.lit(0.0)).alias("more_base"), F.col("logp").alias("more"),
            )
            .groupBy("doc_id", "fp")
            .agg(*(F.sum(x).alias(x) for x in ("more_known", "more_base", "more")))
        )
        parts.append(scratch.store(sums, "away-sums"))
        scratch.drop(asked)
    scratch.drop(known, both, *model.stored)
    sums = reduce(DataFrame.unionByName, parts).groupBy(F.col("doc_id").alias("d2"), F.col("fp").alias("f2"))
    sums = scratch.store(sums.agg(*(F.sum(x).alias(x) for x in ("more_known", "more_base", "more"))), "away-sums")
    scratch.drop(*parts)
    copies = F.count("*").over(Window.partitionBy("doc_id", "fp"))
    joined = each.withColumn("copies", copies).join(sums, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("fp") == F.col("f2")), "left")

    def part(x: str):
        return F.coalesce(F.col(x) / F.col("copies"), F.lit(0.0))

    return joined.select(
        "doc_id", "n_tokens", (F.col("n_near") + part("more_known").cast("long")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + part("more_base")).alias("base_score"), (F.col("score") + part("more")).alias("score"),
    )
