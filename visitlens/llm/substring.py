"""Removal of repeated passages: windows of 20 words, exact, behind a count-min filter.

Pass one hashes every window inside tasks and sends each task's counts as compressed
cells, so many that hardly two windows share one; they are merged block by block, and
the cells that occur again fill the sketch, which overestimates each window's count.
Pass two sends only windows estimated repeated, and groups them exactly by a 96-bit
hash: the smallest document that has each. The minimum is combined before the shuffle,
so a passage shared by any share of the documents meets in one task only as one row per
task. The last pass gives each document the windows which it has first, and removes
words covered by other repeated windows. A window that occurs twice is never lost,
however full the sketch is; only windows that are repeated fill it, so single ones take
the second pass in the same small share at any size, up to 2**28 unlike repeated windows.

Defined results: a null or empty text has no words; texts of under 20 words have no
windows and keep all; rows with the same doc_id do not take words from each other; a
null doc_id comes after all others, and such rows go by a hash of their text, so that
alike ones count as rows of one id; an empty table gives an empty table; extra columns
are ignored, or carried along, whatever their names, if named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH, Sketch, cell_parts, cell_space, give_back, ranges, repeat_filter, stored, text_chunks, window_hashes, word_hashes, word_spans

WINDOW = 20
CELLS_PER_REPEAT, MOST_BITS, DEPTH = 8.0, 28, 2


def _windows(texts: pa.Array, k: int, seed2: bool) -> Iterator[tuple]:
    """Per chunk of rows: first row, bytes, word starts, word ends, first word of each
    text, first window of each text, window starts, hashes, second hashes."""
    for lo, hi, b, off in text_chunks(texts):
        starts, ends, first = word_spans(b, off)
        at = ranges(first[:-1], np.maximum(first[1:] - (k - 1), first[:-1]))
        edge = np.searchsorted(at, first)
        h1 = window_hashes(word_hashes(b, starts, ends), k)[at]
        h2 = (window_hashes(word_hashes(b, starts, ends, 1), k, 1)[at] >> np.uint64(32)) if seed2 else None
        yield lo, b, starts, ends, first, edge, at, h1, h2


def _pairs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Both hashes of each window as one value that can be sorted and looked up."""
    out = np.empty((len(h1), 2), ">u8")
    out[:, 0], out[:, 1] = h1, h2
    return out.view("S16").ravel()


def repeat_sketch(docs: DataFrame, window: int) -> Sketch:
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    space = cell_space(n_bytes // 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            parts = list(cell_parts(np.concatenate(held), space)) if held else []
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["block", "payload"]
            )

        for batch in batches:
            for *_, h1, _ in _windows(batch.column(0), window, False):
                held.append(h1)
                n += len(h1)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        yield flush()
        give_back()

    return repeat_filter(docs.select("text").mapInArrow(count, "block int, payload binary"), space, CELLS_PER_REPEAT, MOST_BITS, DEPTH)


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry`` as the struct ``row``, n_words, n_removed and
    kept_text (the kept words joined by one blank), one row per row of docs."""
    row = [F.struct(*carry).alias("row")] if carry else []
    rows = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.coalesce(F.xxhash64("text"), F.lit(0))).alias("alike"), "text", *row)
    sketch = repeat_sketch(rows, window)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, _, _, _, edge, _, h1, h2 in _windows(batch.column(2), window, True):
                hit = sketch.repeated(h1)
                doc = pa.array((np.repeat(np.arange(len(edge) - 1), np.diff(edge)) + lo)[hit])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[hit].view(np.int64)) for x in (h1, h2)), batch.column(0).take(doc), batch.column(1).take(doc)], names=["h1", "h2", "doc", "like"]
                )
        give_back()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, firsts = batch.column(names.index("text")), batch.column(names.index("firsts"))
            n_words, n_removed, out = [], [], []
            for lo, b, starts, ends, first, edge, at, h1, h2 in _windows(texts, window, True):
                hit = sketch.repeated(h1)
                both = _pairs(h1, h2)
                data = b.tobytes()
                for i in range(len(first) - 1):
                    w0, w1, e0, e1 = first[i], first[i + 1], edge[i], edge[i + 1]
                    n_words.append(int(w1 - w0))
                    gone = 0
                    if hit[e0:e1].any():
                        h = both[e0:e1]
                        own = firsts[lo + i].values
                        again = np.ones(len(h), bool)
                        again[np.unique(h, return_index=True)[1]] = False
                        mine = np.zeros(len(h), bool)
                        if own is not None:
                            mine = np.isin(h, _pairs(*(own.field(x).to_numpy().view(np.uint64) for x in ("h1", "h2"))))
                        lost = np.flatnonzero(again | (hit[e0:e1] & ~mine))
                        cover = np.zeros(w1 - w0 + 1, np.int64)
                        np.add.at(cover, lost, 1)
                        np.add.at(cover, lost + window, -1)
                        stay = np.cumsum(cover[:-1]) == 0
                        gone = int(len(stay) - stay.sum())
                    n_removed.append(gone)
                    if gone:
                        keep = np.flatnonzero(stay) + w0
                        out.append(b" ".join([data[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())]))
                    else:
                        out.append(b" ".join(data[starts[w0] : ends[w1 - 1]].split()) if w1 > w0 else b"")
            new = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(out, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(
                [new[f.name] if f.name in new else batch.column(names.index(f.name)) for f in result], names=[f.name for f in result]
            )
        give_back()

    found = (
        rows.select("doc_id", "alike", "text")
        .mapInArrow(candidates, "h1 long, h2 long, doc long, like long")
        .groupBy("h1", "h2")
        .agg(F.min("doc").alias("doc"), F.min("like").alias("like"))
        .groupBy("doc", F.when(F.col("doc").isNull(), F.col("like")).alias("like"))
        .agg(F.collect_list(F.struct("h1", "h2")).alias("firsts"))
    )
    found = stored(found, "first-windows")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & F.col("alike").eqNullSafe(F.col("like")), "left").drop("doc", "like")
    schema = rows.drop("alike", "text").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    result = list(schema.fields)
    return joined.mapInArrow(kept, schema)


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of op7's rows, for unique doc_ids."""
    seq = " || ' ' || ".join(f"w{i}" for i in range(window))
    lead = ", ".join(f"lead(word, {i}) over (partition by doc_id order by pos) as w{i}" for i in range(window))
    return f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
l as (select doc_id, pos, {lead} from w),
s as (select doc_id, pos, {seq} as seq from l where w{window - 1} is not null),
r as (select doc_id, pos, row_number() over (partition by seq order by doc_id, pos) as nth from s),
c as (select w.doc_id, w.word, w.pos,
             coalesce(max(case when r.nth > 1 then 1 end) over (partition by w.doc_id order by w.pos rows between {window - 1} preceding and current row), 0) as gone
      from w left join r on r.doc_id = w.doc_id and r.pos = w.pos),
k as (select doc_id, sum(gone)::bigint as n_removed, coalesce(string_agg(case when gone = 0 then word end, ' ' order by pos), '') as kept
      from c group by doc_id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k using (doc_id)"""
