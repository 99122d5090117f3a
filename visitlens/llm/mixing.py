"""Mixing of sources to target weights, with exact budgets.

Each document gets a hash-random key, the same in every run. Documents are dealt by key
range inside their source; sums by range and their running totals give each range's
place, and a window inside a range gives each document's. The cut is at the source's
exact budget, so that one document per source and epoch may be taken in part. Only the
small columns are shuffled, never the texts, and a hot source is spread over its ranges.
All of it is DataFrame code.

Defined results: a null text has size 0; the null source is a source of its own, last in
order; repeated rows count each; an empty table gives an empty table; extra columns
are ignored (``take`` keeps them, whatever their names). All ranges of a source are
ordered in one task, and all sources in one: some 10**7 of either are fine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, row_keys, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(skey, source, source_size) -> also target: shares by weight of ``share`` of all
    sizes, none above ``most`` times its source, the excess reshared by weight. In the
    order of cap per unit of weight, the first source that is not capped fixes the level
    for itself and all later ones."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    rows = (
        rows.withColumn("all", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("capped")) / F.col("rest_w"))
    )
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(Window.partitionBy())
    return rows.withColumn("at", level["level"]).select(
        "skey", "source", "source_size", F.coalesce(F.least("cap", F.col("at") * F.col("w")), F.col("cap")).alias("target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, rows_per_range: int = 65_536, row_key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, one row per row of docs, and
    the column ``row_key``, which orders rows that are alike."""
    carry = [row_key] if row_key else []
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("key"),
            *carry,
        ),
        "sized",
    )
    digits = max(2, math.ceil(math.log(max(1, sized.count()) / rows_per_range + 1, 16)) + 1)
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    sums = sized.groupBy("skey", "range").agg(F.sum("size").alias("n"), F.first("source").alias("source"))
    sources = sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("n").alias("source_size"))
    targets = source_targets(sources, weights, share, most).drop("source")
    place = F.sum("n").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = stored(
        sums.join(targets, "skey").select("skey", "range", "source_size", "target", F.coalesce(place, F.lit(0)).alias("before")), "mix-ranges"
    )
    inside = F.sum("size").over(
        Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    )
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    out = sized.join(ranges, ["skey", "range"]).withColumn("prior", F.col("before") + F.coalesce(inside, F.lit(0)))
    rest = budget - epochs * F.col("source_size") - F.col("prior")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: a row for each whole epoch and one with the
    first words (joined by one blank) of what was taken in part. Same columns as docs;
    rows of which nothing is taken are gone. Each row, whatever its doc_id (null or
    repeated), has its own place in the plan, by a row key which is given here."""
    keyed = row_keys(docs)
    row = F.col("row")
    plan = mix(keyed.select(row["doc_id"].alias("doc_id"), row["source"].alias("source"), row["text"].alias("text"), F.col("row_key").alias("mix_row")), **options, row_key="mix_row")
    plan = stored(plan.where("taken > 0").select(F.col("mix_row").alias("mix_key"), "size", "taken"), "mix-plan")
    part = F.col("taken") - F.col("copies") * F.col("size")
    rows = keyed.join(plan, F.col("row_key") == F.col("mix_key")).withColumns({"copies": F.floor(F.col("taken") / F.col("size")), "text": row["text"]})
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("copies") + (part > 0).cast("long"))))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("piece") > F.col("copies"), F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.select("row", text.alias("new_text"))
    new = {"text": F.col("new_text"), "n_chars": F.char_length("new_text").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def oracle_sql(weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> str:
    pick = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(weights))
    return f"""
with d as (
  select doc_id, source, coalesce('s' || source, 'n') as skey,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         sha256('{seed}:' || coalesce(doc_id::varchar, '')) as key
  from documents),
s as (select skey, any_value(source) as source, sum(size)::bigint as source_size from d group by skey),
w as (select *, case (row_number() over (order by source nulls last) - 1) % {len(weights)} {pick} end::double as w,
             source_size * {most}::double as cap from s),
o as (select *, sum(source_size) over ()::double * {share} as total,
             coalesce(sum(cap) over (order by cap / w, skey rows between unbounded preceding and 1 preceding), 0.0) as capped,
             sum(w) over (order by cap / w, skey rows between current row and unbounded following) as rest_w from w),
l as (select *, (total - capped) / rest_w as level from o),
f as (select arg_min(level, cap / w) as lv from l where level * w <= cap),
t as (select skey, source_size, coalesce(least(cap, lv * w), cap)::double as target, floor(coalesce(least(cap, lv * w), cap) + 0.5)::bigint as budget
      from l left join f on true),
p as (select d.doc_id, d.size, t.source_size, t.target, t.budget,
             case when t.source_size > 0 then t.budget // t.source_size else 0 end as epochs,
             coalesce(sum(d.size) over (partition by d.skey order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as prior
      from d join t using (skey))
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - prior)))::bigint as taken
from p"""
