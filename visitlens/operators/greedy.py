"""Selection along time: of each key's arrivals the first is taken, and then always the
first that comes at least a limit after the last one taken.

Every arrival has a link to the arrival that would be taken next if it were. Two that are
taken never share a period of one limit, so links are found by a merge of each period with
the one before. An arrival that comes a limit or more after its predecessor is taken in any
case; from these on, links are followed by pointer doubling: each round joins the links with
themselves, so a chain of n arrivals takes log2(n) rounds. All joins are on key and time
together, so one key with all of the arrivals is spread like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch

SPAN = 1024  # periods of a key whose neighbours are found together


def _neighbours(periods: DataFrame) -> DataFrame:
    """Periods (_k, _p, lo, hi) -> also before (hi of the period before) and after (lo of
    the one behind), first inside spans of periods, then from span to span."""
    inside = Window.partitionBy("_k", "_s").orderBy("_p")
    rows = periods.withColumn("_s", F.floor(F.col("_p") / SPAN)).withColumns({"before": F.lag("hi").over(inside), "after": F.lead("lo").over(inside)})
    along = Window.partitionBy("_k").orderBy("_s")
    spans = rows.groupBy("_k", "_s").agg(F.min("lo").alias("s_lo"), F.max("hi").alias("s_hi"))
    spans = spans.withColumns({"s_before": F.lag("s_hi").over(along), "s_after": F.lead("s_lo").over(along)}).drop("s_lo", "s_hi")
    out = rows.join(spans, ["_k", "_s"])
    return out.select("_k", "_p", "lo", "hi", F.coalesce("before", "s_before").alias("before"), F.coalesce("after", "s_after").alias("after"))


def links(arrivals: DataFrame) -> DataFrame:
    """Arrivals (_k, _t, _limit), each time of a key once -> _k, _t, starts (taken in any
    case) and next (null if there is none, or it is taken in any case)."""
    rows = arrivals.withColumn("_p", F.floor(F.col("_t") / F.col("_limit")))
    periods = _neighbours(rows.groupBy("_k", "_p").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")))
    inside = Window.partitionBy("_k", "_p").orderBy("_t")
    rows = rows.withColumn("prior", F.lag("_t").over(inside)).join(periods, ["_k", "_p"])

    def place(t: Column, starts: Column) -> Column:
        return F.when(t.isNotNull(), F.struct(t.alias("t"), starts.alias("starts")))

    behind = place(F.col("after"), F.col("after") - F.col("hi") >= F.col("_limit"))
    prior = F.coalesce("prior", "before")
    rows = rows.select("_k", "_t", "_limit", "_p", behind.alias("behind"), (F.col("_t") == F.col("hi")).alias("ends"), F.coalesce(F.col("_t") - prior >= F.col("_limit"), F.lit(True)).alias("starts"))
    none = F.lit(None).cast("boolean")
    asks = rows.select("_k", (F.col("_p") + 1).alias("_p"), (F.col("_t") + F.col("_limit")).alias("x"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["behind"].dataType).alias("found"), "_t", "starts", "behind")
    here = rows.select("_k", "_p", F.col("_t").alias("x"), F.lit(0).alias("kind"), place(F.col("_t"), F.col("starts")).alias("found"), F.lit(None).cast("long").alias("_t"), none.alias("starts"), F.lit(None).cast(rows.schema["behind"].dataType).alias("behind"))
    # what follows the last arrival of a period stands at the period's end
    ends = rows.where("ends").select("_k", "_p", F.lit((1 << 63) - 1).alias("x"), F.lit(0).alias("kind"), F.col("behind").alias("found"), F.lit(None).cast("long").alias("_t"), none.alias("starts"), F.lit(None).cast(rows.schema["behind"].dataType).alias("behind"))
    later = Window.partitionBy("_k", "_p").orderBy(F.desc("x"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a period without arrivals has no rows to ask: what follows the asking period is next then
    merged = asks.unionByName(here).unionByName(ends).withColumns({"next": F.last("found", ignorenulls=True).over(later), "any": F.max(F.col("kind") == 0).over(later)})
    found = F.when(F.coalesce("any", F.lit(False)), F.col("next")).otherwise(F.col("behind"))
    return merged.where("kind = 1").withColumn("to", found).select("_k", "_t", "starts", F.when(~F.col("to.starts"), F.col("to.t")).alias("next"))


def select(arrivals: DataFrame, keys: list[str], time: Column, limit: Column) -> DataFrame:
    """(``keys`` as the struct _k, _t) of what is taken of ``arrivals``; null keys are keys like others.
    Rows without a time are not looked at. ``limit`` is the same for all rows of a key."""
    scratch = Scratch(arrivals.sparkSession)
    rows = arrivals.select(F.struct(*keys).alias("_k"), time.cast("long").alias("_t"), limit.cast("long").alias("_limit")).where("_t is not null")
    rows = rows.groupBy("_k", "_t").agg(F.max("_limit").alias("_limit"))
    linked = scratch.store(links(rows), "greedy-links")
    taken, jump, old = [linked.where("starts").select("_k", "_t")], linked.where("next is not null").select("_k", "_t", "next"), []
    live = linked.where("starts and next is not null").select("_k", "_t")
    while not jump.isEmpty():
        # those reached after n steps -> those after n to 2n; who has no link so long has none longer
        hit = scratch.store(live.join(jump, ["_k", "_t"]), "greedy-taken")
        taken.append(hit.select("_k", F.col("next").alias("_t")))
        live = hit.select("_k", "_t").unionByName(taken[-1])
        ahead = jump.select("_k", F.col("_t").alias("next"), F.col("next").alias("beyond"))
        jump = scratch.store(jump.join(ahead, ["_k", "next"]).select("_k", "_t", F.col("beyond").alias("next")), "greedy-jump")
        scratch.drop(*old)
        old = [jump]
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out
