"""Selection along time against a fold."""

import random

import pytest
from pyspark.sql import functions as F

from visitlens.operators import dedup, greedy
from visitlens.plans import tables as T


def fold(times, limit):
    last, out = None, []
    for t in sorted(times):
        if last is None or t >= last + limit:
            out.append(t)
            last = t
    return out


def taken(df):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r._k), []).append(r._t)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("limit", [1, 7, 50, 5000])
def test_selection_equals_the_fold(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice(["a", "b", None, f"k{rng.randrange(40)}"]), rng.randrange(-300, 3000) * (1 if rng.random() < 0.9 else 1000)) for _ in range(2500)]
    table = spark.createDataFrame(rows, "key string, t long").repartition(5)
    want = {}
    for k, t in rows:
        want.setdefault((k,), []).append(t)
    assert taken(greedy.select(table, ["key"], F.col("t"), F.lit(limit))) == {k: fold(v, limit) for k, v in want.items()}


def test_a_key_without_gaps_is_spread(spark):
    """One key with an arrival every second: no arrival starts anew, links alone tell; no
    partition of the links holds more than a small share of the key's arrivals."""
    n = 60_000
    table = spark.range(n).select(F.lit("bot").alias("key"), F.col("id").alias("t"))
    assert taken(greedy.select(table, ["key"], F.col("t"), F.lit(300))) == {("bot",): list(range(0, n, 300))}
    rows = table.select(F.struct("key").alias("_k"), F.col("t").alias("_t"), F.lit(300).cast("long").alias("_limit"))
    assert greedy.links(rows).where("starts").count() == 1
    plan = greedy.links(rows)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Python" not in plan


def test_limits_may_differ_by_key_and_times_may_be_null(spark):
    rows = [("a", 0, 10), ("a", 9, 10), ("a", 10, 10), ("b", 0, 3), ("b", 2, 3), ("b", 3, 3), ("b", None, 3), ("c", None, 5)]
    table = spark.createDataFrame(rows, "key string, t long, cool long")
    assert taken(greedy.select(table, ["key"], F.col("t"), F.col("cool"))) == {("a",): [0, 10], ("b",): [0, 3]}
    assert greedy.select(table.limit(0), ["key"], F.col("t"), F.col("cool")).isEmpty()


def test_rows_without_a_time(spark, sf):
    """Of a key's rows without a time one is let through, and it starts no wait."""
    rows = T.enriched(spark, sf).where("event_type = 'page_view' and session_id is not null").limit(1)
    null = rows.withColumn("event_time", F.lit(None).cast("timestamp_ntz"))
    assert dedup.dedup_ttl(null.unionByName(null)).count() == 1
    assert dedup.dedup_ttl(null.unionByName(null).unionByName(rows)).count() == 2
    assert dedup.throttle_visits(null.unionByName(rows).unionByName(rows)).count() == 2


def test_what_came_before_counts(spark, sf):
    """A view inside the wait of an earlier batch goes, however much older than it; one at its end stays."""
    base = T.enriched(spark, sf).where("event_type = 'page_view' and session_id is not null").limit(1)

    def at(name, seconds):
        return base.withColumns({"event_id": F.lit(name), "event_time": F.expr(f"timestamp_ntz '2024-01-15T10:00:00' + interval {seconds} seconds")})

    views = at("old", -3 * 86_400).unionByName(at("in", 299)).unionByName(at("end", 300)).unionByName(at("after", 599)).unionByName(at("next", 600))
    marks = dedup.visit_keys(at("m", 0)).groupBy(*dedup.VISIT).agg(F.max(dedup.micros()).alias("last"))
    assert sorted(r.event_id for r in dedup.throttle_visits(views, 300, marks).collect()) == ["end", "next"]
