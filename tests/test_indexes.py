"""Rules found by hash joins against rules tried one by one; retention by folders."""

import os
import random

from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.operators import journeys, maintenance
from visitlens.plans import rules as R
from visitlens.plans import tables as T

RULE = "rule_key string, event_name string, path_source string, path_match_type string, path_pattern string, content_type string, min_engaged_seconds int, min_progress_percent int"


def test_rules_found_by_index_are_those_that_hold(spark):
    rng = random.Random(3)
    paths = ["/", "/a", "/a/b", "/a/b/c", "/ab", "", None, "/x_y", "/é"]
    rules = [(f"r{k}", rng.choice(["view", "open", "", " ", None]), rng.choice(["PAGE", "TARGET", "ANY", "NONE"]), rng.choice(["ANY", "EXACT", "PREFIX", "odd", None]), rng.choice(paths), rng.choice([None, "BLOG", ""]), rng.choice([None, 5]), rng.choice([None, 50])) for k in range(120)]
    steps = [(f"e{k}", "s", f"v{k % 5}", rng.choice(["view", "open", "", None]), None, rng.choice(paths), rng.choice(paths), None, "c", rng.choice([None, "blog", "x"]), rng.choice([None, 3, 9]), rng.choice([None, 80])) for k in range(150)]
    kinds = ("string",) * 4 + ("timestamp",) + ("string",) * 5 + ("int",) * 2
    steps = spark.createDataFrame(steps, ", ".join(f"{c} {t}" for c, t in zip(journeys.STEP, kinds)))
    table = spark.createDataFrame(rules, RULE)
    for fields in (journeys.SIGNAL_RULE, journeys.FUNNEL_RULE):
        named = table.select(*[F.col(c).alias(f"r_{c}") for c in table.columns])
        every = steps.join(F.broadcast(named), C.rule_match({c: F.col(f"r_{c}") for c in fields}, {c: F.col(c) for c in journeys.STEP}))
        got = journeys._match(table, steps, fields)
        pairs = lambda df: sorted((r.event_id, r.r_rule_key) for r in df.collect())
        assert pairs(got) == pairs(every) and got.count() > 100


def test_no_nested_loops(spark, sf):
    """Rules meet steps, and patterns meet domains, in hash joins."""
    steps = journeys.journey_steps(T.enriched(spark, sf))
    snapshots = spark.createDataFrame([("site-main", "x", 3)], "site_id string, session_id string, score int")
    found = journeys._match(R.signal_rules(spark).drop("policy_id"), steps, journeys.SIGNAL_RULE)
    for df in (found, journeys.attribution(steps, snapshots, R.attribution_rules(spark), T.START, T.END)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_retention_drops_folders_and_rewrites_one(spark, tmp_path):
    path = str(tmp_path / "steps")
    rows = spark.range(24 * 6).select(F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.expr("timestamp_ntz '2024-01-01T00:00:00' + make_dt_interval(0, cast(id as int))").alias("event_time"))
    rows = rows.withColumns({"day": F.to_date("event_time"), "batch_id": F.hour("event_time") % 2})
    rows.write.partitionBy("batch_id", "day").parquet(path)
    untouched = {f: os.path.getmtime(f) for f in map(str, (tmp_path / "steps").rglob("day=2024-01-0[456]/*.parquet"))}
    deleted, rewritten = maintenance.purge_folders(spark, path, "journey_steps", "2024-04-02T12:00:00")  # ninety days: 3 January, noon
    assert len(deleted) == 4 and len(rewritten) == 2
    left = spark.read.parquet(path)
    assert left.count() == 24 * 6 - 60 and str(left.agg(F.min("event_time")).first()[0]) == "2024-01-03 12:00:00"
    assert all(os.path.getmtime(f) == t for f, t in untouched.items()) and len(untouched) >= 6
    want = maintenance.apply_retention(rows, "journey_steps", "2024-04-02T12:00:00")[0]
    assert sorted(r.event_id for r in left.collect()) == sorted(r.event_id for r in want.collect())
    assert maintenance.purge_folders(spark, path, "journey_steps", "2024-04-02T12:00:00")[0] == []
