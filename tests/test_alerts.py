"""Alert state, retention and merges on small tables."""

from pyspark.sql import functions as F

from visitlens.operators import alerts, journeys, maintenance
from visitlens.plans import rules as R

NOW = "2024-01-31T00:00:00"


def ts(text):
    return F.expr(f"timestamp_ntz '{text}'")


def test_revisions(spark):
    rows = spark.createDataFrame(
        [(1, 1, None, '{"threshold": 5, "enabled": true}', "2024-01-01 00:00:00"), (1, 2, '{"threshold": 5, "enabled": true}', '{"threshold": 0, "enabled": false}', "2024-01-10 00:00:00")],
        "rule_id long, version int, before_state string, after_state string, at string",
    ).withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    diff = {(r.version, r.field): (r["from"], r.to, r.warning) for r in alerts.rule_revision_diff(rows).collect()}
    assert diff[(2, "threshold")] == ("5", "0", "a threshold of 0 always fires") and diff[(2, "enabled")][2] == "disables the rule" and diff[(1, "threshold")][0] is None
    assert [(r.version, r.state) for r in alerts.rules_as_of(rows, "2024-01-05T00:00:00").collect()] == [(1, '{"threshold": 5, "enabled": true}')]
    assert alerts.rules_as_of(rows, "2024-01-11T00:00:00").first().version == 2 and alerts.rules_as_of(rows, "2023-01-01T00:00:00").count() == 0


def test_rule_filters_and_validation(spark):
    rules = R.alert_rules(spark)
    assert [r.rule_id for r in alerts.filter_alert_rules(rules, name="NATION").collect()] == [3]
    assert alerts.filter_alert_rules(rules, event_type="page_view", enabled=False).count() == 1
    valid, rejected = alerts.validate_alert_rules(rules.withColumn("cooldown_seconds", F.when(F.col("rule_id") == 6, 59).otherwise(F.col("cooldown_seconds"))))
    assert valid.count() == 4 and {r.rule_id: r.reason for r in rejected.collect()} == {5: "comparator must be >= or <=", 6: "cooldownSeconds must be at least 60"}


def test_deliveries_cooldown_and_incidents(spark):
    incidents = spark.createDataFrame([(f"k{i}", i, None if i % 2 else "A") for i in range(4)], "dedup_key string, rule_id long, geo_area_id string")
    incidents = incidents.withColumn("created_at", ts("2024-01-30 23:00:00"))
    log = [("k1", "2024-01-30 23:01:00", False), ("k2", "2024-01-30 23:01:00", True)] + [("k3", f"2024-01-30 23:0{k}:00", False) for k in range(8)]
    attempts = spark.createDataFrame(log, "dedup_key string, at string, ok boolean").withColumn("attempted_at", F.col("at").cast("timestamp_ntz"))
    status = alerts.notification_status(incidents, attempts)
    got = {r.dedup_key: (r.state, None if r.next_attempt is None else r.next_attempt.isoformat()) for r in status.collect()}
    assert got == {"k0": ("PENDING", "2024-01-30T23:00:00"), "k1": ("RETRY_WAIT", "2024-01-30T23:02:00"), "k2": ("DELIVERED", None), "k3": ("DEAD_LETTER", None)}
    assert [r.dedup_key for r in alerts.due_notifications(status, "2024-01-30T23:01:30").collect()] == ["k0"]
    assert tuple(alerts.incident_summary(status).first()) == (4, 1, 3)
    hits = spark.createDataFrame([(0, "A", 7200), (1, "", 7200), (2, "A", 60), (9, None, 60)], "rule_id long, geo_area_id string, cooldown_seconds int")
    assert sorted(r.rule_id for r in alerts.apply_cooldown(hits, incidents, NOW).collect()) == [2, 9]
    assert alerts.recent_incidents(incidents, NOW, hours=1).count() == 4 and alerts.recent_incidents(incidents, NOW, hours=24, limit=2).count() == 2


def test_retention(spark):
    rows = spark.createDataFrame([("5m", "2024-01-27 00:00:00"), ("5m", "2024-01-29 00:00:00"), ("1d", "2020-01-01 00:00:00")], "granularity string, t string")
    rows = rows.withColumn("bucket_time", F.col("t").cast("timestamp_ntz"))
    kept, purged = maintenance.apply_retention(rows, "rollups", NOW)
    assert (kept.count(), purged.count()) == (2, 1)
    assert [x.count() for x in maintenance.apply_retention(rows, "rollup_sessions", NOW)] == [1, 2]
    out = rows.withColumns({"sent_at": F.col("bucket_time"), "status": F.when(F.col("granularity") == "1d", "NEW").otherwise("SENT")})
    assert [x.count() for x in maintenance.apply_retention(out, "outbox", "2024-02-11T00:00:00")] == [2, 1]


def test_merges(spark):
    old = spark.createDataFrame([("s", "a", "p", 1), ("s", "b", "p", 2)], "site_id string, session_id string, policy_id string, score int")
    new = spark.createDataFrame([("s", "b", "p", 9), ("s", "b", "q", 3)], old.schema)
    assert sorted(map(tuple, journeys.merge_snapshots(old, new).collect())) == [("s", "a", "p", 1), ("s", "b", "p", 9), ("s", "b", "q", 3)]
    steps = spark.createDataFrame([("e1", 1)], "event_id string, step_order int")
    assert sorted(map(tuple, journeys.insert_funnel_steps(steps, spark.createDataFrame([("e1", 5), ("e2", 2), ("e2", 2)], steps.schema)).collect())) == [("e1", 1), ("e2", 2)]
    assert journeys.active_policy(R.policies(spark)).first().policy_id == R.POLICY_ID
