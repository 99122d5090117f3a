"""Threshold alerts on rollups: measuring, firing, cooldown, incidents and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..scratch import Scratch
from . import greedy

RULE = ("rule_id", "site_id", "name", "event_type", "geo_level", "geo_area_id", "granularity", "threshold", "comparator", "cooldown_seconds", "enabled", "version")


def valid_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules of a known granularity and comparator; others are skipped alone."""
    return rules.where(F.col("enabled") & F.col("granularity").isin("5m", "1d") & F.col("comparator").isin(">=", "<="))


def measure_alerts(rollups: DataFrame, rules: DataFrame, buckets: DataFrame) -> DataFrame:
    """(rule_id, bucket_time) of ``buckets`` -> also measured: the events of the rule's
    site, level, type and area (an empty area is any), 0 if there are none. Rollups are
    added up by area before rules, a small table, meet them."""
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in ("rule_id", "site_id", "event_type", "geo_level", "geo_area_id", "granularity")])
    sums = rollups.groupBy("site_id", "granularity", "geo_level", "geo_area_id", "event_type", "bucket_time").agg(F.sum("event_count").alias("n"))
    area = F.coalesce("r_geo_area_id", F.lit(""))
    same = [F.col(c) == F.col(f"r_{c}") for c in ("site_id", "event_type", "geo_level", "granularity")] + [(area == "") | (F.col("geo_area_id") == area)]
    found = sums.join(C.small(r), same).groupBy(F.col("r_rule_id").alias("rule_id"), "bucket_time").agg(F.sum("n").alias("measured"))
    return buckets.select("rule_id", "bucket_time").join(found, ["rule_id", "bucket_time"], "left").withColumn("measured", F.coalesce("measured", F.lit(0)))


def _step(granularity):
    return F.when(granularity == "1d", F.make_dt_interval(F.lit(1))).otherwise(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5)))


def evaluate_alerts(rollups: DataFrame, rules: DataFrame, now: str, lookback: int = 2) -> DataFrame:
    """Of the newest ``lookback`` buckets of each rule, the newest that fires."""
    rules = valid_rules(rules)
    clock = F.expr(f"timestamp_ntz '{now}'")
    newest = F.when(F.col("granularity") == "1d", C.bucket_floor(clock, "1d")).otherwise(C.bucket_floor(clock, "5m"))
    back = F.explode(F.sequence(F.lit(0), F.lit(max(1, lookback) - 1)))
    buckets = rules.withColumn("back", back).select("rule_id", (newest - _step(F.col("granularity")) * F.col("back")).alias("bucket_time"))
    hits = measure_alerts(rollups, rules, buckets).join(C.small(rules.select(*RULE)), "rule_id").where(C.fires(F.col("measured"), F.col("threshold"), F.col("comparator")))
    first = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("bucket_time")))
    return hits.withColumn("nth", first).where("nth = 1").drop("nth")


def apply_cooldown(hits: DataFrame, incidents: DataFrame, now: str) -> DataFrame:
    """Hits without an incident of the same rule and area since now less the cooldown."""
    clock = F.expr(f"timestamp_ntz '{now}'")
    last = incidents.groupBy(F.col("rule_id").alias("i_rule"), F.coalesce("geo_area_id", F.lit("")).alias("i_area")).agg(F.max("created_at").alias("i_last"))
    since = clock - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("cooldown_seconds").cast("decimal(18,6)"))
    cond = (F.col("rule_id") == F.col("i_rule")) & (F.coalesce("geo_area_id", F.lit("")) == F.col("i_area")) & (F.col("i_last") >= since)
    return hits.join(last, cond, "left_anti")


def dedup_key():
    epoch = F.unix_seconds(F.col("bucket_time").cast("timestamp")).cast("string")
    return F.concat_ws("|", F.col("rule_id").cast("string"), F.coalesce("geo_area_id", F.lit("")), "granularity", epoch)


def open_incidents(hits: DataFrame, incidents: DataFrame | None, now: str) -> DataFrame:
    """New incidents with a snapshot of their rule; none that is there already."""
    snapshot = F.to_json(F.struct(*RULE))
    rows = hits.withColumn("dedup_key", dedup_key()).select(
        "dedup_key", "rule_id", "site_id", F.col("name").alias("rule_name"), "geo_area_id", "granularity", "bucket_time", F.col("measured").alias("measured_value"), "threshold", "comparator",
        F.col("version").alias("rule_version"), snapshot.alias("rule_snapshot"), F.expr(f"timestamp_ntz '{now}'").alias("created_at"),
    )
    return rows if incidents is None else rows.join(incidents.select("dedup_key"), "dedup_key", "left_anti")


def backtest_alerts(rollups: DataFrame, rules: DataFrame, start: str, end: str) -> DataFrame:
    """Every rule over every bucket of [start, end): buckets that fire and come more than
    the cooldown after the last one that did."""
    rules = valid_rules(rules)
    first, last = F.expr(f"timestamp_ntz '{start}'"), F.expr(f"timestamp_ntz '{end}'")
    buckets = rules.select("rule_id", F.explode(F.sequence(first, last, _step(F.col("granularity")))).alias("bucket_time")).where(F.col("bucket_time") < last)
    hits = measure_alerts(rollups, rules, buckets).join(C.small(rules.select(*RULE)), "rule_id").where(C.fires(F.col("measured"), F.col("threshold"), F.col("comparator")))
    epoch = F.unix_seconds(F.col("bucket_time").cast("timestamp"))
    seen = Scratch(hits.sparkSession).store(hits.select(F.struct("rule_id").alias("_k"), "rule_id", epoch.alias("_t"), "bucket_time", "measured", "cooldown_seconds"), "alert-hits")
    kept = greedy.select(seen, ["rule_id"], F.col("_t"), F.greatest(F.col("cooldown_seconds"), F.lit(0)) + 1)
    return seen.join(kept, ["_k", "_t"], "left_semi").select("rule_id", "bucket_time", "measured")


def notification_status(incidents: DataFrame, attempts: DataFrame, most: int = 8, retry: str = "60 seconds") -> DataFrame:
    """Delivery state of each incident from the log of attempts (dedup_key, attempted_at, ok)."""
    log = attempts.groupBy("dedup_key").agg(F.count("*").alias("n"), F.max("attempted_at").alias("last_attempt"), F.bool_or("ok").alias("done"))
    rows = incidents.select("dedup_key", "created_at").join(log, "dedup_key", "left").withColumn("attempts", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("done"), "DELIVERED").when(F.col("attempts") >= most, "DEAD_LETTER").when(F.col("attempts") > 0, "RETRY_WAIT").otherwise("PENDING")
    due = F.when(F.col("state") == "RETRY_WAIT", F.col("last_attempt") + F.expr(f"interval {retry}")).when(F.col("state") == "PENDING", F.col("created_at"))
    return rows.withColumn("state", state).withColumn("next_attempt", due).select("dedup_key", "created_at", "attempts", "state", "next_attempt")


def due_notifications(status: DataFrame, now: str, limit: int = 25) -> DataFrame:
    rows = status.where(F.col("state").isin("PENDING", "RETRY_WAIT") & (F.col("next_attempt") <= F.expr(f"timestamp_ntz '{now}'")))
    return rows.orderBy("created_at", "dedup_key").limit(limit)


def notification_payload(incidents: DataFrame) -> DataFrame:
    key = F.concat(F.lit("incident:"), "dedup_key")
    bucket = F.date_format(F.col("bucket_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    summary = F.format_string("%s %s threshold %d (measured %d, bucket %s)", "comparator", "rule_name", "threshold", "measured_value", bucket)
    meta = F.create_map(
        F.lit("siteId"), "site_id", F.lit("ruleId"), F.col("rule_id").cast("string"), F.lit("geoAreaId"), F.coalesce("geo_area_id", F.lit("")),
        F.lit("measuredValue"), F.col("measured_value").cast("string"), F.lit("threshold"), F.col("threshold").cast("string"),
    )
    return incidents.select(
        F.lit("ANALYTICS_ALERT_TRIGGERED").alias("event_type"), F.lit("ADMIN_ALERTS").alias("topic"), F.concat(F.lit("Alert: "), "rule_name").alias("title"), summary.alias("summary"),
        F.lit("ALERT").alias("source_type"), F.col("rule_id").cast("string").alias("source_id"), F.lit(1).alias("schema_version"), key.alias("idempotency_key"), meta.alias("metadata"),
    )


def recent_incidents(incidents: DataFrame, now: str, hours: int = 24, limit: int = 50) -> DataFrame:
    hours, limit = max(1, min(2160, hours)), max(1, min(200, limit))
    rows = incidents.where(F.col("created_at") >= F.expr(f"timestamp_ntz '{now}' - interval {hours} hours"))
    return rows.orderBy(F.desc("created_at"), "dedup_key").limit(limit)


def incident_summary(status: DataFrame) -> DataFrame:
    done = F.col("state") == "DELIVERED"
    return status.agg(F.count("*").alias("total"), F.count_if(done).alias("notified"), F.count_if(~done).alias("pending"))


def filter_alert_rules(rules: DataFrame, name: str | None = None, event_type: str | None = None, enabled: bool | None = None) -> DataFrame:
    rows = rules.where(C.contains_filter(F.col("name"), name))
    rows = rows.where(F.col("event_type") == event_type) if event_type else rows
    return rows if enabled is None else rows.where(F.col("enabled") == enabled)


def rule_revision_diff(revisions: DataFrame) -> DataFrame:
    """Changed fields of each revision (before_state, after_state as JSON objects), and
    what to be warned of."""
    def fields(c: str):
        return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))

    both = F.map_zip_with(fields("before_state"), fields("after_state"), lambda k, a, b: F.struct(a.alias("from"), b.alias("to")))
    changed = F.map_filter(both, lambda k, v: ~v["from"].eqNullSafe(v["to"]))
    after = fields("after_state")
    warning = F.when(F.lower(F.col("field")).eqNullSafe("enabled") & F.lower("to").eqNullSafe("false"), "disables the rule").when(
        F.col("field").eqNullSafe("threshold") & F.col("to").eqNullSafe("0"), "a threshold of 0 always fires"
    )
    rows = revisions.withColumn("after", after).select("rule_id", "version", F.explode(changed)).select("rule_id", "version", F.col("key").alias("field"), "value.from", "value.to")
    return rows.withColumn("warning", warning)


def rules_as_of(revisions: DataFrame, t: str) -> DataFrame:
    rows = revisions.where(F.col("created_at") <= F.expr(f"timestamp_ntz '{t}'"))
    return rows.groupBy("rule_id").agg(F.max("version").alias("version"), F.max_by("after_state", "version").alias("state"))


def validate_alert_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    reason = F.lit(None).cast("string")
    for c in ("event_type", "name", "site_id"):
        reason = F.when(C.blank(F.col(c)), f"{c} is required").otherwise(reason)
    reason = (
        F.when(reason.isNotNull(), reason).when(~F.col("geo_level").isin("GLOBAL", "COUNTRY", "REGION", "METRO"), "geoLevel must be GLOBAL, COUNTRY, REGION, or METRO")
        .when(~F.col("granularity").isin("5m", "1d"), "granularity must be 5m or 1d").when(~F.col("comparator").isin(">=", "<="), "comparator must be >= or <=")
        .when(F.col("threshold") < 0, "threshold must be at least 0").when(F.col("cooldown_seconds") < 60, "cooldownSeconds must be at least 60")
    )
    marked = rules.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
