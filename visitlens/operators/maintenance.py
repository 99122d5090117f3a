"""Visitor log queries, retention, request windows, backfill and table writes."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..scratch import Folders, delete
from ..sources import events
from . import enrich, rollups

#: table -> (time column, days kept); rollups and the ledger go by granularity
RETENTION = {
    "raw": ("created_at", 30), "inbox": ("received_at", 14), "outbox": ("sent_at", 14), "snapshots": ("last_event", 90), "journey_steps": ("event_time", 90),
    "funnel_steps": ("event_time", 90), "sessions": ("last_event", 90), "throttle": ("expires_at", 0),
}
BY_GRANULARITY = {"rollups": {"5m": 3}, "rollup_sessions": {"5m": 3, "1d": 30}}


def apply_retention(rows: DataFrame, table: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(kept, purged). Daily rollups are kept for good."""
    def since(days: int):
        return F.expr(f"timestamp_ntz '{now}' - interval {days} days")

    if table in BY_GRANULARITY:
        old = F.lit(False)
        for g, days in BY_GRANULARITY[table].items():
            old = old | ((F.col("granularity") == g) & (F.col("bucket_time") < since(days)))
    else:
        column, days = RETENTION[table]
        old = F.col(column) < since(days)
        if table == "outbox":
            old = old & (F.col("status") == "SENT")
    old = F.coalesce(old, F.lit(False))
    return rows.where(~old), rows.where(old)


def purge_folders(spark: SparkSession, path: str, table: str, now: str) -> tuple[list[str], list[str]]:
    """Retention of a stored table with day= folders, at any depth, whose time column
    gives the day: folders of days that are wholly past their time are deleted and not
    read; of the day in which the time ends, the rows that are left are written anew. The
    folders (deleted, rewritten)."""
    column, days = RETENTION[table]
    end = datetime.fromisoformat(now) - timedelta(days=days)
    deleted, rewritten = [], []
    for folder in Folders(spark).of_days(path):
        day = date.fromisoformat(folder.rsplit("day=", 1)[1])
        if datetime.combine(day, time()) + timedelta(days=1) <= end:
            delete(spark, folder)
            deleted.append(folder)
        elif datetime.combine(day, time()) < end:
            rows = spark.read.parquet(folder)
            draft = f"{folder.rsplit('day=', 1)[0]}_rest={day}"
            rows.where(F.col(column).isNull() | (F.col(column) >= F.expr(f"timestamp_ntz '{end.isoformat()}'"))).write.mode("overwrite").parquet(draft)
            delete(spark, folder)
            Folders(spark).rename(draft, folder)
            rewritten.append(folder)
    return deleted, rewritten


def rate_limit_windows(requests: DataFrame, seconds: int = 60, limit: int = 120) -> DataFrame:
    """Requests per address and fixed window, and how many were over the limit."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    out = requests.groupBy("ip", start.alias("window_start")).agg(F.count("*").alias("requests"))
    return out.withColumn("rejected", F.greatest(F.lit(0), F.col("requests") - limit)).withColumn("over", F.col("rejected") > 0)


def rejected_requests(requests: DataFrame, seconds: int = 60, limit: int = 120) -> DataFrame:
    """The requests themselves that came after a window's limit was reached."""
    window = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    nth = F.row_number().over(Window.partitionBy("ip", window).orderBy("ts", "request_id"))
    return requests.withColumn("nth", nth).where(F.col("nth") > limit).drop("nth")


# ---------------------------------------------------------------- visitor log


def visitor_rows(raw: DataFrame, facts: DataFrame, start: str, end: str, site: str = events.SITE, include_admin: bool = False, prefix: str = "/admin", **filters: str | None) -> DataFrame:
    """The exact tier with the facts' attributes under the filters: event, path, country,
    city, device, browser, referrer, session_id and query (free text)."""
    b = facts.select("event_id", "device_type", "browser", "os", "is_bot", "page_path")
    rows = raw.where((F.col("site_id") == site) & C.range_filter(F.col("event_time"), start, end)).join(b, "event_id", "left")
    rows = rows.where(C.exclude_loopback(F.col("page_url"), F.col("target_url"), F.col("referrer"), F.col("ip_address")))
    exact = {"event": "event_name", "country": "country", "city": "city", "device": "device_type", "browser": "browser", "session_id": "session_id"}
    for name, column in exact.items():
        rows = rows.where(C.exact_filter(F.col(column), filters.get(name)))
    both = F.concat(F.coalesce("page_url", F.lit("")), F.lit(" "), F.coalesce("target_url", F.lit("")))
    rows = rows.where(C.contains_filter(both, filters.get("path")) & C.contains_filter(F.coalesce("referrer", F.lit("")), filters.get("referrer")))
    if not include_admin and prefix:
        rows = rows.where(C.exclude_admin_prefix(F.col("page_path"), prefix, "lower", F.col("page_url")))
    text = ["event_name", "page_url", "target_url", "referrer", "session_id", "anon_id", "ip_address", "country", "region", "city", "device_type", "browser", "os"]
    return rows.where(C.free_text_filter([F.col(c) for c in text], filters.get("query")))


def visitor_page_items(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", "event_name", "event_time", "server_time", "session_id", "anon_id", "page_url", "target_url", "referrer", "user_agent", "ip_address", "country", "region",
        "city", "latitude", "longitude", "properties", "device_type", "browser", "os", "is_bot",
    )


def visitor_page(raw: DataFrame, facts: DataFrame, start: str, end: str, page: int = 0, size: int = 50, **filters) -> DataFrame:
    """One page, newest first."""
    page, size = max(0, page), max(1, min(200, size))
    rows = visitor_page_items(visitor_rows(raw, facts, start, end, **filters))
    return rows.orderBy(F.desc("event_time"), "event_id").offset(page * size).limit(size)


def visitor_query_summary(raw: DataFrame, facts: DataFrame, start: str, end: str, size: int = 50, **filters) -> DataFrame:
    def text(c: str):
        return F.nullif(F.col(c), F.lit(""))

    rows = visitor_rows(raw, facts, start, end, **filters)
    out = rows.agg(
        F.count("*").alias("total_events"), F.count_distinct(F.coalesce(text("session_id"), text("anon_id"), text("ip_address"))).alias("unique_visitors"),
        F.count_distinct(text("country")).alias("countries"), F.count_distinct(text("city")).alias("cities"),
    )
    return out.withColumn("total_pages", F.ceil(F.col("total_events") / size))


# ---------------------------------------------------------------- backfill and writes


def backfill_rollups(logs: DataFrame, clicks: DataFrame, now: str, salt: str = enrich.SALT) -> DataFrame:
    """Both legacy tables -> rollups. Computed anew each time, so a rerun adds nothing."""
    raw = events.read_visitor_logs(logs).unionByName(events.read_visitor_clicks(clicks), allowMissingColumns=True)
    return rollups.rollup_events(enrich.enrich_events(raw, now, salt))


def append_absent(rows: DataFrame, path: str, key: str = "event_id") -> None:
    """Append rows whose key the table at ``path`` does not have yet."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    try:
        old = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    else:
        rows = rows.join(old.select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def write_raw_tier(raw: DataFrame, path: str) -> None:
    append_absent(enrich.raw_tier(raw), path)


def write_facts(enriched: DataFrame, path: str) -> None:
    append_absent(enrich.facts(enriched), path)


def write_legacy_log(enriched: DataFrame, path: str) -> None:
    append_absent(enrich.legacy_log(enriched), path)


def write_dlq(rejected: DataFrame, path: str, batch_id: int) -> None:
    """Rejected records of a batch, replacing what an earlier try of it has written."""
    enrich.dlq_rows(rejected).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
