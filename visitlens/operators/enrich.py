"""Enrichment of raw events and the tables kept of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

SALT = "visitlens-salt"
MISSING = "missing required field"


def split_valid_dlq(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed records -> (valid, rejected with reason)."""
    ok = C.validate_required(F.col("event_id"), F.col("event_type"), F.col("site_id"))
    reason = F.coalesce("error", F.when(~F.coalesce(ok, F.lit(False)), MISSING))
    marked = records.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason", "error"), marked.where("reason is not null")


def dlq_rows(rejected: DataFrame) -> DataFrame:
    """What the dead-letter table keeps: the record and where it came from."""
    place = F.concat(F.col("reason"), F.lit(" at "), F.col("topic"), F.lit("-"), F.col("partition").cast("string"), F.lit("@"), F.col("offset").cast("string"))
    return rejected.select("value", place.alias("reason"))


def enrich_events(raw: DataFrame, now: str, salt: str = SALT) -> DataFrame:
    """Raw events -> enriched ones: parsed user agent, bot score, keyed address hash,
    snapped area. Neither the address nor coordinates go on."""
    device = C.ua_device(F.col("ua_raw"))
    clock = F.expr(f"timestamp_ntz '{now}'")
    hint = F.col("geo_hint")
    rows = raw.withColumn("device_type", device).withColumn("bot_score", C.bot_score(F.col("device_type"), F.col("referrer")))
    geo = C.in_parts(C.geo_snap(hint["country"], hint["region"], hint["city"]))
    return rows.withColumn("geo", geo).select(
        "event_id", "site_id", "event_type", F.coalesce("event_time", clock).alias("event_time"), F.coalesce("server_time", clock).alias("server_time"),
        "session_id", "anon_id", "page_url", "target_url", "referrer", "device_type", C.in_parts(C.ua_browser(F.col("ua_raw"))).alias("browser"), C.ua_os(F.col("ua_raw")).alias("os"),
        C.is_bot(F.col("bot_score")).alias("is_bot"), "bot_score", C.ip_hash(F.col("ip_raw"), F.col("ip_hash"), salt).alias("ip_hash"),
        "geo.geo_level", "geo.geo_area_id", "geo.country", "geo.region", "geo.metro", F.coalesce("schema_version", F.lit(1)).alias("schema_version"),
        F.coalesce("consent_state", F.lit("unknown")).alias("consent_state"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
    )


def fact_session_key() -> F.Column:
    return C.session_key(F.col("session_id"), F.col("anon_id"), F.col("ip_hash"), F.col("device_type"))


def facts(enriched: DataFrame) -> DataFrame:
    """Canonical facts: paths and domains in place of URLs, allowed properties only."""
    return enriched.where(~C.blank(F.col("event_id"))).select(
        "event_id", "schema_version", "site_id", F.col("event_type").alias("event_name"), "event_time", "server_time", fact_session_key().alias("session_id"),
        F.col("anon_id").alias("anon_id_hash"), C.normalize_consent(F.col("consent_state")).alias("consent_state"), C.path_only(F.col("page_url")).alias("page_path"),
        C.path_only(F.col("target_url")).alias("target_path"), C.domain_only(F.col("referrer")).alias("referrer_domain"), "device_type", "browser", "os", "is_bot",
        "ip_hash", "country", "region", "geo_area_id", C.sanitize_properties(F.col("properties")).alias("properties"),
    )


def raw_tier(raw: DataFrame) -> DataFrame:
    """The exact private tier: URLs cut to 2048 characters, user agents to 1024."""
    def cut(c: str, n: int = 2048):
        return F.substring(F.col(c), 1, n)

    return raw.where(~C.blank(F.col("event_id"))).select(
        "event_id", F.coalesce("schema_version", F.lit(1)).alias("schema_version"), "site_id", F.col("event_type").alias("event_name"), "event_time", "server_time",
        "session_id", "anon_id", cut("page_url").alias("page_url"), cut("target_url").alias("target_url"), cut("referrer").alias("referrer"),
        cut("ua_raw", 1024).alias("user_agent"), F.col("ip_raw").alias("ip_address"), F.col("geo_hint.country").alias("country"), F.col("geo_hint.region").alias("region"),
        F.col("geo_hint.city").alias("city"), F.col("geo_hint.lat").alias("latitude"), F.col("geo_hint.lng").alias("longitude"),
        C.sanitize_properties(F.col("properties")).alias("properties"), F.col("server_time").alias("created_at"),
    )


def legacy_log(enriched: DataFrame) -> DataFrame:
    """Compatibility rows of the legacy log: no address, city or coordinates."""
    agent = F.concat(F.lit("device="), "device_type", F.lit(";browser="), "browser", F.lit(";os="), "os")
    null, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    return enriched.select(
        "event_id", F.coalesce("ip_hash", F.lit("")).alias("ip"), F.col("event_time").alias("local_time"), F.col("event_type").alias("event"), agent.alias("ua"),
        "country", "region", null.alias("city"), none.alias("latitude"), none.alias("longitude"), F.col("server_time").alias("created_at"),
    )


def operation_timeline(enriched: DataFrame, now: str) -> DataFrame:
    """An operations record per event; its id follows from the idempotency key."""
    key = F.concat(F.lit("analytics:"), "event_id")

    def pairs(**kv) -> F.Column:
        return F.create_map(*[x if isinstance(x, F.Column) else F.lit(x) for p in kv.items() for x in p])

    def text(c: str) -> F.Column:
        return F.coalesce(F.col(c), F.lit(""))

    return enriched.select(
        F.sha2(key, 256).alias("operation_id"), F.lit("analytics.ingestion.completed").alias("type"), F.expr(f"timestamp_ntz '{now}'").alias("occurred_at"),
        F.coalesce(C.filled(F.col("session_id")), F.col("event_id")).alias("correlation_id"), F.col("event_id").alias("causation_id"), key.alias("idempotency_key"),
        pairs(type="service", id="aggregator").alias("actor"), pairs(type="visitor_event", id=F.col("event_id")).alias("subject"), F.lit("completed").alias("status"),
        pairs(sessionId=text("session_id"), eventType=text("event_type"), siteId=text("site_id"), geoLevel=F.coalesce("geo_level", F.lit("unknown"))).alias("attributes"),
    )
