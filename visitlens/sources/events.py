"""Event sources: the shared test tables as raw events, JSON records, Kafka, and the two
legacy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import filled

SITE = "site-main"
GEO_SCHEMA = "struct<country:string,region:string,city:string,lat:double,lng:double,src:string>"
EVENT_SCHEMA = (
    "eventId string, siteId string, eventType string, eventTime timestamp_ntz, serverTime timestamp_ntz, sessionId string, anonId string, "
    f"pageUrl string, targetUrl string, referrer string, uaRaw string, ipRaw string, ipHash string, geoHint {GEO_SCHEMA}, "
    "schemaVersion int, consentState string, properties map<string,string>"
)
USER_AGENTS = (
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1 Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) AppleWebKit/605.1 Version/16.0 Safari/604.1",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "",
)
PAGES = ("/", "/cv", "/resume", "/contact", "/admin/visitors", "/work-single/1?ref=x", "/work-single/2#top", "/blog-single/3", "/life-blog/4")
REFERRERS = (None, "https://www.google.com/search?q=x", "https://github.com/a/b", "linkedin.com", "https://news.example.org/x")
CLICKS = ("click", "outbound_link_clicked", "recommendation_click", "project_open")
READS = ("content_open", "read_progress", "engaged_time")
SIGNUPS = ("subscribe_started", "subscribe_verified")
OFFERS = ("recommendation_impression", "recommendation_dismiss", "search_result_clicked")


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared ``events``, with customers and nations, as raw visitor events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")  # 25 rows
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    rows = events.join(customers, F.col("user_id") == F.col("c_custkey"), "left").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.withColumn("k", k)
    u, k, text, kind = F.col("user_id"), F.col("k"), F.col("user_id").cast("string"), F.col("event_type")
    day = F.dayofmonth("ts")
    part = F.when(day <= 10, "a").when(day <= 20, "b").otherwise("c")
    event_type = (
        F.when(kind == "view", "page_view").when(kind == "click", _pick(CLICKS, k % 4)).when(kind == "error", _pick(READS, k % 3))
        .when(kind == "signup", _pick(SIGNUPS, k % 2)).otherwise(_pick(OFFERS, k % 3))
    )
    region = F.when(u % 7 != 0, F.col("c_mktsegment"))
    city = F.when((u % 7 != 0) & (u % 3 != 0), F.concat(F.lit("city"), (u % 4).cast("string")))
    properties = F.create_map(
        F.lit("contentId"), F.concat(F.lit("c"), (k % 12).cast("string")), F.lit("contentType"), F.when(k % 2 == 0, "PROJECT").otherwise("BLOG"),
        F.lit("progressPercent"), ((k % 5) * 25).cast("string"), F.lit("engagedSeconds"), k.cast("string"),
    )
    return rows.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.lit(SITE).alias("site_id"), event_type.alias("event_type"),
        F.col("ts").cast("timestamp_ntz").alias("event_time"), F.col("ts").cast("timestamp_ntz").alias("server_time"),
        F.when(k % 10 != 0, F.concat(F.lit("s"), text, F.lit("-"), part)).alias("session_id"), F.when(k % 20 != 0, F.concat(F.lit("a"), text)).alias("anon_id"),
        F.concat(F.lit("https://site.example"), _pick(PAGES, k % 9)).alias("page_url"),
        F.when(kind == "click", F.concat(F.lit("/work-single/"), (k % 3).cast("string"))).alias("target_url"),
        _pick(REFERRERS, u % 5).alias("referrer"), _pick(USER_AGENTS, u % 6).alias("ua_raw"),
        F.concat(F.lit("10.0."), (u % 256).cast("string"), F.lit("."), (k % 2).cast("string")).alias("ip_raw"), F.lit(None).cast("string").alias("ip_hash"),
        F.struct(
            F.col("n_name").alias("country"), region.alias("region"), city.alias("city"),
            (F.col("n_nationkey") * 6.5 - 77.7).alias("lat"), (F.col("n_nationkey") * 13.1 - 160.3).alias("lng"),
        ).alias("geo_hint"),
        F.lit(1).alias("schema_version"), F.lit("unknown").alias("consent_state"), properties.alias("properties"),
    )


def event_json(raw: DataFrame) -> DataFrame:
    """Raw events as the JSON records of the wire, with their place in the topic."""
    names = {
        "eventId": "event_id", "siteId": "site_id", "eventType": "event_type", "eventTime": "event_time", "serverTime": "server_time",
        "sessionId": "session_id", "anonId": "anon_id", "pageUrl": "page_url", "targetUrl": "target_url", "referrer": "referrer", "uaRaw": "ua_raw",
        "ipRaw": "ip_raw", "ipHash": "ip_hash", "geoHint": "geo_hint", "schemaVersion": "schema_version", "consentState": "consent_state", "properties": "properties",
    }
    value = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()]))
    return raw.select(F.col("event_id").alias("key"), value.alias("value"), F.lit("raw-events").alias("topic"), F.lit(0).alias("partition"), F.regexp_extract("event_id", r"\d+", 0).cast("long").alias("offset"))


def parse_raw_events(records: DataFrame) -> DataFrame:
    """JSON records -> typed events and ``error`` (null if the record is well formed)."""
    parsed = F.from_json("value", f"{EVENT_SCHEMA}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = records.withColumn("e", parsed)
    error = F.when(F.col("value").isNull() | (F.trim("value") == ""), "empty payload").when(F.col("e").isNull() | F.col("e._bad").isNotNull(), "malformed JSON")
    place = [c for c in ("topic", "partition", "offset", "value") if c in records.columns]
    return rows.select(
        *place, error.alias("error"), F.col("e.eventId").alias("event_id"), F.col("e.siteId").alias("site_id"), F.col("e.eventType").alias("event_type"),
        F.col("e.eventTime").alias("event_time"), F.col("e.serverTime").alias("server_time"), F.col("e.sessionId").alias("session_id"), F.col("e.anonId").alias("anon_id"),
        F.col("e.pageUrl").alias("page_url"), F.col("e.targetUrl").alias("target_url"), F.col("e.referrer").alias("referrer"), F.col("e.uaRaw").alias("ua_raw"),
        F.col("e.ipRaw").alias("ip_raw"), F.col("e.ipHash").alias("ip_hash"), F.col("e.geoHint").alias("geo_hint"), F.col("e.schemaVersion").alias("schema_version"),
        F.col("e.consentState").alias("consent_state"), F.col("e.properties").alias("properties"),
    )


def read_raw_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The event topic as a stream; ``format=json`` with a ``path`` stands in for it."""
    options = dict(options)
    if options.pop("format", "kafka") == "json":
        reader = spark.readStream.schema("value string, topic string, partition int, offset long")
        return reader.options(**{k: v for k, v in options.items() if k != "path"}).json(options["path"])
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string"), "topic", "partition", "offset")


# ---------------------------------------------------------------- legacy tables


def _legacy(rows: DataFrame, prefix: str, event_type: Column, site_id: str, target: Column) -> DataFrame:
    """Event time is local_time, else created_at; rows with neither are left out; texts
    are trimmed and empty ones null; the hint is null if all of its parts are."""

    def text(c: str) -> Column:
        return filled(F.trim(c))

    parts = [text("country"), text("region"), text("city"), F.col("latitude"), F.col("longitude")]
    hint = F.when(F.coalesce(*[p.cast("string") for p in parts]).isNotNull(), F.struct(*[p.alias(n) for p, n in zip(parts, ("country", "region", "city", "lat", "lng"))]))
    null = F.lit(None).cast("string")
    when = F.coalesce("local_time", "created_at")
    return rows.where(when.isNotNull()).select(
        F.concat(F.lit(prefix), F.col("id").cast("string")).alias("event_id"), F.lit(site_id).alias("site_id"), event_type.alias("event_type"),
        when.alias("event_time"), F.coalesce("created_at", when).alias("server_time"), null.alias("session_id"), null.alias("anon_id"), null.alias("page_url"),
        target.alias("target_url"), null.alias("referrer"), text("ua").alias("ua_raw"), text("ip").alias("ip_raw"), null.alias("ip_hash"), hint.alias("geo_hint"),
        F.lit(1).alias("schema_version"), F.lit("unknown").alias("consent_state"), F.create_map().cast("map<string,string>").alias("properties"),
    )


def read_visitor_logs(rows: DataFrame, site_id: str = SITE) -> DataFrame:
    return _legacy(rows, "vl:", F.lit("page_view"), site_id, F.lit(None).cast("string"))


def read_visitor_clicks(rows: DataFrame, site_id: str = SITE) -> DataFrame:
    return _legacy(rows, "vc:", F.lit("click"), site_id, filled(F.trim("target_url")))


def legacy_log_to_event_json(logs: DataFrame, now: str, site_id: str = SITE) -> DataFrame:
    """New legacy rows as JSON payloads without null fields; rows that already have an
    event id came from the topic and are skipped."""

    def text(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    clock = F.expr(f"timestamp_ntz '{now}'")
    hint = F.struct(
        text("country").alias("country"), text("region").alias("region"), text("city").alias("city"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"), F.lit("first-party-track").alias("source"),
    )
    stable = F.concat(F.lit("vl:"), F.col("id").cast("string"))
    payload = F.struct(
        stable.alias("eventId"), F.lit(site_id).alias("siteId"), F.coalesce(text("event"), F.lit("page_view")).alias("eventType"),
        F.coalesce("local_time", "created_at", clock).alias("eventTime"), F.coalesce("created_at", clock).alias("serverTime"), text("ua").alias("uaRaw"),
        text("ip").alias("ipRaw"), hint.alias("geoHint"), F.lit(1).alias("schemaVersion"), F.lit("unknown").alias("consentState"),
        F.create_map().cast("map<string,string>").alias("properties"),
    )
    return logs.where("event_id is null").select(stable.alias("event_id"), F.lit(site_id).alias("partition_key"), F.to_json(payload).alias("payload"))


def legacy_logs(spark: SparkSession, sf_dir: str, clicks: bool = False) -> DataFrame:
    """Legacy tables derived from the shared events: page views, or clicks."""
    raw = raw_events(spark, sf_dir).where(F.col("event_type").isin("click") if clicks else F.col("event_type") == "page_view")
    n = F.regexp_extract("event_id", r"\d+", 0).cast("long")
    rows = raw.select(
        n.alias("id"), F.when(n % 11 != 0, F.concat(F.lit("k:"), n.cast("string"))).alias("event_id"),
        F.when(n % 13 != 0, F.col("event_time")).alias("local_time"), F.when(n % 26 != 0, F.col("server_time")).alias("created_at"),
        F.when(n % 5 == 0, "").otherwise("page_view").alias("event"), F.concat(F.lit(" "), F.col("ua_raw")).alias("ua"), F.col("ip_raw").alias("ip"),
        F.col("geo_hint.country").alias("country"), F.coalesce("geo_hint.region", F.lit("")).alias("region"), F.col("geo_hint.city").alias("city"),
        F.col("geo_hint.lat").alias("latitude"), F.col("geo_hint.lng").alias("longitude"), "target_url",
    )
    return rows
