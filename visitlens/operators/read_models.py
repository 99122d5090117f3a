"""Dashboard queries over rollups, facts, sessions and funnel steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.events import SITE

FUNNEL = ("content_open", "read_progress", "subscribe_started", "subscribe_verified")
MARKER_LIMITS = {None: 6000, "COUNTRY": 300, "REGION": 1500, "METRO": 6000}
MARKER_CEILING = 10_000


def _rollups(rollups: DataFrame, site: str, window, now: str, level: str | None, event: str | None = "page_view") -> DataFrame:
    rows = rollups.where((F.col("site_id") == site) & (F.col("granularity") == "1d") & C.time_window_filter(F.col("bucket_time"), window, now))
    if level is not None:
        rows = rows.where(F.col("geo_level") == level)
    return rows if event is None else rows.where(F.col("event_type") == event)


def _facts(facts: DataFrame, site: str, window, now: str) -> DataFrame:
    return facts.where((F.col("site_id") == site) & ~F.col("is_bot") & C.time_window_filter(F.col("event_time"), window, now))


def summary_totals(rollups: DataFrame, now: str, site: str = SITE, window: str | None = None, level: str | None = "GLOBAL") -> DataFrame:
    """Events, clicks and page views. Every level holds all events; ``level=None`` adds
    them all up."""
    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("event_count"))), F.lit(0))

    rows = _rollups(rollups, site, window, now, level, None)
    return rows.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"), of("click").alias("clicks"), of("page_view").alias("page_views"))


def unique_visitors(facts: DataFrame, now: str, site: str = SITE, window: str | None = None) -> DataFrame:
    def tagged(tag: str, c: str):
        return F.concat(F.lit(tag), F.nullif(F.col(c), F.lit("")))

    rows = _facts(facts, site, window, now).where((F.col("event_name") == "page_view") & C.exclude_admin_prefix(F.col("page_path")))
    return rows.agg(F.count_distinct(F.coalesce(tagged("anon:", "anon_id_hash"), tagged("session:", "session_id"), tagged("ip:", "ip_hash"))).alias("unique_visitors"))


def top_countries(rollups: DataFrame, now: str, site: str = SITE, window: str | None = None, level: str | None = "GLOBAL", limit: int = 20) -> DataFrame:
    rows = _rollups(rollups, site, window, now, level).where("country <> ''")
    return rows.groupBy("country").agg(F.sum("event_count").alias("count")).orderBy(F.desc("count"), "country").limit(limit)


def top_devices(rollups: DataFrame, now: str, site: str = SITE, window: str | None = None, level: str | None = "GLOBAL") -> DataFrame:
    return _rollups(rollups, site, window, now, level).groupBy("device_type").agg(F.sum("event_count").alias("count"))


def daily_series(rollups: DataFrame, now: str, site: str = SITE, window: str | None = None, level: str | None = "GLOBAL") -> DataFrame:
    return _rollups(rollups, site, window, now, level).groupBy("bucket_time").agg(F.sum("event_count").alias("count"))


def geo_markers(rollups: DataFrame, areas: DataFrame, now: str, site: str = SITE, window: str | None = None, level: str | None = None, box=None, limit: int | None = None) -> DataFrame:
    """Page views of areas with known coordinates, in a box of the map."""
    name = C.level_name(level)
    n = max(1, min(MARKER_CEILING, limit if limit is not None else MARKER_LIMITS[name]))
    rows = _rollups(rollups, site, window, now, name)
    rows = rows.groupBy("geo_area_id", "geo_level", "country").agg(F.sum("event_count").alias("count"))
    spots = areas.select("geo_area_id", "name", "region", F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    spots = spots.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & C.bbox_filter(F.col("lat"), F.col("lng"), box, window))
    out = rows.join(spots, "geo_area_id").withColumn("name", F.coalesce("name", "country"))
    return out.select("geo_area_id", "geo_level", "country", "name", "region", "lat", "lng", "count").orderBy(F.desc("count"), "geo_area_id", "country").limit(n)


def _listed(rows: DataFrame, key: str, name: str, count: str, min_bucket: int, limit: int) -> DataFrame:
    out = rows.groupBy(F.col(key).alias(name)).agg(F.count("*").alias(count), F.count_distinct("session_id").alias("unique_sessions"))
    return out.where(C.min_bucket_filter(F.col(count), min_bucket)).orderBy(F.desc(count), name).limit(limit)


def top_pages(facts: DataFrame, now: str, site: str = SITE, window: str | None = None, min_bucket: int = 5, limit: int = 25) -> DataFrame:
    rows = _facts(facts, site, window, now).where(F.col("event_name").isin("page_view", "content_open") & F.col("page_path").isNotNull())
    return _listed(rows, "page_path", "page", "views", min_bucket, limit)


def referrers(facts: DataFrame, now: str, site: str = SITE, window: str | None = None, min_bucket: int = 5, limit: int = 25) -> DataFrame:
    rows = _facts(facts, site, window, now).where((F.col("event_name") == "page_view") & (F.col("referrer_domain") != ""))
    return _listed(rows, "referrer_domain", "referrer", "count", min_bucket, limit)


def engagement(facts: DataFrame, now: str, site: str = SITE, window: str | None = None) -> DataFrame:
    event, props = F.col("event_name"), F.col("properties")
    seconds = props["engagedSeconds"]
    out = _facts(facts, site, window, now).agg(
        F.count_distinct(F.when(event.isin("content_open", "read_progress"), F.col("session_id"))).alias("content_sessions"),
        F.count_distinct(F.when((event == "read_progress") & (props["progressPercent"] == "100"), F.col("session_id"))).alias("completed_sessions"),
        F.coalesce(F.sum(F.when((event == "engaged_time") & seconds.rlike("^[0-9]+$"), seconds.try_cast("bigint"))), F.lit(0)).alias("engaged_seconds"),
    )
    rate = F.coalesce(F.try_divide(F.col("completed_sessions"), F.col("content_sessions")), F.lit(0.0))
    return out.withColumn("completion_rate", rate)


def _offers(kind: str):
    return F.count_if(F.col("event_name") == f"recommendation_{kind}")


def recommendation_totals(facts: DataFrame, now: str, site: str = SITE, window: str | None = None) -> DataFrame:
    out = _facts(facts, site, window, now).agg(_offers("impression").alias("impressions"), _offers("click").alias("clicks"), _offers("dismiss").alias("dismissals"))
    return out.withColumn("click_through_rate", F.coalesce(F.try_divide(F.col("clicks"), F.col("impressions")), F.lit(0.0)))


def recommendation_items(facts: DataFrame, now: str, site: str = SITE, window: str | None = None, min_bucket: int = 5, limit: int = 25) -> DataFrame:
    kinds = [f"recommendation_{k}" for k in ("impression", "click", "dismiss")]
    rows = _facts(facts, site, window, now).where(F.col("event_name").isin(*kinds)).withColumn("content_id", F.col("properties")["contentId"]).where("content_id is not null")
    out = rows.groupBy("content_id").agg(_offers("impression").alias("impressions"), _offers("click").alias("clicks"))
    return out.where(C.min_bucket_filter(F.col("impressions"), min_bucket)).orderBy(F.desc("clicks"), "content_id").limit(limit)


def session_stats(sessions: DataFrame, now: str, site: str = SITE, window: str | None = None) -> DataFrame:
    rows = sessions.where((F.col("site_id") == site) & C.time_window_filter(F.col("first_event"), window, now))
    return rows.agg(
        F.count("*").alias("total_sessions"), F.coalesce(F.round(F.avg("duration_ms"), 3), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.round(F.avg(F.when(F.col("page_views") <= 1, 1.0).otherwise(0.0)), 9), F.lit(0.0)).alias("bounce_rate"),
    )


def top_entry_pages(sessions: DataFrame, now: str, site: str = SITE, window: str | None = None, limit: int = 10) -> DataFrame:
    rows = sessions.where((F.col("site_id") == site) & C.time_window_filter(F.col("first_event"), window, now) & F.col("entry_page").isNotNull())
    return rows.groupBy(F.col("entry_page").alias("page")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "page").limit(limit)


# ---------------------------------------------------------------- sessions and funnels


SESSION = ["site_id", "session_id"]


def session_parts(facts: DataFrame) -> DataFrame:
    """What a set of facts says about its sessions, in a form that can be merged."""
    page = F.when(F.col("page_path").isNotNull(), F.struct("event_time", "event_id", "page_path"))
    event = F.col("event_name")
    rows = facts.where("session_id is not null").withColumn("_page", page)
    return rows.groupBy(*SESSION).agg(
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), F.count_if(event == "page_view").alias("page_views"),
        F.count_if(event.isin("outbound_link_clicked", "search_result_clicked", "recommendation_click")).alias("clicks"),
        F.min("_page").alias("entry"), F.max("_page").alias("exit"), F.max("anon_id_hash").alias("anon_id"),
        F.max("device_type").alias("device_type"), F.max("browser").alias("browser"), F.max("os").alias("os"), F.max("country").alias("country"),
        F.max("geo_area_id").alias("geo_area_id"),
    )


def merge_session_parts(parts: DataFrame) -> DataFrame:
    least, sums = ("first_event", "entry"), ("page_views", "clicks")
    return parts.groupBy(*SESSION).agg(*[(F.min if c in least else F.sum if c in sums else F.max)(c).alias(c) for c in parts.columns if c not in SESSION])


def sessions_of(parts: DataFrame) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("last_event").cast("timestamp")) / 1000) - F.floor(F.unix_micros(F.col("first_event").cast("timestamp")) / 1000)
    return parts.select(
        *SESSION, "first_event", "last_event", "page_views", "clicks", F.col("entry.page_path").alias("entry_page"), F.col("exit.page_path").alias("exit_page"), "anon_id", "device_type", "browser",
        "os", "country", "geo_area_id", F.greatest(F.lit(0), ms).cast("long").alias("duration_ms"),
    )


def build_sessions(facts: DataFrame) -> DataFrame:
    """A row per site and session; ties in time go by event id."""
    return sessions_of(session_parts(facts))


def funnel_steps(enriched: DataFrame, steps: tuple[str, ...] = FUNNEL) -> DataFrame:
    """Events of the configured list, with their order in it."""
    key = C.session_key(F.col("session_id"), F.col("anon_id"), F.col("ip_hash"), F.col("device_type"))
    order = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("event_type")).cast("int")
    rows = enriched.select("event_id", key.alias("session_id"), "site_id", F.col("event_type").alias("step_name"), "page_url", F.col("event_type"), "event_time", order.alias("step_order"))
    return rows.where("session_id is not null and step_order > 0")


def ordered_funnel(steps: DataFrame, now: str, site: str = SITE, window: str | None = None, min_bucket: int = 5) -> DataFrame:
    """Sessions that reached a step with every earlier step at or before it. A session's
    first times are a small map, looked at once per step."""
    rows = steps.where((F.col("site_id") == site) & C.time_window_filter(F.col("event_time"), window, now))
    first = rows.groupBy("session_id", "step_name", "step_order").agg(F.min("event_time").alias("t"))
    by_order = first.groupBy("session_id", "step_order").agg(F.min("t").alias("earliest"), F.max("t").alias("latest"))
    times = by_order.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("step_order", "latest"))).alias("at"))
    rows = first.join(times, "session_id")
    before = F.when(F.col("step_order") > 1, F.sequence(F.lit(1), F.col("step_order") - 1)).otherwise(F.array().cast("array<int>"))
    ok = F.forall(before, lambda o: F.coalesce(F.try_element_at(F.col("at"), o) <= F.col("t"), F.lit(False)))
    out = rows.where(ok).groupBy(F.col("step_name").alias("step"), "step_order").agg(F.count_distinct("session_id").alias("sessions"))
    return out.where(C.min_bucket_filter(F.col("sessions"), min_bucket))
