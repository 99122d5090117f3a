"""All queries of the visitor-analytics part by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, enrich, read_models, rollups
from ..scratch import Scratch
from ..sources import events
from . import tables as T
from .sql import NOW, SINCE, with_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *needs: str, recursive: bool = False) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = with_parts(sql, *needs, recursive=recursive)


# ---------------------------------------------------------------- ingestion

ENRICHED = (
    "event_id", "site_id", "event_type", "event_time", "server_time", "session_id", "anon_id", "page_url", "target_url", "referrer", "device_type", "browser", "os", "is_bot",
    "bot_score", "ip_hash", "geo_level", "geo_area_id", "country", "region", "metro",
)
query("enrich_events", lambda s, d: T.enriched(s, d).select(*ENRICHED), f"select {', '.join(ENRICHED)} from enriched", "enriched")
FACTS = (
    "event_id", "site_id", "event_name", "event_time", "session_id", "anon_id_hash", "page_path", "target_path", "referrer_domain", "device_type", "browser", "os", "is_bot", "ip_hash",
    "country", "region", "geo_area_id",
)
query(
    "facts",
    lambda s, d: T.facts(s, d).select(*FACTS, F.col("properties")["contentId"].alias("content_id"), F.col("properties")["engagedSeconds"].alias("engaged")),
    f"select {', '.join(FACTS)}, content_id, seconds::varchar as engaged from facts",
    "facts",
)


def _with_bad(s: SparkSession, d: str) -> DataFrame:
    """The JSON records, with every 37th cut short and every 41st without its event type."""
    records = events.event_json(T.raw(s, d))
    n = F.col("offset")
    value = F.when(n % 37 == 0, F.substring("value", 1, 40)).when(n % 41 == 0, F.regexp_replace("value", '"eventType":"[a-z_]+",', "")).otherwise(F.col("value"))
    return events.parse_raw_events(records.withColumn("value", value))


query(
    "parse_raw_events",
    lambda s, d: _with_bad(s, d).select("offset", "event_id", "event_type", "error"),
    """select number as "offset", case when number % 37 <> 0 then event_id end as event_id, case when number % 37 <> 0 and number % 41 <> 0 then event_type end as event_type,
       case when number % 37 = 0 then 'malformed JSON' end as error from raw""",
    "raw",
)
query(
    "split_valid_dlq",
    lambda s, d: enrich.dlq_rows(enrich.split_valid_dlq(_with_bad(s, d))[1]).select("reason"),
    """select case when number % 37 = 0 then 'malformed JSON' else 'missing required field' end || ' at raw-events-0@' || number as reason from raw
       where number % 37 = 0 or number % 41 = 0""",
    "raw",
)
query(
    "raw_tier",
    lambda s, d: enrich.raw_tier(T.raw(s, d)).select("event_id", "event_name", "page_url", "user_agent", "ip_address", "country", "region", "city", "latitude", "longitude"),
    """select event_id, event_type as event_name, page_url, ua_raw as user_agent, ip_raw as ip_address, hint_country as country, hint_region as region, hint_city as city,
       lat as latitude, lng as longitude from raw""",
    "raw",
)
query(
    "legacy_log",
    lambda s, d: enrich.legacy_log(T.enriched(s, d)).select("event_id", "ip", "local_time", "event", "ua", "country", "region"),
    """select event_id, ip_hash as ip, event_time as local_time, event_type as event, 'device=' || device_type || ';browser=' || browser || ';os=' || os as ua, country, region
       from enriched""",
    "enriched",
)
query(
    "operation_timeline",
    lambda s, d: enrich.operation_timeline(T.enriched(s, d), T.NOW).select(
        "operation_id", "correlation_id", "idempotency_key", F.col("attributes")["geoLevel"].alias("geo_level"), F.col("attributes")["sessionId"].alias("session")
    ),
    """select sha256('analytics:' || event_id) as operation_id, coalesce(session_id, event_id) as correlation_id, 'analytics:' || event_id as idempotency_key, geo_level,
       coalesce(session_id, '') as session from enriched""",
    "enriched",
)


def _repeated(s: SparkSession, d: str) -> DataFrame:
    """Enriched events, every seventh of which arrives again an hour later."""
    rows = T.enriched(s, d)
    n = F.regexp_extract("event_id", r"\d+", 0).cast("long")
    later = F.col("server_time") + F.expr("interval 1 hour")
    return rows.unionByName(rows.where(n % 7 == 0).withColumn("server_time", later))


query(
    "dedup_inbox",
    lambda s, d: dedup.dedup_inbox(_repeated(s, d)).select("event_id", "server_time"),
    "select event_id, server_time from enriched",
    "enriched",
)
def _redelivered(s: SparkSession, d: str) -> DataFrame:
    """``_repeated``, with every fifth event delivered twice as it is."""
    rows = _repeated(s, d).withColumn("event_time", F.col("server_time"))
    return rows.unionByName(rows.where(F.regexp_extract("event_id", r"\d+", 0).cast("long") % 5 == 0))


query(
    "dedup_ttl",
    lambda s, d: dedup.dedup_ttl(_redelivered(s, d).select("event_id", "event_time", "server_time"), 1800).select("event_id", "server_time"),
    "select event_id, server_time from enriched union all select event_id, server_time + interval 1 hour from enriched where number % 7 = 0",
    "enriched",
)
query(
    "throttle_visits",
    lambda s, d: dedup.throttle_visits(T.enriched(s, d), 86_400).select("event_id", "event_type"),
    """, v as (select event_id, event_type, event_time as t, row_number() over (partition by site_id, coalesce(session_id, anon_id, ip_hash || ':' || device_type), page_url
                order by event_time, server_time, event_id) as nth, site_id || '|' || coalesce(session_id, anon_id, ip_hash || ':' || device_type) || '|' || page_url as key
              from enriched where event_type = 'page_view'),
       f as (select event_id, event_type, key, nth, t as last, true as kept from v where nth = 1
             union all select v.event_id, v.event_type, v.key, v.nth, case when v.t >= f.last + interval 1 day then v.t else f.last end, v.t >= f.last + interval 1 day
             from f join v on v.key = f.key and v.nth = f.nth + 1)
       select event_id, event_type from f where kept union all select event_id, event_type from enriched where event_type <> 'page_view'""",
    "enriched",
    recursive=True,
)

# ---------------------------------------------------------------- rollups and geography



def stored_enriched(s: SparkSession, d: str) -> DataFrame:
    """What rollups need of the enriched events as a stored table, for what reads it more than once."""
    needed = ("event_id", "site_id", "event_type", "event_time", "server_time", "session_id", "anon_id", "ip_hash", "device_type", "browser", "os", "is_bot", *rollups.GEO)
    return Scratch(s).store(T.enriched(s, d).select(*needed), "enriched")


query("rollup_events", lambda s, d: rollups.rollup_events(stored_enriched(s, d)), "select * from rollups", "rollups")
query(
    "unique_sessions_exact",
    lambda s, d: rollups.unique_sessions_exact(T.enriched(s, d)).groupBy(*rollups.LEDGER).agg(F.sum("unique_sessions").alias("unique_sessions")),
    f"select {', '.join(rollups.LEDGER)}, sum(unique_sessions)::bigint as unique_sessions from rollups group by all",
    "rollups",
)
query("unique_sessions_approx", lambda s, d: rollups.unique_sessions_approx(T.enriched(s, d)))


def _approx_bound(s: SparkSession, d: str) -> DataFrame:
    """For each key the exact sessions, and whether the sketch is within a tenth of them."""
    kept = stored_enriched(s, d)
    near = rollups.unique_sessions_approx(kept).withColumnRenamed("unique_sessions", "near")
    exact = rollups.unique_sessions_exact(kept).groupBy(*rollups.LEDGER).agg(F.sum("unique_sessions").alias("unique_sessions"))
    within = F.abs(F.col("near") - F.col("unique_sessions")) <= F.greatest(F.lit(1.0), F.col("unique_sessions") * 0.1)
    return near.join(exact, list(rollups.LEDGER), "full").select(*rollups.LEDGER, "unique_sessions", F.coalesce(within, F.lit(False)).alias("within"))


query(
    "unique_sessions_approx_bound",
    _approx_bound,
    f"select {', '.join(rollups.LEDGER)}, sum(unique_sessions)::bigint as unique_sessions, true as within from rollups group by all",
    "rollups",
)
def _days_from_sketches(s: SparkSession, d: str) -> DataFrame:
    """Days from stored sketches of 5 minutes, against the exact sessions of the days."""
    near = rollups.estimated_sessions(rollups.sketches_by_day(rollups.session_sketches(T.enriched(s, d)))).withColumnRenamed("unique_sessions", "near")
    exact = rollups.session_claims(T.enriched(s, d), ("1d",)).groupBy(*rollups.LEDGER).agg(F.count("*").alias("unique_sessions"))
    within = F.abs(F.col("near") - F.col("unique_sessions")) <= F.greatest(F.lit(1.0), F.col("unique_sessions") * 0.1)
    return near.join(exact, list(rollups.LEDGER), "full").select(*rollups.LEDGER, "unique_sessions", F.coalesce(within, F.lit(False)).alias("within"))


query(
    "unique_sessions_days_from_sketches",
    _days_from_sketches,
    f"select {', '.join(rollups.LEDGER)}, sum(unique_sessions)::bigint as unique_sessions, true as within from rollups where granularity = '1d' group by all",
    "rollups",
)
query(
    "rollup_1d_from_5m",
    lambda s, d: rollups.rollup_1d_from_5m(rollups.event_rollups(T.enriched(s, d), "5m")),
    f"select {', '.join(rollups.KEY)}, event_count from rollups where granularity = '1d'",
    "rollups",
)


def _merged(s: SparkSession, d: str) -> DataFrame:
    half = rollups.event_rollups(T.enriched(s, d), "1d").withColumn("unique_sessions", F.lit(1))
    return rollups.merge_rollups(half, half)


query(
    "merge_rollups",
    _merged,
    f"select {', '.join(rollups.KEY)}, 2 * event_count as event_count, 2::bigint as unique_sessions from rollups where granularity = '1d'",
    "rollups",
)
query("geo_area_chain", lambda s, d: rollups.geo_area_chain(T.raw(s, d)), "select geo_area_id, geo_level, parent_id, name, country, region from areas", "areas")
query("geo_centroid", lambda s, d: T.areas(s, d), "select * from areas", "areas")

# ---------------------------------------------------------------- dashboard

query(
    "summary_totals",
    lambda s, d: read_models.summary_totals(T.day_rollups(s, d), T.NOW),
    f"""select coalesce(sum(event_count), 0)::bigint as events, coalesce(sum(event_count) filter (where event_type = 'click'), 0)::bigint as clicks,
        coalesce(sum(event_count) filter (where event_type = 'page_view'), 0)::bigint as page_views
        from rollups where granularity = '1d' and geo_level = 'GLOBAL' and bucket_time >= {SINCE}""",
    "rollups",
)
query(
    "summary_totals_all_levels",
    lambda s, d: read_models.summary_totals(T.day_rollups(s, d, None), T.NOW, window="7d", level=None),
    f"""select coalesce(sum(event_count), 0)::bigint as events, coalesce(sum(event_count) filter (where event_type = 'click'), 0)::bigint as clicks,
        coalesce(sum(event_count) filter (where event_type = 'page_view'), 0)::bigint as page_views
        from rollups where granularity = '1d' and bucket_time >= {NOW} - interval 7 day""",
    "rollups",
)
query(
    "unique_visitors",
    lambda s, d: read_models.unique_visitors(T.facts(s, d), T.NOW),
    f"""select count(distinct coalesce('anon:' || anon_id_hash, 'session:' || session_id, 'ip:' || ip_hash))::bigint as unique_visitors from facts
        where event_name = 'page_view' and not is_bot and page_path <> '/admin' and page_path not like '/admin/%' and event_time >= {SINCE}""",
    "facts",
)
_TOP = f"from rollups where granularity = '1d' and geo_level = 'GLOBAL' and event_type = 'page_view' and bucket_time >= {SINCE}"
query(
    "top_countries",
    lambda s, d: read_models.top_countries(T.day_rollups(s, d), T.NOW),
    f"select country, sum(event_count)::bigint as count {_TOP} and country <> '' group by country order by count desc, country limit 20",
    "rollups",
)
query(
    "top_devices", lambda s, d: read_models.top_devices(T.day_rollups(s, d), T.NOW), f"select device_type, sum(event_count)::bigint as count {_TOP} group by device_type", "rollups"
)
query(
    "daily_series", lambda s, d: read_models.daily_series(T.day_rollups(s, d), T.NOW), f"select bucket_time, sum(event_count)::bigint as count {_TOP} group by bucket_time", "rollups"
)
query(
    "geo_markers",
    lambda s, d: read_models.geo_markers(T.day_rollups(s, d, None), T.areas(s, d), T.NOW, level="local", box=(-40.0, 60.0, 100.0, -20.0)),
    f"""select r.geo_area_id, r.geo_level, r.country, coalesce(a.name, r.country) as name, a.region, a.center_lat as lat, a.center_lng as lng, sum(event_count)::bigint as count
        from rollups r join areas a on a.geo_area_id = r.geo_area_id
        where r.granularity = '1d' and r.event_type = 'page_view' and r.geo_level = 'METRO' and r.bucket_time >= {SINCE} and a.center_lat between -40 and 60
          and (a.center_lng >= 100 or a.center_lng <= -20) group by all order by count desc, r.geo_area_id, r.country limit 6000""",
    "rollups", "areas",
)
query(
    "top_pages",
    lambda s, d: read_models.top_pages(T.facts(s, d), T.NOW),
    f"""select page_path as page, count(*)::bigint as views, count(distinct session_id)::bigint as unique_sessions from facts
        where event_name in ('page_view', 'content_open') and not is_bot and event_time >= {SINCE} group by 1 having count(*) >= 5 order by 2 desc, 1 limit 25""",
    "facts",
)
query(
    "referrers",
    lambda s, d: read_models.referrers(T.facts(s, d), T.NOW),
    f"""select referrer_domain as referrer, count(*)::bigint as count, count(distinct session_id)::bigint as unique_sessions from facts
        where event_name = 'page_view' and not is_bot and referrer_domain <> '' and event_time >= {SINCE} group by 1 having count(*) >= 5 order by 2 desc, 1 limit 25""",
    "facts",
)
query(
    "engagement",
    lambda s, d: read_models.engagement(T.facts(s, d), T.NOW),
    f"""select content_sessions, completed_sessions, engaged_seconds, coalesce(completed_sessions / nullif(content_sessions, 0), 0)::double as completion_rate from (
        select count(distinct session_id) filter (where event_name in ('content_open', 'read_progress'))::bigint as content_sessions,
        count(distinct session_id) filter (where event_name = 'read_progress' and progress = 100)::bigint as completed_sessions,
        coalesce(sum(seconds) filter (where event_name = 'engaged_time'), 0)::bigint as engaged_seconds from facts where not is_bot and event_time >= {SINCE})""",
    "facts",
)
_OFFERS = "count(*) filter (where event_name = 'recommendation_{0}')::bigint"
query(
    "recommendation_totals",
    lambda s, d: read_models.recommendation_totals(T.facts(s, d), T.NOW),
    f"""select impressions, clicks, dismissals, coalesce(clicks / nullif(impressions, 0), 0)::double as click_through_rate from (
        select {_OFFERS.format('impression')} as impressions, {_OFFERS.format('click')} as clicks, {_OFFERS.format('dismiss')} as dismissals
        from facts where not is_bot and event_time >= {SINCE})""",
    "facts",
)
query(
    "recommendation_items",
    lambda s, d: read_models.recommendation_items(T.facts(s, d), T.NOW),
    f"""select content_id, {_OFFERS.format('impression')} as impressions, {_OFFERS.format('click')} as clicks from facts
        where not is_bot and event_name like 'recommendation_%' and event_time >= {SINCE} group by 1 having impressions >= 5 order by clicks desc, content_id limit 25""",
    "facts",
)
query("build_sessions", lambda s, d: T.sessions(s, d), "select * from sessions", "sessions")


def in_batches(rows: DataFrame, parts: Callable[[DataFrame], DataFrame], n: int = 3) -> DataFrame:
    """Parts of ``n`` batches of the events, as ingestion leaves them."""
    number = F.regexp_extract("event_id", r"\d+", 0).cast("long") % n
    out = None
    for k in range(n):
        some = parts(rows.where(number == k)).withColumn("as_of", F.lit(k).cast("long"))
        out = some if out is None else out.unionByName(some)
    return out


query(
    "merge_session_parts",
    lambda s, d: read_models.sessions_of(read_models.merge_session_parts(in_batches(T.facts(s, d), read_models.session_parts))),
    "select * from sessions",
    "sessions",
)
query(
    "session_stats",
    lambda s, d: read_models.session_stats(T.sessions(s, d), T.NOW),
    f"""select count(*)::bigint as total_sessions, coalesce(round(avg(duration_ms), 3), 0)::double as avg_duration_ms,
        coalesce(round(avg(case when page_views <= 1 then 1.0::double else 0.0::double end), 9), 0)::double as bounce_rate from sessions where first_event >= {SINCE}""",
    "sessions",
)
query(
    "top_entry_pages",
    lambda s, d: read_models.top_entry_pages(T.sessions(s, d), T.NOW),
    f"select entry_page as page, count(*)::bigint as count from sessions where first_event >= {SINCE} and entry_page is not null group by 1 order by 2 desc, 1 limit 10",
    "sessions",
)
query("funnel_steps", lambda s, d: T.funnel(s, d), "select * from funnel", "funnel")
query(
    "ordered_funnel",
    lambda s, d: read_models.ordered_funnel(T.funnel(s, d), T.NOW),
    f""", f as (select session_id, step_name, step_order, min(event_time) as t from funnel where event_time >= {SINCE} group by all)
        select c.step_name as step, c.step_order, count(distinct c.session_id)::bigint as sessions from f c
        where (select count(*) from f p where p.session_id = c.session_id and p.step_order < c.step_order and p.t <= c.t) = c.step_order - 1
        group by all having sessions >= 5""",
    "funnel",
)
