"""Registration of queries that apply the column rules, predicates and rule-table operators
to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import alerts, enrich, journeys, maintenance
from . import tables as T
from .registry import query
from .sql import END, NOW, START, part


def _number() -> Column:
    return F.regexp_extract("event_id", r"\d+", 0).cast("long")


# ---------------------------------------------------------------- user agents, identity


def _agents(s: SparkSession, d: str) -> DataFrame:
    rows = T.raw(s, d).withColumn("device_type", C.ua_device(F.col("ua_raw")))
    score = C.bot_score(F.col("device_type"), F.col("referrer"))
    return rows.select(
        "event_id", "device_type", C.ua_browser(F.col("ua_raw")).alias("browser"), C.ua_os(F.col("ua_raw")).alias("os"), score.alias("bot_score"), C.is_bot(score).alias("is_bot"),
        C.unknown_if_blank(F.col("session_id")).alias("session"),
    )


query(
    "user_agents",
    _agents,
    "select event_id, device_type, browser, os, bot_score, is_bot, coalesce(session_id, 'unknown') as session from enriched",
    "enriched",
)


def _identities(s: SparkSession, d: str) -> DataFrame:
    """Every third event is without an address."""
    rows = T.raw(s, d).select("event_id", "session_id", "anon_id", F.when(_number() % 3 != 0, F.col("ip_raw")).alias("ip"), "ip_hash", C.ua_device(F.col("ua_raw")).alias("device"))
    keys = [F.col(c) for c in ("session_id", "anon_id", "ip", "device")]
    return rows.select(
        "event_id", C.ip_hash(F.col("ip"), F.col("ip_hash"), enrich.SALT).alias("ip_hash"), C.session_key(*keys).alias("session_key"), C.rollup_session_key(*keys).alias("rollup_session_key")
    )


query(
    "identities",
    _identities,
    """select event_id, case when ip is not null then ip_hash end as ip_hash, coalesce(session_id, anon_id, ip || ':' || device_type) as session_key,
       coalesce(session_id, anon_id, coalesce(ip, 'null') || ':' || device_type) as rollup_session_key
       from (select *, case when number % 3 <> 0 then ip_raw end as ip from enriched)""",
    "enriched",
)

# ---------------------------------------------------------------- areas, URLs, properties


def _areas(s: SparkSession, d: str) -> DataFrame:
    """Every fifth event is without a country, every fourth without a region."""
    hint = (F.when(_number() % 5 != 0, F.col("geo_hint.country")), F.when(_number() % 4 != 0, F.col("geo_hint.region")), F.col("geo_hint.city"))
    rows = T.raw(s, d).select("event_id", C.geo_snap(*hint).alias("a")).select("event_id", "a.*")
    chain = C.geo_ancestors(*(F.col(c) for c in ("geo_level", "geo_area_id", "country", "region", "metro")))
    return rows.withColumn("ancestors", F.array_join(F.transform(chain, lambda a: a["geo_area_id"]), "|"))


query(
    "geo_snap_and_ancestors",
    _areas,
    """select event_id, case when c is null then 'GLOBAL' when m is not null then 'METRO' when r is not null then 'REGION' else 'COUNTRY' end as geo_level,
       case when c is null then 'GLOBAL' when m is not null then 'METRO:' || c || ':' || coalesce(r, '') || ':' || m when r is not null then 'REGION:' || c || ':' || r
            else 'COUNTRY:' || c end as geo_area_id,
       c as country, case when c is not null then r end as region, case when c is not null then m end as metro,
       concat_ws('|', 'GLOBAL', 'COUNTRY:' || c, 'REGION:' || c || ':' || r, 'METRO:' || c || ':' || coalesce(r, '') || ':' || m) as ancestors
       from (select event_id, case when number % 5 <> 0 then hint_country end as c, case when number % 4 <> 0 then hint_region end as r, hint_city as m from raw)""",
    "raw",
)
query(
    "url_parts",
    lambda s, d: T.raw(s, d).select(
        "event_id", C.path_only(F.col("page_url")).alias("page_path"), C.path_only(F.col("target_url")).alias("target_path"), C.domain_only(F.col("referrer")).alias("referrer_domain"),
        C.path_only(F.concat(F.lit("https://site.example/p%20q/"), F.col("event_id"), F.lit("+?x=1#y"))).alias("decoded"),
    ),
    """select event_id, regexp_extract(regexp_replace(page_url, '^https?://[^/]*', ''), '^[^?#]*') as page_path, target_url as target_path,
       regexp_extract(referrer, '^(?:https?://)?([^/?#]+)', 1) as referrer_domain, '/p q/' || event_id || '+' as decoded from raw""",
    "raw",
)


def _properties(s: SparkSession, d: str) -> DataFrame:
    """With a key that is not allowed, a nested value and a fraction added."""
    more = F.create_map(F.lit("secret"), F.col("event_id"), F.lit("campaign"), F.lit('{"a": 1}'), F.lit("rank"), F.concat((_number() % 50).cast("string"), F.lit(".6")))
    rows = T.raw(s, d).select("event_id", "event_type", C.sanitize_properties(F.map_concat("properties", more)).alias("p"))
    p, kind = F.col("p"), F.col("event_type")
    consent = F.when(_number() % 3 == 0, "granted").when(_number() % 3 == 1, "maybe")
    domains = C.clean_technical_domains(F.array(F.concat(F.lit(" "), kind), kind, F.lit(""), F.lit(None).cast("string"), F.lit("spark")))
    return rows.select(
        "event_id", F.array_join(F.array_sort(F.map_keys(p)), ",").alias("names"), C.property_text(p, "contentId").alias("content_id"),
        C.bounded_int(p, "engagedSeconds", 40).alias("engaged"), C.bounded_int(p, "rank", 30).alias("rank_down"), C.bounded_int_strict(p, "rank", 30).alias("rank_rounded"),
        C.normalize_consent(consent).alias("consent"), F.array_join(domains, ",").alias("domains"),
    )


query(
    "event_properties",
    _properties,
    """select event_id, 'contentId,contentType,engagedSeconds,progressPercent,rank' as names, content_id, least(40, seconds)::int as engaged,
       least(30, number % 50)::int as rank_down, least(30, number % 50 + 1)::int as rank_rounded, case when number % 3 = 0 then 'granted' else 'unknown' end as consent,
       event_type || ',spark' as domains from raw""",
    "raw",
)

# ---------------------------------------------------------------- time and predicates

query(
    "time_buckets",
    lambda s, d: T.raw(s, d).select(
        "event_id", C.bucket_floor(F.col("event_time"), "5m").alias("five_minutes"), C.bucket_floor(F.col("event_time"), "1d").alias("day"),
        C.time_window_filter(F.col("event_time"), "7d", T.NOW).alias("in_week"), C.time_window_filter(F.col("event_time"), None, T.NOW, 3).alias("in_three_days"),
        C.range_filter(F.col("event_time"), "2024-01-05T00:00:00", "2024-01-20T12:00:00").alias("in_range"),
    ),
    f"""select event_id, date_trunc('hour', event_time) + to_minutes((minute(event_time) // 5 * 5)::int) as five_minutes, date_trunc('day', event_time)::timestamp as day,
       event_time >= {NOW} - interval 7 day as in_week, event_time >= {NOW} - interval 3 day as in_three_days,
       event_time >= timestamp '2024-01-05 00:00:00' and event_time < timestamp '2024-01-20 12:00:00' as in_range from raw""",
    "raw",
)


def _predicates(s: SparkSession, d: str) -> DataFrame:
    rows = T.enriched(s, d).join(T.raw(s, d).select("event_id", F.col("geo_hint.lat").alias("hint_lat"), F.col("geo_hint.lng").alias("hint_lng"), F.col("ip_raw").alias("ip")), "event_id")
    path, url = C.path_only(F.col("page_url")), F.when(_number() % 8 == 0, "http://LOCALHOST:3000/x").otherwise(F.col("page_url"))
    text = [F.col("browser"), F.col("os")]
    return rows.select(
        "event_id", C.validate_required(F.when(_number() % 9 != 0, F.col("event_id")), F.col("event_type"), F.col("site_id")).alias("required"),
        C.level_filter(F.col("geo_level"), "world").alias("of_world"), C.bbox_filter(F.col("hint_lat"), F.col("hint_lng"), (40.0, -40.0, 150.0, -150.0)).alias("near_date_line"),
        C.exclude_admin_prefix(path).alias("not_admin"), C.exclude_admin_prefix(path, "/work", "like").alias("not_like_work"),
        C.exclude_admin_prefix(F.lit(None).cast("string"), "/ADMIN", "lower", F.col("page_url")).alias("not_admin_url"),
        C.exclude_loopback(url, F.col("target_url"), F.col("referrer"), F.when(_number() % 10 == 0, "127.0.0.1").otherwise(F.col("ip"))).alias("remote"),
        C.exact_filter(F.col("browser"), " CHROME ").alias("is_chrome"), C.contains_filter(F.col("browser"), "FIRE").alias("has_fire"),
        C.free_text_filter(text, "chrome mac").alias("chrome_on_mac"),
    )


query(
    "event_predicates",
    _predicates,
    """select event_id, number % 9 <> 0 as required, geo_level = 'COUNTRY' as of_world, lat between -40 and 40 and (lng >= 150 or lng <= -150) as near_date_line,
       path <> '/admin' and path not like '/admin/%' as not_admin, path not like '/work%' as not_like_work, lower(path) <> '/admin' and lower(path) not like '/admin/%' as not_admin_url,
       number % 8 <> 0 and number % 10 <> 0 as remote, lower(browser) = 'chrome' as is_chrome, contains(lower(browser), 'fire') as has_fire,
       contains(lower(browser || ' ' || os), 'chrome mac') as chrome_on_mac
       from (select *, regexp_extract(regexp_replace(page_url, '^https?://[^/]*', ''), '^[^?#]*') as path from enriched)""",
    "enriched",
)
query(
    "pages_of_nations",
    lambda s, d: T.facts(s, d).groupBy("page_path", "country").agg(F.count("*").alias("views")).where(C.min_bucket_filter(F.col("views"))),
    "select page_path, country, count(*)::bigint as views from facts group by all having count(*) >= 5",
    "facts",
)
query(
    "visitor_page_items",
    lambda s, d: maintenance.visitor_page_items(
        maintenance.visitor_rows(enrich.raw_tier(T.raw(s, d)), T.facts(s, d), T.START, T.END, include_admin=True, browser="safari", referrer="google")
    ).select("event_id", "event_name", "event_time", "session_id", "page_url", "ip_address", "country", "city", "device_type", "os", "is_bot"),
    f"""select event_id, event_type as event_name, event_time, session_id, page_url, ip_raw as ip_address, country, metro as city, device_type, os, is_bot from enriched
       where event_time >= {START} and event_time < {END} and browser = 'Safari' and contains(referrer, 'google')""",
    "enriched",
)

# ---------------------------------------------------------------- rule tables, from the orders

part(
    "rule_rows",
    """
select o_orderkey as rule_id, case when o_orderkey % 7 <> 0 then o_orderpriority else ' ' end as name, case when o_orderkey % 11 <> 0 then 'page_view' end as event_type,
  case when o_orderkey % 13 <> 0 then 'site-main' end as site_id, (['GLOBAL', 'COUNTRY', 'REGION', 'METRO', 'PLANET'])[o_orderkey % 5 + 1] as geo_level,
  case when o_custkey % 4 = 0 then '1h' when o_custkey % 4 = 1 then '5m' else '1d' end as granularity, case when o_custkey % 6 = 0 then '>' when o_custkey % 2 = 0 then '>=' else '<=' end as comparator,
  o_custkey % 9 - 1 as threshold, (40 + o_custkey % 100)::int as cooldown_seconds, o_orderstatus <> 'F' as enabled
from orders""",
)
part(
    "revisions",
    """
select o_custkey as rule_id, row_number() over w as version, o_orderdate as created_at, (floor(o_totalprice)::bigint % 3)::varchar as threshold,
  (o_orderstatus <> 'F')::varchar as enabled, o_orderpriority as name
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
)


def _orders(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet")


def _rules(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    levels = F.array(*[F.lit(x) for x in ("GLOBAL", "COUNTRY", "REGION", "METRO", "PLANET")])
    return _orders(s, d).select(
        k.alias("rule_id"), F.when(k % 7 != 0, F.col("o_orderpriority")).otherwise(" ").alias("name"), F.when(k % 11 != 0, "page_view").alias("event_type"),
        F.when(k % 13 != 0, "site-main").alias("site_id"), F.element_at(levels, (k % 5 + 1).cast("int")).alias("geo_level"),
        F.when(c % 4 == 0, "1h").when(c % 4 == 1, "5m").otherwise("1d").alias("granularity"), F.when(c % 6 == 0, ">").when(c % 2 == 0, ">=").otherwise("<=").alias("comparator"),
        (c % 9 - 1).alias("threshold"), (40 + c % 100).cast("int").alias("cooldown_seconds"), (F.col("o_orderstatus") != "F").alias("enabled"),
    )


def _revisions(s: SparkSession, d: str) -> DataFrame:
    """A rule per customer, each of whose orders revises it."""
    by_rule = Window.partitionBy("rule_id").orderBy("created_at", "o_orderkey")
    state = F.struct((F.floor("o_totalprice") % 3).alias("threshold"), (F.col("o_orderstatus") != "F").alias("enabled"), F.col("o_orderpriority").alias("name"))
    rows = _orders(s, d).select(F.col("o_custkey").alias("rule_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), "o_orderkey", F.to_json(state).alias("after_state"))
    return rows.select("rule_id", F.row_number().over(by_rule).cast("long").alias("version"), "created_at", F.lag("after_state").over(by_rule).alias("before_state"), "after_state")


def _validated(s: SparkSession, d: str) -> DataFrame:
    good, bad = alerts.validate_alert_rules(_rules(s, d))
    return good.select("rule_id", F.lit("valid").alias("verdict")).unionByName(bad.select("rule_id", F.col("reason").alias("verdict")))


query(
    "validate_alert_rules",
    _validated,
    """select rule_id, case when site_id is null then 'site_id is required' when trim(name) = '' then 'name is required' when event_type is null then 'event_type is required'
       when geo_level = 'PLANET' then 'geoLevel must be GLOBAL, COUNTRY, REGION, or METRO' when granularity = '1h' then 'granularity must be 5m or 1d'
       when comparator = '>' then 'comparator must be >= or <=' when threshold < 0 then 'threshold must be at least 0'
       when cooldown_seconds < 60 then 'cooldownSeconds must be at least 60' else 'valid' end as verdict from rule_rows""",
    "rule_rows",
)
query(
    "filter_alert_rules",
    lambda s, d: alerts.filter_alert_rules(_rules(s, d), " Urgent ", "page_view", True).select("rule_id", "name", "threshold", "comparator"),
    "select rule_id, name, threshold, comparator from rule_rows where contains(lower(name), 'urgent') and event_type = 'page_view' and enabled",
    "rule_rows",
)
query(
    "fires",
    lambda s, d: _rules(s, d).select("rule_id", C.fires(F.col("rule_id") % 10, F.col("threshold"), F.col("comparator")).alias("fires")),
    "select rule_id, case comparator when '>=' then rule_id % 10 >= threshold when '<=' then rule_id % 10 <= threshold else false end as fires from rule_rows",
    "rule_rows",
)
query(
    "rule_revision_diff",
    lambda s, d: alerts.rule_revision_diff(_revisions(s, d)),
    """select rule_id, version, field, "from", "to", case when field = 'enabled' and "to" = 'false' then 'disables the rule'
         when field = 'threshold' and "to" = '0' then 'a threshold of 0 always fires' end as warning
       from (select rule_id, version, unnest(['threshold', 'enabled', 'name']) as field, unnest([t0, e0, n0]) as "from", unnest([threshold, enabled, name]) as "to"
             from (select *, lag(threshold) over w as t0, lag(enabled) over w as e0, lag(name) over w as n0 from revisions window w as (partition by rule_id order by version)))
       where "from" is distinct from "to\"""",
    "revisions",
)
query(
    "rules_as_of",
    lambda s, d: alerts.rules_as_of(_revisions(s, d), "1997-06-30T00:00:00").select(
        "rule_id", "version", *[F.get_json_object("state", f"$.{x}").alias(x) for x in ("threshold", "enabled", "name")]
    ),
    """select rule_id, max(version) as version, arg_max(threshold, version) as threshold, arg_max(enabled, version) as enabled, arg_max(name, version) as name
       from revisions where created_at <= timestamp '1997-06-30 00:00:00' group by rule_id""",
    "revisions",
)

# ---------------------------------------------------------------- snapshots, policies


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Each session's snapshot; those with clicks have a newer one."""
    old = T.sessions(s, d).select("site_id", "session_id", F.lit("p").alias("policy_id"), F.lit(0).cast("long").alias("score"), "clicks")
    return journeys.merge_snapshots(old.drop("clicks"), old.where("clicks > 0").select("site_id", "session_id", "policy_id", F.col("clicks").alias("score")))


query("merge_snapshots", _snapshots, "select site_id, session_id, 'p' as policy_id, clicks as score from sessions", "sessions")


def _policies(s: SparkSession, d: str) -> DataFrame:
    """A policy per customer, its segment being the site."""
    return s.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_name").alias("policy_id"), F.col("c_mktsegment").alias("site_id"), F.when(F.col("c_custkey") % 3 == 0, "ACTIVE").otherwise("DRAFT").alias("status")
    )


query(
    "active_policy",
    lambda s, d: journeys.active_policy(_policies(s, d), "BUILDING"),
    """select c_name as policy_id, c_mktsegment as site_id, 'ACTIVE' as status from customer where c_mktsegment = 'BUILDING' and c_custkey % 3 = 0 order by c_name limit 1""",
)
