"""Registration of the journey, content, alert and maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import alerts, enrich, journeys, maintenance, rollups
from ..scratch import Scratch
from ..sources import events
from . import rules as R
from . import tables as T
from .registry import ORACLES, in_batches, query
from .sql import END, NOW, START, part

RANGE = f"event_time >= {START} and event_time < {END}"
PUBLIC = "coalesce(page_path, '') not like '/admin%'"

part(
    "steps",
    """
select event_id, site_id, session_id, event_name, event_time, page_path, target_path, referrer_domain, content_id, content_type, least(86400, seconds)::int as engaged_seconds,
  least(100, progress)::int as progress_percent
from facts where session_id is not null""",
    "facts",
)


def _values(name: str, columns: str, rows) -> None:
    text = R.sql_values(name, columns, rows)
    part(name, "select * from (" + text.split(" as (", 1)[1][:-1] + f") as t({columns})")


_values("signal_rules", "rule_key, description, event_name, path_source, path_match_type, path_pattern, dimension, weight, most, min_engaged, min_progress", R.SIGNAL_RULES)
_values("funnel_rules", "rule_id, funnel_version, step_key, step_label, step_description, step_order, event_name, path_source, path_match_type, path_pattern", R.FUNNEL_RULES)
_values("attribution_rules", "rule_id, host_pattern, source_label, source_type, priority", R.ATTRIBUTION_RULES)
_values(
    "metadata",
    "site_id, content_type, content_id, canonical_path, display_title, cover_url, primary_intent, technical_domains, complexity_level, career_relevance, recommendation_group, intent_weight, metadata_source, metadata_version, active",
    R.METADATA,
)
_values("alert_rules", "rule_id, site_id, name, event_type, geo_level, geo_area_id, granularity, threshold, comparator, cooldown_seconds, enabled, version", R.ALERT_RULES)

_PATHS = """(r.event_name is null or r.event_name = j.event_name) and (r.path_match_type = 'ANY'
  or (r.path_source in ('ANY', 'PAGE') and ((r.path_match_type = 'EXACT' and j.page_path = r.path_pattern) or (r.path_match_type = 'PREFIX' and starts_with(j.page_path, r.path_pattern))))
  or (r.path_source in ('ANY', 'TARGET') and ((r.path_match_type = 'EXACT' and j.target_path = r.path_pattern) or (r.path_match_type = 'PREFIX' and starts_with(j.target_path, r.path_pattern)))))"""

part(
    "signals",
    f"""
select session_id, rule_key as signal_key, dimension, least(count(*), most)::int as occurrences, (least(count(*), most) * weight)::int as score
from steps j join signal_rules r on {_PATHS} and (r.min_engaged is null or j.engaged_seconds >= r.min_engaged) and (r.min_progress is null or j.progress_percent >= r.min_progress)
group by session_id, rule_key, dimension, most, weight
union all
select distinct session_id, 'content:' || ty || ':' || id, intent, 1, weight from (
  select session_id, coalesce(d.content_type, p.content_type, t.content_type) as ty, coalesce(d.content_id, p.content_id, t.content_id) as id,
    coalesce(d.primary_intent, p.primary_intent, t.primary_intent) as intent, coalesce(d.intent_weight, p.intent_weight, t.intent_weight) as weight
  from steps j left join metadata d on d.active and lower(d.content_type) = lower(j.content_type) and d.content_id = j.content_id
  left join metadata p on p.active and p.canonical_path = j.page_path left join metadata t on t.active and t.canonical_path = j.target_path)
where weight > 0""",
    "steps", "signal_rules", "metadata",
)
part(
    "snapshots",
    """
select s.session_id, least(100, coalesce(d.raw, 0))::int as score, case when least(100, coalesce(d.raw, 0)) >= 55 then 'HIGH' when least(100, coalesce(d.raw, 0)) >= 25 then 'MEDIUM' else 'LOW' end as intent_level,
  d.dominant as dominant_intent, d.n_signals, s.first_event, s.last_event
from (select session_id, min(event_time) as first_event, max(event_time) as last_event from steps group by session_id) s
left join (select session_id, sum(score) as raw, sum(n) as n_signals, arg_min(dimension, (-score, dimension)) as dominant
           from (select session_id, dimension, sum(score) as score, count(*) as n from signals group by session_id, dimension) group by session_id) d using (session_id)""",
    "steps", "signals",
)


def steps(s: SparkSession, d: str) -> DataFrame:
    return journeys.journey_steps(T.enriched(s, d))


def stored_steps(s: SparkSession, d: str) -> DataFrame:
    """The steps as a stored table, as ingestion leaves them, for what reads them more than
    once: events are enriched a single time."""
    return Scratch(s).store(steps(s, d), "journey-steps")


def snapshots(s: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return journeys.score_intent(stored_steps(s, d) if of is None else of, journeys.active_policy(R.policies(s)), R.signal_rules(s), R.metadata(s))


query("journey_steps", steps, "select * from steps", "steps")
query(
    "journey_summary",
    lambda s, d: journeys.journey_summary(steps(s, d), T.START, T.END),
    f"select count(*)::bigint as total_events, count(distinct session_id)::bigint as unique_visitors from steps where {RANGE} and {PUBLIC}",
    "steps",
)
query(
    "score_intent",
    lambda s, d: snapshots(s, d).select("session_id", "score", "intent_level", "dominant_intent", F.greatest(F.lit(0), F.size("contributing_signals")).alias("n_signals"), "first_event", "last_event"),
    "select session_id, score, intent_level, dominant_intent, coalesce(n_signals, 0)::int as n_signals, first_event, last_event from snapshots",
    "snapshots",
)
query(
    "intent_signals",
    lambda s, d: snapshots(s, d).select("session_id", F.explode("contributing_signals").alias("x")).select("session_id", "x.signal_key", "x.dimension", "x.occurrences", "x.score"),
    "select session_id, signal_key, dimension, occurrences, score from signals",
    "signals",
)
query(
    "replay_journeys",
    lambda s, d: journeys.replay_journeys(
        T.facts(s, d), steps(s, d).where("event_time < timestamp_ntz '2024-01-15'"), journeys.active_policy(R.policies(s)), R.signal_rules(s), R.metadata(s), T.START, T.END, max_sessions=100
    )[1].select("session_id", "score", "intent_level"),
    f"""select session_id, score, intent_level from snapshots where session_id in (select distinct session_id from facts where session_id is not null and {RANGE} order by session_id limit 100)""",
    "snapshots",
)
query(
    "insert_journey_steps",
    lambda s, d: journeys.insert_journey_steps(steps(s, d).where("event_time < timestamp_ntz '2024-01-15'"), steps(s, d)).select("event_id", "session_id", "event_name"),
    "select event_id, session_id, event_name from steps",
    "steps",
)
query(
    "merge_sessions",
    lambda s, d: journeys.merge_sessions(T.sessions(s, d).withColumn("clicks", F.lit(-1).cast("long")), T.sessions(s, d).where("page_views > 0")).select("session_id", "page_views", "clicks"),
    "select session_id, page_views, case when page_views > 0 then clicks else -1 end::bigint as clicks from sessions",
    "sessions",
)
query(
    "rule_funnel",
    lambda s, d: journeys.rule_funnel(steps(s, d), R.funnel_rules(s), T.START, T.END).select(
        "step_key", "step_label", "step_order", "visitors", F.round("rate_from_start", 9).alias("rate_from_start"), F.round("rate_from_previous", 9).alias("rate_from_previous")
    ),
    f""", v as (select r.step_key, max(r.step_label) as step_label, min(r.step_order) as step_order, count(distinct j.session_id)::bigint as visitors
               from funnel_rules r left join (select * from steps where {RANGE} and {PUBLIC}) j on {_PATHS} group by r.step_key)
        select step_key, step_label, step_order, visitors, round(visitors / greatest(1, first_value(visitors) over (order by step_order)), 9)::double as rate_from_start,
          round(visitors / greatest(1, coalesce(last_value(nullif(visitors, 0) ignore nulls) over (order by step_order rows between unbounded preceding and 1 preceding),
                greatest(1, first_value(visitors) over (order by step_order)))), 9)::double as rate_from_previous from v""",
    "steps", "funnel_rules",
)


def _attribution(s: SparkSession, d: str) -> DataFrame:
    kept = stored_steps(s, d)
    return journeys.attribution(kept, snapshots(s, d, kept), R.attribution_rules(s), T.START, T.END)


query(
    "attribution",
    _attribution,
    f""", p as (select j.session_id, arg_min(referrer_domain, (event_time, event_id)) filter (where referrer_domain is not null) as dom, count(*) as events, coalesce(max(i.score), 0) as score
               from steps j left join snapshots i using (session_id) where {RANGE} and {PUBLIC} group by j.session_id),
       m as (select p.*, (select arg_min((r.source_label, r.source_type), r.priority) from attribution_rules r where contains(lower(p.dom), r.host_pattern)) as rule from p)
       select coalesce(rule[1], dom, 'Direct') as source, coalesce(rule[2], case when dom is null then 'direct' else 'referral' end) as source_type, count(*)::bigint as visitors,
         sum(events)::bigint as events, round(avg(score))::int as quality_score from m group by 1, 2 order by quality_score desc, events desc, source limit 8""",
    "steps", "snapshots", "attribution_rules",
)
query(
    "top_content",
    lambda s, d: journeys.top_content(stored_steps(s, d), R.metadata(s), T.START, T.END),
    f""", c as (select *, coalesce(target_path, page_path) as path from steps where {RANGE} and {PUBLIC} and coalesce(target_path, page_path) <> '/'),
       t as (select path, max(content_type) as own, count(*)::bigint as events, count(distinct session_id)::bigint as visitors, coalesce(sum(engaged_seconds), 0)::bigint as engaged_seconds from c group by path),
       m as (select c.path, max(m.content_type) as ty, max(m.display_title) as title, max(m.cover_url) as cover_url from c join metadata m
             on m.active and ((m.content_id = c.content_id and m.content_type = c.content_type) or m.canonical_path = c.path) group by c.path)
       select t.path, coalesce(m.ty, t.own, 'page') as content_type, coalesce(m.title, t.path) as title, m.cover_url, t.events, t.visitors, t.engaged_seconds
       from t left join m using (path) order by visitors desc, events desc, engaged_seconds desc, t.path limit 8""",
    "steps", "metadata",
)
query(
    "cohort_summary",
    lambda s, d: journeys.cohort_summary(T.sessions(s, d), steps(s, d), T.START, T.END),
    f""", i as (select coalesce(nullif(anon_id, ''), session_id) as v, count(*) as n, sum(page_views + clicks) as e from sessions where last_event >= {START} and first_event < {END} group by 1),
       g as (select coalesce(nullif(s.anon_id, ''), s.session_id) as v, count(distinct j.page_path) as pages from sessions s join steps j using (session_id)
             where s.last_event >= {START} and s.first_event < {END} group by 1),
       o as (select count(*)::bigint as visitors, count(*) filter (where n > 1)::bigint as returning_visitors, count(*) filter (where coalesce(pages, 0) >= 2)::bigint as multi_step_visitors,
             coalesce(round(avg(e), 9), 0)::double as average_events from i left join g using (v))
       select *, returning_visitors / visitors as returning_rate, multi_step_visitors / visitors as multi_step_rate from o""",
    "sessions", "steps",
)
query(
    "last_n_journey_steps",
    lambda s, d: journeys.last_n_journey_steps(steps(s, d), 5).select("session_id", "event_id", "rank"),
    "select session_id, event_id, row_number() over (partition by session_id order by event_time desc, event_id desc) as rank from steps qualify rank <= 5",
    "steps",
)


def _listed_journeys(s: SparkSession, d: str, of) -> DataFrame:
    kept = stored_steps(s, d)
    return of(T.sessions(s, d), snapshots(s, d, kept), kept, T.START, T.END)


for _name, _order, _where in (("high_intent_journeys", "score desc, last_event desc", "intent_level in ('HIGH', 'MEDIUM')"), ("recent_journeys", "last_event desc", "true")):
    query(
        _name,
        lambda s, d, f=getattr(journeys, _name): _listed_journeys(s, d, f).select(
            "session_id", "score", "intent_level", "dominant_intent", F.size("steps").alias("n_steps"), F.element_at("steps", 1)["event_id"].alias("first_step")
        ),
        f""", c as (select s.session_id, i.score, i.intent_level, i.dominant_intent from sessions s join snapshots i using (session_id)
              where s.last_event >= {START} and s.first_event < {END} and coalesce(s.entry_page, '') not like '/admin%' and {_where} order by {_order.replace('last_event', 's.last_event')}, s.session_id limit 12),
           k as (select session_id, event_id, event_time from steps qualify row_number() over (partition by session_id order by event_time desc, event_id desc) <= 24)
           select c.session_id, c.score, c.intent_level, c.dominant_intent, count(*)::int as n_steps, arg_min(k.event_id, (k.event_time, k.event_id)) as first_step
           from c join k using (session_id) group by all""",
        "sessions", "snapshots",
    )



def _merged_snapshots(s: SparkSession, d: str) -> DataFrame:
    """Snapshots from what three batches left of their steps."""
    every = stored_steps(s, d)
    parts = in_batches(every, lambda rows: journeys.intent_parts(rows, R.signal_rules(s), R.metadata(s)))
    spans = journeys.intent_spans(in_batches(every, journeys.intent_spans))
    return journeys.score_parts(journeys.merge_intent_parts(parts), spans, journeys.active_policy(R.policies(s)))


query(
    "merge_intent_parts",
    lambda s, d: _merged_snapshots(s, d).select("session_id", "score", "intent_level", "dominant_intent", F.greatest(F.lit(0), F.size("contributing_signals")).alias("n_signals"), "first_event", "last_event"),
    "select session_id, score, intent_level, dominant_intent, coalesce(n_signals, 0)::int as n_signals, first_event, last_event from snapshots",
    "snapshots",
)

#: read models of the overview and the queries whose SQL has their rows
OVERVIEW = {
    "summary": "journey_summary", "funnel": "rule_funnel", "attribution": "attribution", "top_content": "top_content", "cohort": "cohort_summary", "high_intent": "high_intent_journeys", "recent": "recent_journeys",
}


def _overview(s: SparkSession, d: str) -> DataFrame:
    """How many rows each read model of the overview has."""
    scratch, kept = Scratch(s), stored_steps(s, d)
    tables = {
        "steps": kept, "snapshots": scratch.store(snapshots(s, d, kept), "snapshots"), "sessions": scratch.store(T.sessions(s, d), "sessions"), "metadata": R.metadata(s), "policies": R.policies(s), "funnel_rules": R.funnel_rules(s),
        "attribution_rules": R.attribution_rules(s),
    }
    out = None
    for name, model in journeys.visitor_overview(tables, T.START, T.END).items():
        counted = model.agg(F.count("*").alias("rows")).select(F.lit(name).alias("model"), "rows")
        out = counted if out is None else out.unionByName(counted)
    return out


query("visitor_overview", _overview)
ORACLES["visitor_overview"] = " union all ".join(
    ["select 'policy' as model, 1::bigint as rows", *(f"select '{name}' as model, count(*)::bigint as rows from ({ORACLES[of]})" for name, of in OVERVIEW.items())]
)

# ---------------------------------------------------------------- content metadata


def _contents(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four content tables, derived from parts, suppliers, customers and nations."""
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.col("p_type").alias("technology"))
    null = F.lit(None).cast("string")
    when = F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(id % 30 as int))")
    projects = p.withColumns({"image_url": null, "updated_at": F.when(F.col("id") % 3 != 0, when), "published_at": when, "publication_status": F.when(F.col("id") % 4 != 0, "PUBLISHED").otherwise("DRAFT")})
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category"))
    blogs = c.withColumns({"image_url": null, "tags": null})
    life = c.withColumns({"image_url": null, "tags": F.col("category"), "updated_at": when, "created_at": when, "published_at": F.when(F.col("id") % 2 == 0, when)})
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("x").alias("subname"))
    return projects, blogs, life, n


def projected(s: SparkSession, d: str) -> DataFrame:
    return journeys.project_content_metadata(*_contents(s, d), R.type_defaults(s), T.NOW)


_DAY = "(timestamp '2024-01-01' + to_days((id % 30)::int))"
part(
    "projected",
    f"""
select 'PROJECT' as content_type, p_partkey::varchar as content_id, '/work-single/' || p_partkey as canonical_path, p_name as display_title, 'project_interest' as primary_intent,
  floor(epoch(timestamp '2024-01-01' + to_days((p_partkey % 30)::int)) / 60)::int as metadata_version, p_partkey % 4 <> 0 as active, 2 as n_domains from part
union all select 'BLOG', c_custkey::varchar, '/blog-single/' || c_custkey, c_name, 'technical_learning', 1, true, 1 from customer
union all select 'LIFE_BLOG', c_custkey::varchar, '/life-blog/' || c_custkey, c_name, 'personal_context', floor(epoch(timestamp '2024-01-01' + to_days((c_custkey % 30)::int)) / 60)::int, c_custkey % 2 = 0, 2 from customer
union all select 'EXPERIENCE', n_nationkey::varchar, null, n_name, 'career_interest', 1, true, 1 from nation""",
)
_PROJECTED = ("content_type", "content_id", "canonical_path", "display_title", "primary_intent", "metadata_version", "active")
query(
    "project_content_metadata",
    lambda s, d: projected(s, d).select(*_PROJECTED, F.size("technical_domains").alias("n_domains")),
    "select * from projected",
    "projected",
)


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Projected rows as stored ones: every third is ADMIN's, versions are half an hour on for odd ids."""
    n = F.regexp_extract("content_id", r"\d+", 0).cast("int")
    rows = projected(s, d).where("content_type <> 'LIFE_BLOG'")
    return rows.withColumns({
        "metadata_source": F.when(n % 3 == 0, "ADMIN").otherwise("SOURCE_PROJECTION"), "metadata_version": F.col("metadata_version") + F.when(n % 2 == 1, 30).otherwise(0), "display_title": F.lit("old"),
    })


for _mode, _wins in (("projection", "n % 3 <> 0"), ("published", "n % 3 <> 0 and n % 2 = 0"), ("admin", "true")):
    query(
        f"merge_content_metadata_{_mode}",
        lambda s, d, m=_mode: journeys.merge_content_metadata(_stored(s, d), projected(s, d), m).select("content_type", "content_id", "display_title", "metadata_source"),
        f"""select content_type, content_id, case when content_type = 'LIFE_BLOG' or ({_wins}) then display_title else 'old' end as display_title,
            case when content_type = 'LIFE_BLOG' or ({_wins}) then '{ {"projection": "SOURCE_PROJECTION", "published": "PUBLISH_EVENT", "admin": "ADMIN"}[_mode] }'
                 when n % 3 = 0 then 'ADMIN' else 'SOURCE_PROJECTION' end as metadata_source
            from (select *, content_id::int as n from projected)""",
        "projected",
    )
query(
    "deactivate_deleted_content",
    lambda s, d: journeys.deactivate_deleted_content(_stored(s, d), projected(s, d).where("content_type <> 'BLOG'")).select("content_type", "content_id", "active"),
    "select content_type, content_id, active and (content_type <> 'BLOG' or content_id::int % 3 = 0) as active from projected where content_type <> 'LIFE_BLOG'",
    "projected",
)
query(
    "list_content_metadata",
    lambda s, d: journeys.list_content_metadata(projected(s, d).withColumn("updated_at", F.col("metadata_version")), limit=50).select("content_type", "content_id"),
    "select content_type, content_id from projected order by metadata_version desc, content_type, content_id limit 50",
    "projected",
)
query(
    "validate_content_metadata",
    lambda s, d: journeys.validate_content_metadata(
        projected(s, d).withColumn("intent_weight", F.col("content_id").cast("int") % 150).withColumn("metadata_version", F.col("content_id").cast("int") % 20)
    )[1].select("content_type", "content_id", "reason"),
    """select content_type, content_id, case when content_id::int % 150 > 100 then 'careerRelevance and intentWeight must be between 0 and 100' else 'metadataVersion must be at least 1' end as reason
       from projected where content_id::int % 150 > 100 or content_id::int % 20 < 1""",
    "projected",
)

# ---------------------------------------------------------------- alerts

BUCKETS = f"""b as (select r.rule_id, unnest(generate_series({START}, {END} - interval 5 minute, case when granularity = '1d' then interval 1 day else interval 5 minute end)) as bucket_time
  from alert_rules r where enabled and granularity in ('5m', '1d') and comparator in ('>=', '<='))"""
MEASURED = """m as (select b.rule_id, b.bucket_time, coalesce(sum(r.event_count), 0)::bigint as measured from b join alert_rules a using (rule_id)
  left join rollups r on r.granularity = a.granularity and r.event_type = a.event_type and r.geo_level = a.geo_level and r.bucket_time = b.bucket_time
    and (coalesce(a.geo_area_id, '') = '' or r.geo_area_id = a.geo_area_id) group by b.rule_id, b.bucket_time)"""
FIRED = "h as (select m.*, a.cooldown_seconds, a.granularity, a.geo_area_id, a.threshold from m join alert_rules a using (rule_id) where case comparator when '>=' then measured >= threshold else measured <= threshold end)"


def both_rollups(s: SparkSession, d: str) -> DataFrame:
    e = T.enriched(s, d)
    return rollups.event_rollups(e, "1d").unionByName(rollups.event_rollups(e, "5m"))


AT = "2024-01-20T12:00:00"
_AT = "timestamp '2024-01-20 12:00:00'"
_LATEST = f"""b as (select rule_id, case granularity when '1d' then timestamp '2024-01-20' - to_days(i::int) else {_AT} - to_minutes((5 * i)::int) end as bucket_time
  from alert_rules, (select unnest([0, 1]) as i) where enabled and comparator in ('>=', '<='))"""
_NEWEST = "e as (select * from h qualify row_number() over (partition by rule_id order by bucket_time desc) = 1)"


def hits(s: SparkSession, d: str) -> DataFrame:
    return alerts.evaluate_alerts(both_rollups(s, d), R.alert_rules(s), AT)


query(
    "measure_alerts",
    lambda s, d: alerts.measure_alerts(
        both_rollups(s, d), R.alert_rules(s), R.alert_rules(s).where("granularity = '1d'").select("rule_id", F.explode(F.expr("sequence(timestamp_ntz '2024-01-01', timestamp_ntz '2024-01-30', interval 1 day)")).alias("bucket_time"))
    ),
    """, b as (select rule_id, unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day)) as bucket_time from alert_rules where granularity = '1d'), """ + MEASURED + " select * from m",
    "rollups", "alert_rules",
)
query(
    "evaluate_alerts",
    lambda s, d: hits(s, d).select("rule_id", "bucket_time", "measured"),
    f", {_LATEST}, {MEASURED}, {FIRED}, {_NEWEST} select rule_id, bucket_time, measured from e",
    "rollups", "alert_rules",
)
query(
    "open_incidents",
    lambda s, d: alerts.open_incidents(hits(s, d), None, AT).select("dedup_key", "rule_id", "bucket_time", "measured_value"),
    f""", {_LATEST}, {MEASURED}, {FIRED}, {_NEWEST} select rule_id || '|' || coalesce(geo_area_id, '') || '|' || granularity || '|' || epoch(bucket_time)::bigint as dedup_key, rule_id, bucket_time,
        measured as measured_value from e""",
    "rollups", "alert_rules",
)
query(
    "backtest_alerts",
    lambda s, d: alerts.backtest_alerts(both_rollups(s, d), R.alert_rules(s), T.START, T.END),
    f""", {BUCKETS}, {MEASURED}, {FIRED}, o as (select *, row_number() over (partition by rule_id order by bucket_time) as nth from h),
        f as (select rule_id, nth, bucket_time, measured, bucket_time as last, true as kept from o where nth = 1
              union all select o.rule_id, o.nth, o.bucket_time, o.measured, case when o.bucket_time > f.last + to_seconds(o.cooldown_seconds) then o.bucket_time else f.last end,
                o.bucket_time > f.last + to_seconds(o.cooldown_seconds) from f join o on o.rule_id = f.rule_id and o.nth = f.nth + 1)
        select rule_id, bucket_time, measured from f where kept""",
    "rollups", "alert_rules", recursive=True,
)


def history(s: SparkSession, d: str) -> DataFrame:
    """Incidents as the backtest would have opened them, an hour into each bucket."""
    rows = alerts.backtest_alerts(both_rollups(s, d), R.alert_rules(s).where("granularity = '1d'"), T.START, T.END).join(R.alert_rules(s), "rule_id")
    return alerts.open_incidents(rows, None, T.NOW).withColumn("created_at", F.col("bucket_time") + F.expr("interval 1 hour"))


def attempts(s: SparkSession, d: str) -> DataFrame:
    """One to eight delivery attempts, by the day of the bucket."""
    n = F.dayofmonth("bucket_time") % 10
    rows = history(s, d).withColumn("n", n).where("n > 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select("dedup_key", (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("i"))).alias("attempted_at"), ((F.col("i") == F.col("n")) & (F.col("n") % 2 == 0)).alias("ok"))


HISTORY = f""", {BUCKETS.replace("granularity in ('5m', '1d')", "granularity = '1d'")}, {MEASURED}, {FIRED}, o as (select *, row_number() over (partition by rule_id order by bucket_time) as nth from h),
  f as (select rule_id, nth, bucket_time, measured, bucket_time as last, true as kept from o where nth = 1
        union all select o.rule_id, o.nth, o.bucket_time, o.measured, case when o.bucket_time > f.last + to_seconds(o.cooldown_seconds) then o.bucket_time else f.last end,
          o.bucket_time > f.last + to_seconds(o.cooldown_seconds) from f join o on o.rule_id = f.rule_id and o.nth = f.nth + 1),
  i as (select f.rule_id || '|' || coalesce(a.geo_area_id, '') || '|' || a.granularity || '|' || epoch(f.bucket_time)::bigint as dedup_key, f.rule_id, a.name, a.comparator, a.threshold, f.bucket_time,
          f.measured, f.bucket_time + interval 1 hour as created_at, day(f.bucket_time) % 10 as n from f join alert_rules a using (rule_id) where kept),
  t as (select dedup_key, created_at, n::bigint as attempts, case when n > 0 and n % 2 = 0 then 'DELIVERED' when n >= 8 then 'DEAD_LETTER' when n > 0 then 'RETRY_WAIT' else 'PENDING' end as state from i),
  st as (select *, case state when 'RETRY_WAIT' then created_at + to_minutes(attempts + 1) when 'PENDING' then created_at end as next_attempt from t)"""


def _history(name: str, run, sql: str) -> None:
    query(name, run, f"{HISTORY} {sql}", "rollups", "alert_rules", recursive=True)


def status(s: SparkSession, d: str) -> DataFrame:
    return alerts.notification_status(history(s, d), attempts(s, d))


_history("notification_status", status, "select dedup_key, created_at, attempts, state, next_attempt from st")
_history(
    "due_notifications", lambda s, d: alerts.due_notifications(status(s, d), T.NOW).select("dedup_key", "state"),
    f"select dedup_key, state from st where state in ('PENDING', 'RETRY_WAIT') and next_attempt <= {NOW} order by created_at, dedup_key limit 25",
)
_history(
    "incident_summary", lambda s, d: alerts.incident_summary(status(s, d)),
    "select count(*)::bigint as total, count(*) filter (where state = 'DELIVERED')::bigint as notified, count(*) filter (where state <> 'DELIVERED')::bigint as pending from st",
)
_history(
    "recent_incidents", lambda s, d: alerts.recent_incidents(history(s, d), T.NOW, hours=240).select("dedup_key", "rule_id", "created_at"),
    f"select dedup_key, rule_id, created_at from i where created_at >= {NOW} - interval 240 hour order by created_at desc, dedup_key limit 50",
)
_history(
    "notification_payload", lambda s, d: alerts.notification_payload(history(s, d)).select("title", "summary", "source_id", "idempotency_key"),
    """select 'Alert: ' || name as title, comparator || ' ' || name || ' threshold ' || threshold || ' (measured ' || measured || ', bucket ' || strftime(bucket_time, '%Y-%m-%dT%H:%M:%SZ') || ')' as summary,
       rule_id::varchar as source_id, 'incident:' || dedup_key as idempotency_key from i""",
)


def fired_days(s: SparkSession, d: str) -> DataFrame:
    """Every day on which a rule's condition holds."""
    rules = R.alert_rules(s).where("granularity = '1d' and enabled")
    days = rules.select("rule_id", F.explode(F.expr("sequence(timestamp_ntz '2024-01-01', timestamp_ntz '2024-01-30', interval 1 day)")).alias("bucket_time"))
    rows = alerts.measure_alerts(both_rollups(s, d), rules, days).join(C.small(rules.select(*alerts.RULE)), "rule_id")
    return rows.where(C.fires(F.col("measured"), F.col("threshold"), F.col("comparator")))


_history(
    "apply_cooldown", lambda s, d: alerts.apply_cooldown(fired_days(s, d), history(s, d), "2024-01-29T00:00:00").select("rule_id", "bucket_time", "measured"),
    """select rule_id, bucket_time, measured from o where not exists (
         select 1 from i where i.rule_id = o.rule_id and i.created_at >= timestamp '2024-01-29 00:00:00' - to_seconds(o.cooldown_seconds))""",
)

# ---------------------------------------------------------------- log, retention, windows, backfill

ADMIN = "page_path <> '/admin' and page_path not like '/admin/%'"
query(
    "visitor_page",
    lambda s, d: maintenance.visitor_page(
        enrich.raw_tier(T.raw(s, d)), T.facts(s, d), T.START, T.END, page=1, size=50, path="work", device="desktop"
    ).select("event_id", "event_time", "page_url", "device_type"),
    f"""select event_id, event_time, page_url, device_type from (select f.*, e.page_url from facts f join enriched e using (event_id)) where {RANGE} and device_type = 'desktop'
        and contains(lower(page_url || ' ' || coalesce(target_path, '')), 'work') and {ADMIN} order by event_time desc, event_id limit 50 offset 50""",
    "facts",
)
query(
    "visitor_query_summary",
    lambda s, d: maintenance.visitor_query_summary(
        enrich.raw_tier(T.raw(s, d)), T.facts(s, d), T.START, T.END, query="firefox"
    ),
    f"""select count(*)::bigint as total_events, count(distinct coalesce(e.session_id, e.anon_id, e.ip_raw))::bigint as unique_visitors, count(distinct e.country)::bigint as countries,
        count(distinct e.metro)::bigint as cities, ceil(count(*) / 50)::bigint as total_pages from enriched e join facts f using (event_id)
        where e.{RANGE.replace(' and ', ' and e.')} and f.{ADMIN.replace(' and ', ' and f.')} and contains(lower(concat_ws(' ', e.event_type, e.page_url, e.target_url, e.referrer, e.session_id, e.anon_id, e.ip_raw,
          e.country, e.region, e.metro, e.device_type, e.browser, e.os)), 'firefox')""",
    "facts",
)
query(
    "rate_limit_windows",
    lambda s, d: maintenance.rate_limit_windows(T.raw(s, d).select(F.col("ip_raw").alias("ip"), F.col("event_time").alias("ts")), 86_400, 2),
    """select ip_raw as ip, date_trunc('day', event_time)::timestamp as window_start, count(*)::bigint as requests, greatest(0, count(*) - 2)::bigint as rejected, count(*) > 2 as over
       from raw group by 1, 2""",
    "raw",
)
query(
    "rejected_requests",
    lambda s, d: maintenance.rejected_requests(T.raw(s, d).select(F.col("event_id").alias("request_id"), F.col("ip_raw").alias("ip"), F.col("event_time").alias("ts")), 86_400, 2),
    """select event_id as request_id, ip_raw as ip, event_time as ts from raw
       qualify row_number() over (partition by ip_raw, date_trunc('day', event_time) order by event_time, event_id) > 2""",
    "raw",
)
query(
    "apply_retention",
    lambda s, d: maintenance.apply_retention(both_rollups(s, d), "rollups", T.NOW)[0].groupBy("granularity").agg(F.count("*").alias("rows"), F.sum("event_count").alias("events")),
    f"select granularity, count(*)::bigint as rows, sum(event_count)::bigint as events from rollups where granularity = '1d' or bucket_time >= {NOW} - interval 3 day group by 1",
    "rollups",
)
_LEGACY = """select number as id, site_id, event_type, ua_raw, ip_raw, hint_country, hint_region, hint_city, target_url, case when number % 13 <> 0 then event_time end as local_time,
  case when number % 26 <> 0 then server_time end as created_at from raw where event_type in ('page_view', 'click')"""
query(
    "read_visitor_logs",
    lambda s, d: events.read_visitor_logs(events.legacy_logs(s, d)).select("event_id", "event_time", "ua_raw", F.col("geo_hint.region").alias("region")),
    f"select 'vl:' || id as event_id, coalesce(local_time, created_at) as event_time, nullif(ua_raw, '') as ua_raw, hint_region as region from ({_LEGACY}) where event_type = 'page_view' and coalesce(local_time, created_at) is not null",
    "raw",
)
query(
    "read_visitor_clicks",
    lambda s, d: events.read_visitor_clicks(events.legacy_logs(s, d, True)).select("event_id", "event_time", "target_url"),
    f"select 'vc:' || id as event_id, coalesce(local_time, created_at) as event_time, target_url from ({_LEGACY}) where event_type = 'click' and coalesce(local_time, created_at) is not null",
    "raw",
)
query(
    "legacy_log_to_event_json",
    lambda s, d: events.legacy_log_to_event_json(events.legacy_logs(s, d), T.NOW).select("event_id", F.get_json_object("payload", "$.eventType").alias("event_type"), F.get_json_object("payload", "$.geoHint.country").alias("country")),
    f"select 'vl:' || id as event_id, 'page_view' as event_type, hint_country as country from ({_LEGACY}) where event_type = 'page_view' and id % 11 = 0",
    "raw",
)
query(
    "backfill_rollups",
    lambda s, d: maintenance.backfill_rollups(events.legacy_logs(s, d), events.legacy_logs(s, d, True), T.NOW).where("granularity = '1d' and geo_level = 'GLOBAL'").groupBy("event_type").agg(F.sum("event_count").alias("events"), F.sum("unique_sessions").alias("sessions")),
    f"""select event_type, count(*)::bigint as events, count(distinct (date_trunc('day', t), ip_raw, ua_raw))::bigint as sessions
        from (select *, coalesce(local_time, created_at) as t from ({_LEGACY}) where coalesce(local_time, created_at) is not null) group by 1""",
    "raw",
)
