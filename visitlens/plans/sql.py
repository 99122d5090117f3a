"""DuckDB SQL of the same tables and queries, written apart from the Spark programs."""

from __future__ import annotations

from ..functions.columns import hmac_pads
from ..operators.enrich import SALT
from ..sources import events as E

NOW = "timestamp '2024-01-31 00:00:00'"
START = "timestamp '2024-01-01 00:00:00'"
END = "timestamp '2024-01-31 00:00:00'"
_INNER, _OUTER = hmac_pads(SALT)


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


#: name -> (SQL, names it needs)
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (sql.strip(), needs)


def with_parts(query: str, *needs: str, recursive: bool = False) -> str:
    """The query behind the CTEs that it needs, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][1]:
            add(n)
        if name not in done:
            done.append(name)

    for n in needs:
        add(n)
    ctes = ",\n".join(f"{n} as ({PARTS[n][0]})" for n in done)
    glue = query.strip()[0] == ","
    return f"with {'recursive ' if recursive else ''}{ctes}\n{query.strip()}" if ctes else query.strip()


part(
    "keyed",
    """
select e.event_id as n, e.ts, e.user_id as u, e.event_type as kind, regexp_extract(e.props, '[0-9]+')::int as k, c.c_nationkey as nk, c.c_mktsegment as seg, n.n_name as nation
from events e left join customer c on e.user_id = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey""",
)
part(
    "raw",
    f"""
select 'e' || n as event_id, n as number, '{E.SITE}' as site_id,
  case kind when 'view' then 'page_view' when 'click' then ({_list(E.CLICKS)})[k % 4 + 1] when 'error' then ({_list(E.READS)})[k % 3 + 1]
       when 'signup' then ({_list(E.SIGNUPS)})[k % 2 + 1] else ({_list(E.OFFERS)})[k % 3 + 1] end as event_type,
  ts as event_time, ts as server_time,
  case when k % 10 <> 0 then 's' || u || '-' || case when day(ts) <= 10 then 'a' when day(ts) <= 20 then 'b' else 'c' end end as session_id,
  case when k % 20 <> 0 then 'a' || u end as anon_id,
  'https://site.example' || ({_list(E.PAGES)})[k % 9 + 1] as page_url,
  case when kind = 'click' then '/work-single/' || (k % 3) end as target_url,
  ({_list(E.REFERRERS)})[u % 5 + 1] as referrer, ({_list(E.USER_AGENTS)})[u % 6 + 1] as ua_raw,
  '10.0.' || (u % 256) || '.' || (k % 2) as ip_raw, nation as hint_country,
  case when u % 7 <> 0 then seg end as hint_region, case when u % 7 <> 0 and u % 3 <> 0 then 'city' || (u % 4) end as hint_city,
  nk * 6.5::double - 77.7::double as lat, nk * 13.1::double - 160.3::double as lng,
  'c' || (k % 12) as content_id, case when k % 2 = 0 then 'PROJECT' else 'BLOG' end as content_type, (k % 5) * 25 as progress, k as seconds
from keyed""",
    "keyed",
)
part(
    "agents",
    """
select *, case when trim(ua_raw) = '' then 'unknown'
    when regexp_matches(ua_raw, '(?i)\\b(bot|spider|crawl|scraper|preview|monitor|http|wget|curl|python|go-http|java/)\\b') then 'bot'
    when regexp_matches(ua_raw, '(?i)\\b(ipad|tablet)\\b') then 'tablet' when regexp_matches(ua_raw, '(?i)\\b(iphone|android|mobile|ipod)\\b') then 'mobile' else 'desktop' end as device_type,
  case when contains(lower(ua_raw), 'edg/') then 'Edge' when contains(lower(ua_raw), 'opr/') or contains(lower(ua_raw), 'opera') then 'Opera'
    when contains(lower(ua_raw), 'firefox/') then 'Firefox' when contains(lower(ua_raw), 'chrome/') then 'Chrome' when contains(lower(ua_raw), 'safari/') then 'Safari' else 'unknown' end as browser,
  case when contains(lower(ua_raw), 'windows') then 'Windows' when regexp_matches(ua_raw, '(?i)iphone|ipad|ipod') then 'iOS'
    when regexp_matches(ua_raw, '(?i)mac os x|macintosh') then 'macOS' when contains(lower(ua_raw), 'android') then 'Android' when contains(lower(ua_raw), 'linux') then 'Linux' else 'unknown' end as os
from raw""",
    "raw",
)
part(
    "enriched",
    f"""
select * exclude (score, hint_country, hint_region, hint_city), score as bot_score, score >= 0.8 as is_bot,
  sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(trim(ip_raw))))) as ip_hash,
  case when hint_city is not null and hint_country is not null then 'METRO' when hint_region is not null then 'REGION' else 'COUNTRY' end as geo_level,
  case when hint_city is not null then 'METRO:' || hint_country || ':' || coalesce(hint_region, '') || ':' || hint_city
       when hint_region is not null then 'REGION:' || hint_country || ':' || hint_region else 'COUNTRY:' || hint_country end as geo_area_id,
  hint_country as country, hint_region as region, hint_city as metro
from (select *, least(1.0, case device_type when 'bot' then 1.0 when 'unknown' then 0.5 else 0.0 end
        + case when coalesce(referrer, '') = '' and device_type <> 'mobile' then 0.1 else 0.0 end)::double as score from agents)""",
    "agents",
)
part(
    "facts",
    """
select event_id, number, site_id, event_type as event_name, event_time, server_time, coalesce(session_id, anon_id, ip_hash || ':' || device_type) as session_id,
  anon_id as anon_id_hash, regexp_extract(regexp_replace(page_url, '^https?://[^/]*', ''), '^[^?#]*') as page_path, target_url as target_path,
  regexp_extract(referrer, '^(?:https?://)?([^/?#]+)', 1) as referrer_domain, device_type, browser, os, is_bot, ip_hash, country, region, geo_area_id,
  content_id, content_type, progress, seconds
from enriched""",
    "enriched",
)
part(
    "placed",
    """
select e.*, a.level as a_level, a.id as a_id from enriched e, lateral (
  select unnest(['GLOBAL', 'COUNTRY', 'REGION', 'METRO']) as level,
         unnest(['GLOBAL', 'COUNTRY:' || country, 'REGION:' || country || ':' || region, 'METRO:' || country || ':' || coalesce(region, '') || ':' || metro]) as id) a
where a.id is not null""",
    "enriched",
)
part(
    "bucketed",
    """
select p.*, b.g as granularity, case b.g when '1d' then date_trunc('day', event_time)
    else date_trunc('hour', event_time) + to_minutes((minute(event_time) // 5 * 5)::int) end::timestamp as bucket_time
from placed p, (select unnest(['5m', '1d']) as g) b""",
    "placed",
)
part(
    "rollups",
    """
select site_id, bucket_time, granularity, a_level as geo_level, a_id as geo_area_id, event_type, device_type, browser, os, is_bot, country,
  count(*)::bigint as event_count, sum(first)::bigint as unique_sessions
from (select *, (row_number() over (partition by site_id, bucket_time, granularity, a_level, a_id, event_type,
        coalesce(session_id, anon_id, coalesce(ip_hash, 'null') || ':' || device_type) order by server_time, event_id) = 1)::int as first from bucketed)
group by all""",
    "bucketed",
)
part(
    "sessions",
    """
select site_id, session_id, min(event_time) as first_event, max(event_time) as last_event, count(*) filter (where event_name = 'page_view')::bigint as page_views,
  count(*) filter (where event_name in ('outbound_link_clicked', 'search_result_clicked', 'recommendation_click'))::bigint as clicks,
  (list(page_path order by event_time, event_id) filter (where page_path is not null))[1] as entry_page,
  (list(page_path order by event_time desc, event_id desc) filter (where page_path is not null))[1] as exit_page, max(anon_id_hash) as anon_id,
  max(device_type) as device_type, max(browser) as browser, max(os) as os, max(country) as country, max(geo_area_id) as geo_area_id,
  greatest(0, epoch_us(max(event_time)) // 1000 - epoch_us(min(event_time)) // 1000)::bigint as duration_ms
from facts where session_id is not null group by site_id, session_id""",
    "facts",
)
part(
    "funnel",
    """
select event_id, session_id_ as session_id, site_id, event_type as step_name, page_url, event_type, event_time,
  list_position(['content_open', 'read_progress', 'subscribe_started', 'subscribe_verified'], event_type)::int as step_order
from (select *, coalesce(session_id, anon_id, ip_hash || ':' || device_type) as session_id_ from enriched)
where event_type in ('content_open', 'read_progress', 'subscribe_started', 'subscribe_verified')""",
    "enriched",
)
part(
    "areas",
    """
select a.id as geo_area_id, any_value(a.level) as geo_level, any_value(a.parent) as parent_id, any_value(a.name) as name, any_value(hint_country) as country,
  any_value(a.region) as region, arg_max(floor(lat * 10 + 0.5) / 10, (event_time, event_id)) as center_lat, arg_max(floor(lng * 10 + 0.5) / 10, (event_time, event_id)) as center_lng
from raw r, lateral (
  select unnest(['COUNTRY', 'REGION', 'METRO']) as level, unnest(['COUNTRY:' || hint_country, 'REGION:' || hint_country || ':' || hint_region,
    'METRO:' || hint_country || ':' || hint_region || ':' || hint_city]) as id,
    unnest(['GLOBAL', 'COUNTRY:' || hint_country, 'REGION:' || hint_country || ':' || hint_region]) as parent, unnest([hint_country, hint_region, hint_city]) as name,
    unnest([null, hint_region, hint_region]) as region) a
where a.id is not null group by a.id""",
    "raw",
)
SINCE = f"({NOW} - interval 30 day)"
