"""Column rules of visitor events. All are native expressions: no Python workers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# User-agent markers, in order of precedence.
BOT_WORDS = r"(?i)\b(bot|spider|crawl|scraper|preview|monitor|http|wget|curl|python|go-http|java/)\b"
TABLET_WORDS = r"(?i)\b(ipad|tablet)\b"
MOBILE_WORDS = r"(?i)\b(iphone|android|mobile|ipod)\b"
BROWSERS = (("Edge", ("edg/",)), ("Opera", ("opr/", "opera")), ("Firefox", ("firefox/",)), ("Chrome", ("chrome/",)), ("Safari", ("safari/",)))
SYSTEMS = (
    ("Windows", ("windows",)),
    ("iOS", ("iphone", "ipad", "ipod")),
    ("macOS", ("mac os x", "macintosh")),
    ("Android", ("android",)),
    ("Linux", ("linux",)),
)
# The property keys that may leave the private tier.
PROPERTY_KEYS = (
    "contentId", "contentType", "category", "progressPercent", "engagedSeconds", "component", "action", "campaign",
    "experimentId", "variant", "recommendationRequestId", "rank", "modelVersion", "resultCount",
)
CONSENT = ("granted", "denied", "unknown")
LEVELS = {"COUNTRY": "COUNTRY", "WORLD": "COUNTRY", "CONTINENT": "COUNTRY", "REGION": "REGION", "METRO": "METRO", "LOCAL": "METRO"}
WINDOWS = {"7d": 7, "30d": 30, "90d": 90, "all": None}
LOOPBACK_URL = r"(?i)^(https?://|//)?(localhost|([a-z0-9-]+\.)+localhost|127(\.[0-9]{1,3}){3}|\[?::1\]?)(:[0-9]+)?([/?#]|$)"
LOOPBACK_IP = r"(?i)^(127(\.[0-9]{1,3}){3}|::1|0:0:0:0:0:0:0:1)$"


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | ~c.rlike(r"\S")


def filled(c: Column) -> Column:
    """The text, or null where it is blank."""
    return F.when(~blank(c), c)


def unknown_if_blank(c: Column) -> Column:
    return F.coalesce(filled(c), F.lit("unknown"))


def in_parts(c: Column) -> Column:
    """``c`` by way of a higher-order function. A projection that has one is compiled as
    many small methods; a wide one without becomes a single method, and the JVM leaves
    methods of more than 8000 bytes of code to its interpreter."""
    return F.transform(F.array(c), lambda x: x)[0]


# ---------------------------------------------------------------- user agent, bots


def ua_device(ua: Column) -> Column:
    return (
        F.when(blank(ua), "unknown").when(ua.rlike(BOT_WORDS), "bot").when(ua.rlike(TABLET_WORDS), "tablet").when(ua.rlike(MOBILE_WORDS), "mobile").otherwise("desktop")
    )


def _first_marker(ua: Column, table) -> Column:
    low = F.lower(ua)
    out = F.when(blank(ua), "unknown")
    for name, markers in table:
        hit = F.lit(False)
        for m in markers:
            hit = hit | low.contains(m)
        out = out.when(hit, name)
    return out.otherwise("unknown")


def ua_browser(ua: Column) -> Column:
    return _first_marker(ua, BROWSERS)


def ua_os(ua: Column) -> Column:
    return _first_marker(ua, SYSTEMS)


def bot_score(device: Column, referrer: Column) -> Column:
    base = F.when(device == "bot", 1.0).when(device == "unknown", 0.5).otherwise(0.0)
    return F.when(blank(referrer) & ~device.eqNullSafe("mobile"), F.least(F.lit(1.0), base + 0.1)).otherwise(base)


def is_bot(score: Column) -> Column:
    return score >= 0.8


# ---------------------------------------------------------------- identity


def hmac_pads(salt: str) -> tuple[str, str]:
    """Inner and outer pad of an HMAC-SHA-256 key, as hex."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def ip_hash(ip: Column, incoming: Column, salt: str) -> Column:
    """Keyed hash of the trimmed address; a hash that came with the event wins."""
    inner, outer = (F.unhex(F.lit(p)) for p in hmac_pads(salt))
    first = F.sha2(F.concat(inner, F.encode(F.trim(ip), "UTF-8")), 256)
    return in_parts(F.coalesce(filled(incoming), F.when(~blank(ip), F.sha2(F.concat(outer, F.unhex(first)), 256))))


def _identity(session: Column, anon: Column, rest: Column) -> Column:
    return F.coalesce(filled(session), filled(anon), rest)


def session_key(session: Column, anon: Column, ip: Column, device: Column) -> Column:
    return _identity(session, anon, F.when(~blank(ip), F.concat(ip, F.lit(":"), unknown_if_blank(device))))


def rollup_session_key(session: Column, anon: Column, ip: Column, device: Column) -> Column:
    """As ``session_key``, but a missing address is the text ``null``."""
    return _identity(session, anon, F.concat(F.coalesce(ip, F.lit("null")), F.lit(":"), unknown_if_blank(device)))


# ---------------------------------------------------------------- geography


def geo_snap(country: Column, region: Column, city: Column) -> Column:
    """The deepest area which the hint names: level, area id, country, region, metro."""

    def area(level: str, area_id: Column, c=None, r=None, m=None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(level).alias("geo_level"), area_id.alias("geo_area_id"), (null if c is None else c).alias("country"),
            (null if r is None else r).alias("region"), (null if m is None else m).alias("metro"),
        )

    metro = F.concat(F.lit("METRO:"), country, F.lit(":"), F.coalesce(region, F.lit("")), F.lit(":"), city)
    return (
        F.when(~blank(city) & ~blank(country), area("METRO", metro, country, region, city))
        .when(region.isNotNull() & country.isNotNull(), area("REGION", F.concat(F.lit("REGION:"), country, F.lit(":"), region), country, region))
        .when(country.isNotNull(), area("COUNTRY", F.concat(F.lit("COUNTRY:"), country), country))
        .otherwise(area("GLOBAL", F.lit("GLOBAL")))
    )


def geo_ancestors(level: Column, area_id: Column, country: Column, region: Column, metro: Column) -> Column:
    """All areas that an event counts for, as an array of (geo_level, geo_area_id)."""

    def area(name: str, *parts: Column, when: Column | None = None) -> Column:
        s = F.struct(F.lit(name).alias("geo_level"), F.concat_ws(":", F.lit(name), *parts).alias("geo_area_id"))
        return s if when is None else F.when(when, s)

    has = ~blank(country)
    own = F.struct(level.alias("geo_level"), area_id.alias("geo_area_id"))
    return F.array_distinct(
        F.array_compact(
            F.array(
                area("GLOBAL"),
                area("COUNTRY", country, when=has),
                area("REGION", country, region, when=has & ~blank(region)),
                area("METRO", country, F.coalesce(region, F.lit("")), metro, when=has & ~blank(metro)),
                F.when(~blank(area_id), own),
            )
        )
    )


def coarse_degrees(c: Column) -> Column:
    """Tenths of a degree, halves upward."""
    return F.floor(c * 10 + 0.5) / 10


# ---------------------------------------------------------------- URLs


def path_only(url: Column) -> Column:
    """The decoded path of a URL or a relative path, at most 512 characters."""
    full = F.when(url.startswith("/"), F.concat(F.lit("https://local"), url)).otherwise(url)
    path = F.try_parse_url(full, F.lit("PATH"))
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.when(~blank(url), F.substring(F.coalesce(decoded, F.split(url, "[?#]")[0]), 1, 512))


def domain_only(url: Column) -> Column:
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(~blank(url), F.substring(F.try_parse_url(full, F.lit("HOST")), 1, 255))


# ---------------------------------------------------------------- properties


def sanitize_properties(props: Column) -> Column:
    """Allowed keys with scalar values; nested JSON comes as its text and is left out."""
    return F.map_filter(
        F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PROPERTY_KEYS) & v.isNotNull() & ~F.ltrim(v).rlike(r"^[\[{]")
    )


def normalize_consent(c: Column) -> Column:
    return F.when(c.isin(*CONSENT), c).otherwise("unknown")


def property_text(props: Column, key: str) -> Column:
    return F.substring(F.trim(F.try_element_at(props, F.lit(key))), 1, 256)


def bounded_int(props: Column, key: str, most: int) -> Column:
    """A number, rounded down, held within 0 and ``most``; null if it is none."""
    n = F.try_element_at(props, F.lit(key)).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.floor(n).cast("double"))).cast("int"))


def bounded_int_strict(props: Column, key: str, most: int) -> Column:
    """As ``bounded_int`` for digits (and a fraction, rounded) only."""
    text = F.try_element_at(props, F.lit(key))
    n = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("decimal(38,6)"))
    return F.least(F.lit(most), F.greatest(F.lit(0), F.round(n).try_cast("bigint"))).cast("int")


def clean_technical_domains(values: Column, most: int = 20) -> Column:
    trimmed = F.transform(values, lambda v: F.trim(v))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))), 1, most)


# ---------------------------------------------------------------- time


def bucket_floor(ts: Column, granularity: str) -> Column:
    if granularity == "1d":
        return F.date_trunc("DAY", ts).cast("timestamp_ntz")
    if granularity == "5m":
        return F.date_trunc("HOUR", ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.floor(F.minute(ts) / 5) * 5).cast("int"))
    raise ValueError(f"unsupported granularity: {granularity}")


def window_days(window: str | None = None, days: int | None = None) -> int | None:
    """Days of a named window, or None for all time; 30 days if neither is given."""
    if window:
        name = window.strip().lower()
        if name not in WINDOWS:
            raise ValueError(f"unknown window: {window}")
        return WINDOWS[name]
    if days is not None:
        return days if days > 0 else None
    return 30


def time_window_filter(ts: Column, window: str | None, now: str, days: int | None = None) -> Column:
    n = window_days(window, days)
    return F.lit(True) if n is None else ts >= F.expr(f"timestamp_ntz '{now}' - interval {n} days")


def range_filter(ts: Column, start: str, end: str) -> Column:
    """start <= ts < end, at most 31 days."""
    import datetime as dt

    a, b = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
    if not a < b or b - a > dt.timedelta(days=31):
        raise ValueError("the range has to be positive and of 31 days at most")
    return (ts >= F.expr(f"timestamp_ntz '{start}'")) & (ts < F.expr(f"timestamp_ntz '{end}'"))


# ---------------------------------------------------------------- predicates


def validate_required(event_id: Column, event_type: Column, site_id: Column) -> Column:
    return ~blank(event_id) & event_type.isNotNull() & site_id.isNotNull()


def level_name(level: str | None) -> str | None:
    """The level that a name or alias stands for; None lets all through."""
    if not level or not level.strip():
        return None
    name = level.strip().upper()
    if name == "GLOBAL":
        raise ValueError("level GLOBAL has no markers")
    return LEVELS.get(name)


def level_filter(column: Column, level: str | None) -> Column:
    name = level_name(level)
    return F.lit(True) if name is None else column == name


def bbox_filter(lat: Column, lng: Column, box: tuple[float, float, float, float] | None, window: str | None = None) -> Column:
    """(min lat, max lat, min lng, max lng); a box may cross the date line."""
    if box is None:
        return F.lit(True)
    south, north = (max(-89.9, min(89.9, v)) for v in (min(box[:2]), max(box[:2])))
    west, east = (((v + 180) % 360) - 180 for v in box[2:])
    width = max(0.0, east - west) if west <= east else (180 - west) + (east + 180)
    if window == "all" and (north - south) * width > 32_400:
        raise ValueError("the box is too large for all time")
    inside = lng.between(west, east) if west <= east else (lng >= west) | (lng <= east)
    return lat.between(south, north) & inside


def exclude_admin_prefix(path: Column, prefix: str = "/admin", mode: str = "children", url: Column | None = None) -> Column:
    """children: the page or its children, null paths stay; like: anything that begins
    with the prefix; lower: as children, lower-cased, from the raw URL if need be."""
    if mode == "children":
        return path.isNull() | ((path != prefix) & ~path.startswith(prefix + "/"))
    if mode == "like":
        return ~F.coalesce(path, F.lit("")).startswith(prefix)
    if mode == "lower":
        raw = F.coalesce(url if url is not None else F.lit(None).cast("string"), F.lit(""))
        raw = F.split(F.split(F.regexp_replace(raw, r"(?i)^https?://[^/]+", ""), r"\?")[0], "#")[0]
        low, prefix = F.lower(F.coalesce(F.nullif(path, F.lit("")), raw, F.lit(""))), prefix.strip().lower()
        return (low != prefix) & ~low.startswith(prefix + "/")
    raise ValueError(f"unknown mode: {mode}")


def exclude_loopback(url: Column, target: Column, referrer: Column, ip: Column) -> Column:
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return ~(text(url).rlike(LOOPBACK_URL) | text(target).rlike(LOOPBACK_URL) | text(referrer).rlike(LOOPBACK_URL) | text(ip).rlike(LOOPBACK_IP))


def exact_filter(c: Column, value: str | None) -> Column:
    return F.lit(True) if not value or not value.strip() else F.lower(F.coalesce(c, F.lit(""))) == value.strip().lower()


def contains_filter(c: Column, value: str | None) -> Column:
    return F.lit(True) if not value or not value.strip() else F.lower(c).contains(value.strip().lower())


def free_text_filter(columns: list[Column], value: str | None) -> Column:
    return contains_filter(F.concat_ws(" ", *columns), value)


def min_bucket_filter(count: Column, n: int = 5) -> Column:
    return count >= n


def rule_match(rule: dict[str, Column], step: dict[str, Column]) -> Column:
    """Whether a rule's conditions hold for a journey step; null conditions always do."""

    def given(name: str, test: Column) -> Column:
        return rule[name].isNull() | F.coalesce(test, F.lit(False)) if name not in ("event_name", "content_type") else blank(rule[name]) | F.coalesce(test, F.lit(False))

    def path(source: str, column: Column) -> Column:
        hit = F.when(rule["path_match_type"] == "EXACT", column == rule["path_pattern"]).when(
            rule["path_match_type"] == "PREFIX", column.startswith(rule["path_pattern"])
        )
        return rule["path_source"].isin("ANY", source) & F.coalesce(hit, F.lit(False))

    out = (rule["path_match_type"] == "ANY") | path("PAGE", step["page_path"]) | path("TARGET", step["target_path"])
    out = out & given("event_name", rule["event_name"] == step["event_name"])
    if "content_type" in rule:
        out = out & given("content_type", F.lower(rule["content_type"]) == F.lower(step["content_type"]))
        out = out & given("min_engaged_seconds", step["engaged_seconds"] >= rule["min_engaged_seconds"])
        out = out & given("min_progress_percent", step["progress_percent"] >= rule["min_progress_percent"])
    return out


def fires(measured: Column, threshold: Column, comparator: Column) -> Column:
    """False for a comparator that is none: such a rule is invalid."""
    return F.coalesce(F.when(comparator == ">=", measured >= threshold).when(comparator == "<=", measured <= threshold), F.lit(False))


def small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """A configuration table, to be broadcast: rules that people write. More than
    ``most`` rows are an error and not a plan that fails later."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"a rule table of more than {most} rows")
    return F.broadcast(table)
