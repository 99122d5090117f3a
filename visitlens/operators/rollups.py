"""Rollups along time and the geographic tree, with exact or approximate sessions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

GRANULARITIES = ("5m", "1d")
KEY = ["site_id", "bucket_time", "granularity", "geo_level", "geo_area_id", "event_type", "device_type", "browser", "os", "is_bot", "country"]
LEDGER = ["site_id", "bucket_time", "granularity", "geo_level", "geo_area_id", "event_type"]
GEO = ["geo_level", "geo_area_id", "country", "region", "metro"]


def geo_ancestors(rows: DataFrame) -> DataFrame:
    """A row for each area that a row counts for; geo_level and geo_area_id are the area's."""
    areas = C.geo_ancestors(*[F.col(c) for c in GEO])
    return rows.withColumn("_area", F.explode(areas)).withColumns({"geo_level": F.col("_area.geo_level"), "geo_area_id": F.col("_area.geo_area_id")}).drop("_area")


def _bucketed(rows: DataFrame, granularities) -> DataFrame:
    buckets = F.array(*[F.struct(C.bucket_floor(F.col("event_time"), g).alias("bucket_time"), F.lit(g).alias("granularity")) for g in granularities])
    return rows.withColumn("_b", F.explode(buckets)).select("*", "_b.bucket_time", "_b.granularity").drop("_b")


def _attributes(enriched: DataFrame) -> DataFrame:
    return enriched.withColumns({c: C.unknown_if_blank(F.col(c)) for c in ("device_type", "browser", "os")})


def _for_key(rows: DataFrame) -> DataFrame:
    return geo_ancestors(rows).withColumn("country", F.coalesce("country", F.lit("")))


def session_hashes(enriched: DataFrame, granularities=GRANULARITIES) -> DataFrame:
    """Events with the hash of their session, once for each of their buckets."""
    key = C.rollup_session_key(F.col("session_id"), F.col("anon_id"), F.col("ip_hash"), F.col("device_type"))
    return _bucketed(_attributes(enriched).withColumn("session_hash", F.sha2(key, 256)), granularities)


def session_claims(enriched: DataFrame, granularities=GRANULARITIES) -> DataFrame:
    """Per (site, bucket, level, area, event type) and session_hash, the attributes of the
    session's first arrival. First arrivals are found per session at the deepest area
    first, so rows shrink before areas multiply them, and no area is a hot key."""
    rows = session_hashes(enriched, granularities)
    order = F.struct("server_time", "event_id")
    what = F.struct("device_type", "browser", "os", "is_bot", F.coalesce("country", F.lit("")).alias("country"))
    deepest = rows.groupBy("site_id", "bucket_time", "granularity", "event_type", "session_hash", *GEO).agg(F.min(F.struct(order.alias("o"), what.alias("w"))).alias("first"))
    firsts = geo_ancestors(deepest).groupBy(*LEDGER, "session_hash").agg(F.min("first").alias("first"))
    return firsts.select(*LEDGER, "session_hash", "first.w.*")


def unique_sessions_exact(enriched: DataFrame, granularities=GRANULARITIES) -> DataFrame:
    """Per rollup key, the sessions whose first arrival for (site, bucket, level, area,
    event type) has that key."""
    return session_claims(enriched, granularities).groupBy(*KEY).agg(F.count("*").alias("unique_sessions"))


def session_sketches(enriched: DataFrame, rsd: float = 0.02, granularities=("5m",)) -> DataFrame:
    """A sketch of the sessions of each ledger key, to be stored: such rows of several
    batches are merged, and those of 5 minutes make up days, without the events."""
    precision = max(4, min(21, round(2 * math.log2(1.04 / rsd))))
    rows = _attributes(enriched).withColumn("session", C.rollup_session_key(F.col("session_id"), F.col("anon_id"), F.col("ip_hash"), F.col("device_type")))
    deepest = _bucketed(rows, granularities).groupBy("site_id", "bucket_time", "granularity", "event_type", *GEO).agg(F.hll_sketch_agg("session", precision).alias("sketch"))
    return merge_sketches(geo_ancestors(deepest))


def merge_sketches(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*LEDGER).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketches_by_day(sketches: DataFrame) -> DataFrame:
    """Sketches of days from those of 5 minutes. Areas are merged each by itself, as a
    session may be in several."""
    rows = sketches.where("granularity = '5m'").withColumns({"bucket_time": C.bucket_floor(F.col("bucket_time"), "1d"), "granularity": F.lit("1d")})
    return merge_sketches(rows)


def estimated_sessions(sketches: DataFrame) -> DataFrame:
    return sketches.select(*LEDGER, F.hll_sketch_estimate("sketch").alias("unique_sessions"))


def unique_sessions_approx(enriched: DataFrame, rsd: float = 0.02, granularities=GRANULARITIES) -> DataFrame:
    """Approximate sessions per ledger key, from sketches that are merged upward."""
    return estimated_sessions(session_sketches(enriched, rsd, granularities))


def event_counts(enriched: DataFrame, granularities=GRANULARITIES) -> DataFrame:
    """Events added up at their deepest area, laid out along its ancestors: rows with the
    rollup key and event_count, not yet added up."""
    deepest = _bucketed(_attributes(enriched), granularities)
    deepest = deepest.groupBy("site_id", "bucket_time", "granularity", "event_type", "device_type", "browser", "os", "is_bot", *GEO).agg(F.count("*").alias("n"))
    return _for_key(deepest).select(*KEY, F.col("n").alias("event_count"))


def rollup_rows(counts: DataFrame, claims: DataFrame) -> DataFrame:
    """Counts and claims added up by rollup key."""
    both = counts.withColumn("unique_sessions", F.lit(0).cast("long")).unionByName(claims.select(*KEY, F.lit(0).cast("long").alias("event_count"), F.lit(1).cast("long").alias("unique_sessions")))
    return both.groupBy(*KEY).agg(F.sum("event_count").alias("event_count"), F.sum("unique_sessions").alias("unique_sessions"))


def rollup_events(enriched: DataFrame, granularities=GRANULARITIES, levels=None) -> DataFrame:
    """Event counts and sessions per rollup key. Events are added up at their deepest
    area before each area's ancestors are laid out."""
    out = rollup_rows(event_counts(enriched, granularities), session_claims(enriched, granularities))
    return out if levels is None else out.where(F.col("geo_level").isin(*levels))


def event_rollups(enriched: DataFrame, granularity: str = "1d", level: str | None = None) -> DataFrame:
    """Event counts alone, of one granularity: what the totals need."""
    deepest = _bucketed(_attributes(enriched), (granularity,))
    deepest = deepest.groupBy("site_id", "bucket_time", "granularity", "event_type", "device_type", "browser", "os", "is_bot", *GEO).agg(F.count("*").alias("n"))
    rows = _for_key(deepest)
    return (rows if level is None else rows.where(F.col("geo_level") == level)).groupBy(*KEY).agg(F.sum("n").alias("event_count"))


def rollup_1d_from_5m(rollups: DataFrame) -> DataFrame:
    """Day totals as sums of the 5-minute rows (sessions are not additive)."""
    rows = rollups.where("granularity = '5m'").withColumns({"bucket_time": C.bucket_floor(F.col("bucket_time"), "1d"), "granularity": F.lit("1d")})
    return rows.groupBy(*KEY).agg(F.sum("event_count").alias("event_count"))


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select(*KEY, "event_count", "unique_sessions").unionByName(new.select(*KEY, "event_count", "unique_sessions"))
    return both.groupBy(*KEY).agg(F.sum("event_count").alias("event_count"), F.sum("unique_sessions").alias("unique_sessions"))


def geo_area_chain(raw: DataFrame) -> DataFrame:
    """Observed hints -> the areas on the way down, with parents and names. A chain
    stops at the first blank part."""
    hint = raw.select(F.col("geo_hint.country").alias("country"), F.col("geo_hint.region").alias("region"), F.col("geo_hint.city").alias("city")).distinct()
    c, r, m = F.col("country"), F.col("region"), F.col("city")
    country_id, region_id = F.concat(F.lit("COUNTRY:"), c), F.concat(F.lit("REGION:"), c, F.lit(":"), r)
    null = F.lit(None).cast("string")

    def area(area_id, level, parent, name, region):
        return F.struct(area_id.alias("geo_area_id"), F.lit(level).alias("geo_level"), parent.alias("parent_id"), name.alias("name"), c.alias("country"), region.alias("region"))

    has_r = ~C.blank(c) & ~C.blank(r)
    areas = F.array(
        F.when(~C.blank(c), area(country_id, "COUNTRY", F.lit("GLOBAL"), c, null)),
        F.when(has_r, area(region_id, "REGION", country_id, r, r)),
        F.when(has_r & ~C.blank(m), area(F.concat(F.lit("METRO:"), c, F.lit(":"), r, F.lit(":"), m), "METRO", region_id, m, r)),
    )
    return hint.select(F.explode(F.array_compact(areas)).alias("a")).select("a.*").distinct()


def geo_centroid(raw: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Areas with coordinates to a tenth of a degree: the newest value that is not null,
    latitude and longitude apart; stored areas keep theirs where nothing new came."""
    hints = raw.select("geo_hint.*", "event_time", "event_id").withColumn("region", F.col("region"))
    c, r, m = F.col("country"), F.col("region"), F.col("city")
    ids = F.array_compact(
        F.array(
            F.when(~C.blank(c), F.concat(F.lit("COUNTRY:"), c)),
            F.when(~C.blank(c) & ~C.blank(r), F.concat(F.lit("REGION:"), c, F.lit(":"), r)),
            F.when(~C.blank(c) & ~C.blank(r) & ~C.blank(m), F.concat(F.lit("METRO:"), c, F.lit(":"), r, F.lit(":"), m)),
        )
    )
    seen = hints.select(F.explode(ids).alias("geo_area_id"), F.struct("event_time", "event_id").alias("o"), C.coarse_degrees(F.col("lat")).alias("lat"), C.coarse_degrees(F.col("lng")).alias("lng"))
    newest = seen.groupBy("geo_area_id").agg(
        F.expr("max_by(lat, o) filter (where lat is not null)").alias("center_lat"), F.expr("max_by(lng, o) filter (where lng is not null)").alias("center_lng")
    )
    out = geo_area_chain(raw).join(newest, "geo_area_id", "left")
    if areas is None:
        return out
    old = areas.select("geo_area_id", *[F.col(x).alias(f"old_{x}") for x in ("geo_level", "parent_id", "name", "country", "region", "center_lat", "center_lng")])
    both = out.join(old, "geo_area_id", "full")
    return both.select("geo_area_id", *[F.coalesce(x, f"old_{x}").alias(x) for x in ("geo_level", "parent_id", "name", "country", "region", "center_lat", "center_lng")])
