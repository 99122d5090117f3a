"""Streaming forms: ingestion per micro-batch, and stateful operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions import columns as C
from ..operators import alerts, dedup, enrich, journeys, maintenance, read_models, rollups
from ..scratch import delete
from ..sources import events
from . import state
from .commits import CommitLog, Files


@dataclass(frozen=True)
class Config:
    """Where the tables are, and the parameters of ingestion. ``now`` fixes the clock
    (None: each batch has the time of its first try). ``intent`` has the policies, signal
    rules and content metadata that snapshots are scored by (None: no snapshots). Tables
    by key are compacted once they have more than ``open_deltas`` deltas; with
    ``retention``, what is past its time is left out then."""

    root: str
    now: str | None = None
    salt: str = enrich.SALT
    throttle_seconds: int = 300
    granularities: tuple[str, ...] = rollups.GRANULARITIES
    open_deltas: int = 16
    retention: bool = False
    intent: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def clock(self) -> str:
        return self.now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")


SESSION = read_models.SESSION
#: tables by key: what they are keyed by, and how their parts are merged
KEYED = {
    "inbox": (["event_id"], lambda parts: parts.groupBy("event_id").agg(F.min("received_at").alias("received_at"))),
    "visits": (dedup.VISIT, lambda parts: parts.groupBy(*dedup.VISIT).agg(F.max("last").alias("last"))),
    "ledger": ([*rollups.LEDGER, "session_hash"], lambda parts: parts.distinct()),
    "rollups": (rollups.KEY, lambda parts: parts.groupBy(*rollups.KEY).agg(*[F.sum(c).alias(c) for c in ("event_count", "unique_sessions")])),
    "sketches": (rollups.LEDGER, rollups.merge_sketches),
    "session_parts": (SESSION, read_models.merge_session_parts),
    "intent_parts": (SESSION, journeys.merge_intent_parts),
    "intent_spans": (SESSION, journeys.intent_spans),
}


def ingest_batch(records: DataFrame, cfg: Config, batch_id: int, stream: str = "main") -> None:
    """JSON records -> dead letters, inbox, enriched events, raw tier, facts, legacy log,
    operation timeline, journey and funnel steps, and what they add to sessions, intent
    snapshots and rollups, as one unit: readers see all of a batch or nothing, and a batch
    that runs again, at whatever time, changes nothing. An id that any batch has claimed
    is not taken again, whether it was let through or throttled; the throttle goes on
    from the last view that was let through, of whatever day."""
    spark, log = records.sparkSession, CommitLog(records.sparkSession, cfg.root)
    begun = log.begin(stream, batch_id, cfg.clock())
    if begun is None:
        return
    number, now = begun
    valid, rejected = enrich.split_valid_dlq(events.parse_raw_events(records))
    log.write(enrich.dlq_rows(rejected), "dlq", number)

    def dated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("day", F.to_date("event_time"))

    def known(name: str, of: DataFrame) -> DataFrame | None:
        return log.parts(name, KEYED[name][0], of)

    first = dedup.dedup_inbox(valid)
    seen = known("inbox", first)
    fresh = first if seen is None else first.join(seen.select("event_id"), "event_id", "left_anti")
    fresh = log.write(fresh.withColumn("event_time", F.coalesce("event_time", F.expr(f"timestamp_ntz '{now}'"))), "claimed", number)
    log.write(fresh.select("event_id", F.expr(f"timestamp_ntz '{now}'").alias("received_at")), "inbox", number)

    enriched = log.write(enrich.enrich_events(fresh, now, cfg.salt), "arrived", number)
    marks = known("visits", dedup.visit_keys(enriched).where("_counts"))
    marks = None if marks is None else KEYED["visits"][1](marks)
    mine = log.write(dated(dedup.throttle_visits(enriched, cfg.throttle_seconds, marks)), "enriched", number, "day").drop("day")
    log.write(dedup.visit_keys(mine).where("_counts").groupBy(*dedup.VISIT).agg(F.max(dedup.micros()).alias("last")), "visits", number)

    kept = fresh.join(mine.select("event_id"), "event_id", "left_semi")
    log.write(dated(enrich.raw_tier(kept)), "raw", number, "day")
    facts = log.write(dated(enrich.facts(mine)), "facts", number, "day")
    log.write(enrich.legacy_log(mine), "legacy_log", number)
    log.write(enrich.operation_timeline(mine, now), "timeline", number)
    steps = log.write(dated(journeys.journey_steps(mine)), "journey_steps", number, "day")
    log.write(dated(read_models.funnel_steps(mine)), "funnel_steps", number, "day")

    log.write(read_models.session_parts(facts), "session_parts", number)
    if cfg.intent is not None:
        _, rules, metadata = cfg.intent
        log.write(journeys.intent_parts(steps, rules, metadata).withColumn("as_of", F.lit(number).cast("long")), "intent_parts", number)
        log.write(journeys.intent_spans(steps), "intent_spans", number)
    claims = rollups.session_claims(mine, cfg.granularities)
    claimed, keys = known("ledger", claims), KEYED["ledger"][0]
    claims = log.write(claims if claimed is None else claims.join(claimed.select(*keys), keys, "left_anti"), "claims", number)
    log.write(claims.select(*keys), "ledger", number)
    log.write(rollups.rollup_rows(rollups.event_counts(mine, cfg.granularities), claims), "rollups", number)

    log.write(rollups.session_sketches(mine), "sketches", number)

    log.commit(stream, batch_id, number)
    for name in ("claimed", "arrived", "claims"):
        delete(spark, f"{cfg.root}/{name}/batch_id={number}")
    for name, (keys, merge) in KEYED.items():
        if cfg.intent is not None or not name.startswith("intent"):
            log.compact(name, keys, merge if not cfg.retention else _kept(name, merge, now), cfg.open_deltas)


#: tables by key that retention looks at, by the name that it has for them
RETAINED = {"inbox": "inbox", "ledger": "rollup_sessions", "rollups": "rollups", "sketches": "rollups", "session_parts": "sessions", "intent_spans": "snapshots"}


def _kept(name: str, merge, now: str):
    """Merge, and leave out what is past its time."""
    return lambda parts: maintenance.apply_retention(merge(parts), RETAINED[name], now)[0] if name in RETAINED else merge(parts)


def table(spark, cfg: Config, name: str) -> DataFrame:
    """The committed rows of a table; of tables by key, merged."""
    log = CommitLog(spark, cfg.root)
    if name in KEYED:
        keys, merge = KEYED[name]
        return merge(log.parts(name, keys))
    return log.table(name)


def approximate_sessions(spark, cfg: Config, by_day: bool = True) -> DataFrame:
    """From the stored sketches alone."""
    stored_ones = table(spark, cfg, "sketches")
    return rollups.estimated_sessions(rollups.sketches_by_day(stored_ones) if by_day else stored_ones)


def sessions(spark, cfg: Config) -> DataFrame:
    return read_models.sessions_of(table(spark, cfg, "session_parts"))


def snapshots(spark, cfg: Config) -> DataFrame:
    """Intent snapshots of all sessions, of what their signals said when last matched."""
    policy = journeys.active_policy(cfg.intent[0])
    return journeys.score_parts(table(spark, cfg, "intent_parts"), table(spark, cfg, "intent_spans"), policy)


def stream_ingest(records: DataFrame, cfg: Config, checkpoint: str) -> StreamingQuery:
    writer = records.writeStream.foreachBatch(lambda df, i: ingest_batch(df, cfg, i, checkpoint)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def alert_now(spark, cfg: Config, rules: DataFrame) -> None:
    """Evaluate the rules on the committed rollups at this time's clock; new incidents are
    appended once, by their key."""
    now, old = cfg.clock(), stored(spark, cfg.path("incidents"))
    hits = alerts.evaluate_alerts(table(spark, cfg, "rollups"), rules, now)
    hits = hits if old is None else alerts.apply_cooldown(hits, old, now)
    maintenance.append_absent(alerts.open_incidents(hits, old, now), cfg.path("incidents"), "dedup_key")


def stored(spark, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if Files(spark).exists(path) else None


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay)


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _start(writer: DataStreamWriter, spark, **trigger) -> StreamingQuery:
    """Start with a trigger. State that expires by the clock asks for one more batch after
    each; a stream that ends with what is there now must not wait for that to stop."""
    before = spark.conf.get(NO_DATA)
    if "availableNow" in trigger:
        spark.conf.set(NO_DATA, "false")
    try:
        return writer.trigger(**trigger).start()
    finally:
        spark.conf.set(NO_DATA, before)


def _seconds(interval: str) -> float:
    return pd.Timedelta(interval).total_seconds()


# ---------------------------------------------------------------- state by key


def stream_rollups(enriched: DataFrame, root: str, checkpoint: str, granularities=rollups.GRANULARITIES, open_deltas: int = 16, **trigger) -> StreamingQuery:
    """Enriched events -> what each batch adds to the rollups, in a commit log's tables.
    Sessions are claimed in state by session, so no area or site is a hot key; the rows of
    a batch are added up before they are written, and a late event adds to its own buckets
    and touches no others. ``rollups_of`` reads them."""
    areas = C.geo_ancestors(*[F.col(c) for c in rollups.GEO])
    rows = rollups.session_hashes(enriched, granularities).withColumn("_areas", areas)
    rows = rows.select(
        "site_id", F.unix_micros(F.col("bucket_time").cast("timestamp")).alias("bucket"), "granularity", "event_type", "session_hash", F.unix_micros(F.col("server_time").cast("timestamp")).alias("at"), F.coalesce("event_id", F.lit("")).alias("event_id"),
        "device_type", "browser", "os", "is_bot", F.coalesce("country", F.lit("")).alias("country"), F.transform("_areas", lambda a: a["geo_level"]).alias("levels"), F.transform("_areas", lambda a: a["geo_area_id"]).alias("ids"),
    )
    added = rows.groupBy("site_id", "bucket", "granularity", "event_type", "session_hash").transformWithState(state.SessionLedger(granularities), state.SessionLedger.SCHEMA, "Append", "ProcessingTime")

    def write(df: DataFrame, batch_id: int) -> None:
        log = CommitLog(df.sparkSession, root)
        begun = log.begin(checkpoint, batch_id, "")
        if begun is not None:
            parts = df.withColumn("bucket_time", F.timestamp_micros("bucket").cast("timestamp_ntz")).select(*rollups.KEY, "event_count", "unique_sessions")
            keys, merge = KEYED["rollups"]
            log.write(merge(parts), "rollups", begun[0])
            log.commit(checkpoint, batch_id, begun[0])
            log.compact("rollups", keys, merge, open_deltas)

    writer = added.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return _start(writer, enriched.sparkSession, **(trigger or {"availableNow": True}))


def rollups_of(spark, root: str) -> DataFrame:
    return table(spark, Config(root), "rollups")


def rollup_deltas(spark, root: str) -> DataFrame:
    """What batches add to the rollups, as a stream. Folders that compaction has merged are
    deleted one compaction later."""
    log = CommitLog(spark, root)
    return spark.readStream.schema(log.schema("rollups")).parquet(f"{root}/rollups/batch_id=*")


def stream_alerts(deltas: DataFrame, rules: DataFrame, path: str, checkpoint: str, tick_seconds: int = 60, lookback: int = 2, **trigger) -> StreamingQuery:
    """Rollup deltas and alert rules, both streams -> incidents at ``path``. Rules are
    evaluated by the clock, every ``tick_seconds``, whether events come or not: of the
    newest ``lookback`` buckets the newest that fires opens an incident, unless the rule
    has opened one within its cooldown or for that bucket. State is kept by site, event
    type, level and granularity; a new version of a rule replaces the one before."""
    where = ["site_id", "event_type", "geo_level", "granularity"]
    epoch = F.unix_seconds(F.col("bucket_time").cast("timestamp"))
    given = {"rule_id": "long", "name": "string", "threshold": "long", "comparator": "string", "cooldown_seconds": "long", "enabled": "boolean", "version": "long"}
    said = rules.select(*where, F.coalesce("geo_area_id", F.lit("")).alias("area"), *[F.col(c).cast(t).alias(c) for c, t in given.items()], F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("n"))
    counted = deltas.select(*where, F.col("geo_area_id").alias("area"), *[F.lit(None).cast(t).alias(c) for c, t in given.items()], epoch.alias("bucket"), F.col("event_count").cast("long").alias("n"))
    both = said.unionByName(counted).groupBy(*where).transformWithState(state.AlertClock(tick_seconds, lookback), state.AlertClock.SCHEMA, "Append", "ProcessingTime")
    key = F.concat_ws("|", F.col("rule_id").cast("string"), "geo_area_id", "granularity", F.col("bucket").cast("string"))
    out = both.select(
        key.alias("dedup_key"), "rule_id", "site_id", "rule_name", "geo_area_id", "granularity", F.timestamp_seconds("bucket").cast("timestamp_ntz").alias("bucket_time"), "measured_value", "threshold", "comparator",
        "rule_version", F.timestamp_millis("created").cast("timestamp_ntz").alias("created_at"),
    )
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return _start(writer, rules.sparkSession, **(trigger or {"processingTime": "10 seconds"}))


def stream_dedup(stream: DataFrame, path: str, checkpoint: str, seconds: int = 86_400, inbox: DataFrame | None = None, keep: str = "7 days") -> StreamingQuery:
    """Events whose id was not let through within the ``seconds`` before their arrival
    (server_time). Ids are state of their own, from when they were let through; ``inbox``
    (event_id, received_at) fills it at the first start. An id is kept for ``keep`` of the
    clock, which has to be longer than any stop of the stream."""
    ms = int(_seconds(keep) * 1000)
    arrivals = F.unix_micros(F.col("server_time").cast("timestamp"))
    rows = stream.select(F.coalesce("event_id", F.lit("")).alias("_id"), arrivals.alias("_at"), F.struct(*stream.columns).alias("_row"))
    start = None
    if inbox is not None:
        start = inbox.select(F.coalesce("event_id", F.lit("")).alias("_id"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("_at")).groupBy("_id")
    out = rows.groupBy("_id").transformWithState(state.FirstSeen(seconds, ms), rows.select("_row").schema, "Append", "ProcessingTime", start)
    writer = out.select("_row.*").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return _start(writer, stream.sparkSession, availableNow=True)


def stream_rate_limit(stream: DataFrame, path: str, checkpoint: str, seconds: int = 60, limit: int = 120, delay: str = "10 minutes") -> StreamingQuery:
    """Requests (ip, event_time) per address and fixed window, once a window is closed."""
    rows = _timed(stream, delay).groupBy(F.window("event_time", f"{seconds} seconds"), "ip").agg(F.count("*").alias("requests"))
    out = rows.select("ip", F.col("window.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("over"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_throttle(stream: DataFrame, path: str, checkpoint: str, seconds: int = 300, keep: str = "1 day") -> StreamingQuery:
    """Event ids of page views that are let through. Needs the RocksDB state store. What is
    known of a key goes ``keep`` of the clock after its last view was let through, or after
    the throttle's own time where that is longer."""
    key = C.session_key(F.col("session_id"), F.col("anon_id"), F.col("ip_hash"), F.col("device_type"))
    views = stream.where((F.col("event_type") == "page_view") & key.isNotNull() & ~C.blank(F.col("page_url")))
    rows = views.select("site_id", key.alias("visitor"), "page_url", "event_id", F.unix_micros(F.col("event_time").cast("timestamp")).alias("t"))
    ms = int(max(_seconds(keep), seconds) * 1000)
    out = rows.groupBy("site_id", "visitor", "page_url").transformWithState(state.Throttle(seconds, ms), "event_id string, t long", "Append", "ProcessingTime")
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return _start(writer, stream.sparkSession, availableNow=True)
