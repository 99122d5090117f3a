"""Streams over files against the batch operators."""

import pytest
from pyspark.sql import functions as F

from visitlens.operators import dedup, enrich, journeys, maintenance, read_models, rollups
from visitlens.plans import rules as R
from visitlens.plans import tables as T
from visitlens.sources import events
from visitlens.streaming import jobs


@pytest.fixture()
def topic(spark, sf, tmp_path):
    """Records in two files; the second repeats a part of the first and has bad lines."""
    rows = events.event_json(T.raw(spark, sf)).drop("key")
    bad = spark.createDataFrame([("{broken", "raw-events", 0, 10_000_001), ('{"eventId":"x"}', "raw-events", 0, 10_000_002)], rows.schema)
    rows.where("offset < 500").coalesce(1).write.mode("append").json(str(tmp_path / "topic"))
    rows.where("offset >= 400").unionByName(bad).coalesce(1).write.mode("append").json(str(tmp_path / "topic"))
    return str(tmp_path / "topic")


def test_ingest_twice_is_ingest_once(spark, sf, topic, tmp_path):
    cfg = jobs.Config(str(tmp_path / "out"), T.NOW)
    source = {"format": "json", "path": topic, "maxFilesPerTrigger": "1"}
    for k in range(2):  # a second stream over the same topic finds all ids in the ledger
        jobs.stream_ingest(events.read_raw_stream(spark, source), cfg, str(tmp_path / f"ck{k}")).awaitTermination()
        jobs.alert_now(spark, cfg, R.alert_rules(spark))
    every = jobs.table(spark, cfg, "facts")
    n = T.raw(spark, sf).count()
    assert every.count() == every.select("event_id").distinct().count() == n
    assert {r.reason.split(" at ")[0] for r in jobs.table(spark, cfg, "dlq").collect()} == {"malformed JSON", "missing required field"}
    got = jobs.table(spark, cfg, "rollups").where("event_count > 0")
    want = rollups.rollup_events(T.enriched(spark, sf))
    key = ["bucket_time", "granularity", "geo_level", "geo_area_id", "event_type", "device_type", "browser"]
    total = lambda df: sorted(map(tuple, df.groupBy(*key).agg(F.sum("event_count").alias("n"), F.sum("unique_sessions").alias("u")).collect()), key=repr)
    assert total(got) == total(want)
    keys = [r.dedup_key for r in spark.read.parquet(cfg.path("incidents")).collect()]
    assert keys and len(keys) == len(set(keys))


def view(spark, sf, name: str, when: str, page: str):
    base = T.raw(spark, sf).where("event_type = 'page_view' and session_id is not null and page_url is not null").limit(1)
    time = F.expr(f"timestamp_ntz '{when}'")
    return base.withColumns({"event_id": F.lit(name), "event_time": time, "server_time": time, "page_url": F.lit(f"https://site.example/{page}")})


def wire(*rows):
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return events.event_json(out).drop("key")


def test_batches_carry_the_ledger_and_the_throttle(spark, sf, tmp_path):
    """Two views ten seconds apart in two batches, redelivered in a third: one is let
    through; sessions and snapshots are those of the whole, read from bases and a delta."""
    day = "2024-01-15T10:0"
    e = {
        "e1": view(spark, sf, "e1", f"{day}0:00", "cv"), "e2": view(spark, sf, "e2", f"{day}0:10", "cv"), "e3": view(spark, sf, "e3", f"{day}0:20", "contact"),
        "e4": view(spark, sf, "e4", f"{day}5:10", "cv"), "e5": view(spark, sf, "e5", f"{day}5:20", "cv"),
    }
    batches = [wire(e["e1"]), wire(e["e2"], e["e3"]), wire(e["e2"], e["e4"], e["e4"]), wire(e["e5"])]
    cfg = jobs.Config(str(tmp_path / "out"), T.NOW, open_deltas=1, intent=(R.policies(spark), R.signal_rules(spark), R.metadata(spark)))
    for order in ((0, 1, 2, 3), (2,)):  # running one again changes nothing
        for k in order:
            jobs.ingest_batch(batches[k], cfg, k)
        facts = jobs.table(spark, cfg, "facts")
        assert sorted(r.event_id for r in facts.collect()) == ["e1", "e3", "e4"]
    for name in ("raw", "legacy_log", "enriched"):
        assert jobs.table(spark, cfg, name).count() == 3
    assert jobs.table(spark, cfg, "timeline").select("operation_id").distinct().count() == 3
    (session,) = jobs.sessions(spark, cfg).collect()
    assert (session.page_views, session.entry_page, session.exit_page, session.duration_ms) == (3, "/cv", "/cv", 310_000)
    (snapshot,) = jobs.snapshots(spark, cfg).collect()
    assert (snapshot.first_event, snapshot.last_event) == (session.first_event, session.last_event)
    steps = jobs.table(spark, cfg, "journey_steps").drop("day", "batch_id")
    (whole,) = journeys.score_intent(steps, journeys.active_policy(R.policies(spark)), R.signal_rules(spark), R.metadata(spark)).collect()
    assert snapshot == whole and jobs.sessions(spark, cfg).collect() == read_models.build_sessions(facts).collect()
    bases = jobs.CommitLog(spark, cfg.root).manifest().bases
    assert set(bases) == set(jobs.KEYED) and {b["upto"] for b in bases.values()} == {3}


def test_sessions_throttle_and_inbox_know_no_days(spark, sf, tmp_path):
    """A session over forty days is whole; a view long before the last one let through
    is throttled, as is a repeated id, whatever its day; one alike in id with another time too."""
    cfg = jobs.Config(str(tmp_path / "out"), T.NOW, open_deltas=1)
    batches = [
        wire(view(spark, sf, "a1", "2024-01-10T08:00:00", "x")), wire(view(spark, sf, "b2", "2024-01-13T08:00:00", "y")), wire(view(spark, sf, "c3", "2024-01-16T08:00:00", "z")),
        wire(view(spark, sf, "d4", "2024-02-19T08:00:00", "z")), wire(view(spark, sf, "e5", "2024-02-16T08:00:00", "z"), view(spark, sf, "a1", "2024-02-20T08:00:00", "new")),
    ]
    for k, b in enumerate(batches):
        jobs.ingest_batch(b, cfg, k)
    (session,) = jobs.sessions(spark, cfg).collect()
    assert (session.page_views, session.entry_page, session.exit_page, str(session.first_event)) == (4, "/x", "/z", "2024-01-10 08:00:00")
    assert sorted(r.event_id for r in jobs.table(spark, cfg, "facts").collect()) == ["a1", "b2", "c3", "d4"]


def test_a_batch_is_seen_whole_or_not_at_all(spark, sf, tmp_path, monkeypatch):
    """A crash between two writes leaves nothing visible; run again under another clock,
    the batch has the rows of its first try, also where an event has no time."""
    root = str(tmp_path / "out")
    first, second = wire(view(spark, sf, "a1", "2024-01-10T08:00:00", "x")), wire(view(spark, sf, "b2", "2024-01-11T08:00:00", "y").withColumn("event_time", F.lit(None).cast("timestamp_ntz")))
    jobs.ingest_batch(first, jobs.Config(root, "2024-01-10T23:59:00"), 0)

    def seen():
        cfg = jobs.Config(root)
        return {n: sorted(map(str, jobs.table(spark, cfg, n).collect())) for n in ("facts", "raw", "inbox", "rollups", "session_parts", "timeline", "legacy_log")}

    before, write = seen(), jobs.CommitLog.write

    def crash(self, rows, name, number, *by):
        if name == "rollups":
            raise RuntimeError("lost")
        return write(self, rows, name, number, *by)

    monkeypatch.setattr(jobs.CommitLog, "write", crash)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.ingest_batch(second, jobs.Config(root, "2024-01-11T23:59:59"), 1)
    assert seen() == before
    monkeypatch.setattr(jobs.CommitLog, "write", write)
    jobs.ingest_batch(second, jobs.Config(root, "2024-01-12T00:00:01"), 1)
    after = seen()
    rows = {r.event_id: r for r in jobs.table(spark, jobs.Config(root), "facts").collect()}
    assert sorted(rows) == ["a1", "b2"] and str(rows["b2"].event_time) == "2024-01-11 23:59:59" and after != before
    jobs.ingest_batch(second, jobs.Config(root, "2024-01-13T00:00:00"), 1)
    assert seen() == after
    with pytest.raises(ValueError, match="one stream at a time"):
        jobs.ingest_batch(second, jobs.Config(root), 7)
    jobs.ingest_batch(second, jobs.Config(root), 0, stream="another")  # its ids are known
    assert {n: v for n, v in seen().items() if n != "inbox"} == {n: v for n, v in after.items() if n != "inbox"}


def test_dead_letters_of_a_batch_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("{broken", "t", 0, 7), ("", "t", 1, 8)], "value string, topic string, partition int, offset long")
    _, rejected = enrich.split_valid_dlq(events.parse_raw_events(rows))
    for _ in range(2):
        maintenance.write_dlq(rejected, str(tmp_path / "dlq"), 3)
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "dlq")).collect()) == ["empty payload at t-1@8", "malformed JSON at t-0@7"]


def test_ttl_and_throttle_keep_null_keys_and_one_of_equals(spark, sf):
    rows = T.enriched(spark, sf).where("event_type = 'page_view' and session_id is not null").limit(1)
    no_site = rows.withColumn("site_id", F.lit(None).cast("string"))
    assert dedup.throttle_visits(no_site).count() == 1 and dedup.throttle_visits(no_site.unionByName(no_site)).count() == 1
    assert dedup.dedup_ttl(rows.unionByName(rows)).count() == 1
    null_id = rows.withColumn("event_id", F.lit(None).cast("string"))
    assert dedup.dedup_ttl(null_id).count() == 1


def test_throttle_as_state_equals_batch(spark, sf, tmp_path):
    rows = T.enriched(spark, sf)
    rows.where("event_time < timestamp_ntz '2024-01-15'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.stream_throttle(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 86_400).awaitTermination()
        if _ == 0:
            rows.where("event_time >= timestamp_ntz '2024-01-15'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id for r in dedup.throttle_visits(rows, 86_400).where("event_type = 'page_view'").collect()}
    assert got == want


def test_rate_limit(spark, sf, tmp_path):
    rows = T.enriched(spark, sf)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    requests = stream.select(F.col("ip_hash").alias("ip"), "event_time")
    jobs.stream_rate_limit(requests, str(tmp_path / "r"), str(tmp_path / "ck2"), 86_400, 2, "1 second").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).where("over and requests <= 2").count() == 0


def test_dedup_goes_by_when_an_id_was_let_through(spark, sf, tmp_path):
    """Redelivery after 23 and 25 hours, each after a restart; ids of the inbox are known
    from the start; an id that was never let through again counts from its first time."""
    base = T.enriched(spark, sf).where("session_id is not null").limit(1)

    def put(*rows):
        out = None
        for name, hours in rows:
            one = base.withColumns({"event_id": F.lit(name), "server_time": F.expr(f"timestamp_ntz '2024-01-15T00:00:00' + interval {hours} hours")})
            out = one if out is None else out.unionByName(one)
        out.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
        inbox = spark.createDataFrame([("known", "2024-01-14 12:00:00")], "event_id string, at string").select("event_id", F.col("at").cast("timestamp_ntz").alias("received_at"))
        jobs.stream_dedup(stream, str(tmp_path / "d"), str(tmp_path / "ck"), inbox=inbox).awaitTermination()
        return sorted((r.event_id, (r.server_time.day - 15) * 24 + r.server_time.hour) for r in spark.read.parquet(str(tmp_path / "d")).collect())

    assert put(("a", 0), ("a", 0), ("b", 0), ("known", 0)) == [("a", 0), ("b", 0)]
    assert put(("a", 23), ("known", 12)) == [("a", 0), ("b", 0), ("known", 12)]
    got = put(("b", 25), ("a", 24), ("known", 13))
    assert got == [("a", 0), ("a", 24), ("b", 0), ("b", 25), ("known", 12)]
    whole = spark.read.schema(base.schema).parquet(str(tmp_path / "d"))
    assert set(whole.columns) == set(base.columns) and whole.first().properties == base.first().properties


def test_rollups_as_state_equal_the_batch(spark, sf, tmp_path):
    """Three batches, the last of late events, with restarts between them; then the same
    sessions again, which leaves the state as large as it was."""
    rows = T.enriched(spark, sf)
    parts = [rows.where("event_time < timestamp_ntz '2024-01-12' and event_id not like '%7'"), rows.where("event_time >= timestamp_ntz '2024-01-12' and event_id not like '%7'"), rows.where("event_id like '%7'")]
    late = F.expr("server_time + interval 60 days")
    parts[2] = parts[2].withColumn("server_time", late)
    root, sizes, seen = str(tmp_path / "out"), [], []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in [*parts, parts[1]]:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.stream_rollups(stream, root, str(tmp_path / "ck"), open_deltas=1)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        seen.append(sorted(map(tuple, jobs.rollups_of(spark, root).collect()), key=repr))
    arrived = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert seen[2] == sorted(map(tuple, rollups.rollup_events(arrived).select(*rollups.KEY, "event_count", "unique_sessions").collect()), key=repr)
    assert sizes[3] == sizes[2] >= sizes[1]
    sums = [(sum(r[-2] for r in s), sum(r[-1] for r in s)) for s in seen]
    assert sums[3][0] > sums[2][0] and sums[3][1] == sums[2][1]
    touched = parts[2].select(F.to_date("event_time")).distinct().count()
    added = jobs.rollup_deltas(spark, root)
    assert added.isStreaming and touched < 32


def test_alerts_go_by_the_clock(spark, tmp_path):
    """On a silent topic a rule for too few events opens one incident, and no second one
    within its cooldown; a rule for many events stays quiet; a broken rule is skipped alone."""
    import time

    fields = "rule_id long, site_id string, name string, event_type string, geo_level string, geo_area_id string, granularity string, threshold long, comparator string, cooldown_seconds int, enabled boolean, version int"
    rows = [
        (1, "s", "silence", "page_view", "GLOBAL", None, "1d", 0, "<=", 3600, True, 1), (2, "s", "rush", "page_view", "GLOBAL", "", "1d", 5, ">=", 60, True, 1),
        (3, "s", "broken", "page_view", "GLOBAL", "", "1d", 0, "==", 60, True, 1), (4, "s", "off", "page_view", "GLOBAL", "", "1d", 0, "<=", 60, False, 2), (5, "s", "odd", "page_view", "GLOBAL", "", "7m", 0, "<=", 60, True, 1),
    ]
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(tmp_path / "rules"))
    rules = spark.readStream.schema(fields).parquet(str(tmp_path / "rules"))
    kinds = "site_id string, bucket_time timestamp_ntz, granularity string, geo_level string, geo_area_id string, event_type string, device_type string, browser string, os string, is_bot boolean, country string, event_count long, unique_sessions long"
    (tmp_path / "deltas").mkdir()
    deltas = spark.readStream.schema(kinds).parquet(str(tmp_path / "deltas"))

    def incidents():
        out = tmp_path / "out"
        rows = spark.read.schema("rule_id long, measured_value long, comparator string").parquet(str(out)).collect() if out.exists() else []
        return sorted((r.rule_id, r.measured_value, r.comparator) for r in rows)

    def run(enough):
        query = jobs.stream_alerts(deltas, rules, str(tmp_path / "out"), str(tmp_path / "ck"), tick_seconds=1, processingTime="500 milliseconds")
        try:
            until = time.time() + 90
            while time.time() < until:
                assert query.exception() is None
                got = incidents()
                if enough(got):
                    time.sleep(3)
                    return incidents()
                time.sleep(0.5)
            return got
        finally:
            query.stop()

    assert run(lambda got: bool(got)) == [(1, 0, "<=")]
    now = spark.sql("select cast(current_timestamp() as timestamp_ntz) as t").withColumn("bucket_time", F.date_trunc("DAY", "t").cast("timestamp_ntz"))
    for area, n in (("GLOBAL", 3), ("X", 3)):
        one = now.select(*[(F.col("bucket_time") if f.split()[0] == "bucket_time" else {"site_id": F.lit("s"), "granularity": F.lit("1d"), "geo_level": F.lit("GLOBAL"), "geo_area_id": F.lit(area), "event_type": F.lit("page_view"), "event_count": F.lit(n).cast("long")}.get(f.split()[0], F.lit(None).cast(f.split()[1]))).alias(f.split()[0]) for f in kinds.split(", ")])
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "deltas"))
    assert run(lambda got: len(got) > 1) == [(1, 0, "<="), (2, 6, ">=")]  # after a restart, and the first not again


def test_writes_are_insert_if_absent(spark, sf, tmp_path):
    from visitlens.operators import maintenance

    rows = T.enriched(spark, sf)
    for _ in range(2):
        maintenance.write_facts(rows, str(tmp_path / "facts"))
        maintenance.write_legacy_log(rows, str(tmp_path / "legacy"))
        maintenance.write_raw_tier(T.raw(spark, sf), str(tmp_path / "raw"))
    for t in ("facts", "legacy", "raw"):
        assert spark.read.parquet(str(tmp_path / t)).count() == rows.count()
    assert enrich.facts(rows).count() == rows.count()
