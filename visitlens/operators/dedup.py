"""First arrivals, and the throttle of repeated page views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..scratch import Scratch
from . import greedy

ARRIVAL = ("server_time", "event_id")


def dedup_inbox(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The first arrival of each event id, and none which the ledger has. A repeated
    place in the topic is one record."""
    if {"topic", "partition", "offset"} <= set(events.columns):
        order = [F.col("partition"), F.col("offset")]
        events = events.dropDuplicates(["topic", "partition", "offset"])
    else:
        order = [F.col(c) for c in ARRIVAL]
    first = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
    events = events.withColumn("nth", first).where("nth = 1").drop("nth")
    return events if ledger is None else events.join(ledger.select("event_id"), "event_id", "left_anti")


def dedup_ttl(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """An event id goes if it was let through within the last ``seconds``; of records
    that are alike in id and time, one stays, also of those without a time."""
    return _accepted(events, ["event_id"], seconds, F.lit(True))


def visit_keys(events: DataFrame) -> DataFrame:
    """``events`` with _key (the visitor) and _counts: whether the throttle looks at it."""
    key = C.session_key(F.col("session_id"), F.col("anon_id"), F.col("ip_hash"), F.col("device_type"))
    return events.withColumn("_key", key).withColumn("_counts", _is_visit())


VISIT = ["site_id", "_key", "page_url"]


def _is_visit():
    return F.coalesce((F.col("event_type") == "page_view") & F.col("_key").isNotNull() & ~C.blank(F.col("page_url")), F.lit(False))


def throttle_visits(events: DataFrame, seconds: int = 300, earlier: DataFrame | None = None) -> DataFrame:
    """Page views of the same site, visitor and page within ``seconds`` of the last one
    that was let through are dropped; other events, and those without key, stay.
    ``earlier`` (site_id, _key, page_url, last in microseconds): what was let through
    before, by earlier batches."""
    return _accepted(visit_keys(events).drop("_counts"), VISIT, seconds, _is_visit(), earlier).drop("_key")


def micros(column: str = "event_time"):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _accepted(rows: DataFrame, keys: list[str], seconds: int, counts, earlier: DataFrame | None = None) -> DataFrame:
    """A fold over each key's arrivals in time: a row is let through if the expiry of the
    last one let through is not after it. Null keys are keys like others; of rows of a key
    without a time, one is let through, and it starts no wait. Of rows alike in key and
    time the first arrival stands for all. What came before ``earlier``'s expiry is out
    at once, and what is left is selected along links from arrival to arrival, so that
    the arrivals of a hot key are spread over the tasks whether they have gaps or not."""
    columns = rows.columns
    rows = rows.withColumns({"_counts": F.coalesce(counts, F.lit(False)), "_t": micros()})
    counted = rows.where("_counts").withColumn("_k", F.struct(*keys))
    if earlier is not None:
        last = earlier.select(F.struct(*keys).alias("_k"), (F.col("last") + seconds * 1_000_000).alias("_until"))
        counted = counted.join(last, "_k", "left").where("_until is null or _t is null or _t >= _until").drop("_until")
    first = counted.groupBy("_k", "_t").agg(F.min_by(F.struct(*columns), F.struct(*ARRIVAL)).alias("_row"))
    first = Scratch(rows.sparkSession).store(first, "first-arrivals")
    taken = greedy.select(first.select("_k.*", "_t"), keys, F.col("_t"), F.lit(seconds * 1_000_000))
    timed = first.where("_t is not null").join(taken, ["_k", "_t"], "left_semi")
    kept = timed.unionByName(first.where("_t is null")).select("_row.*")
    return kept.unionByName(rows.where("not _counts").select(*columns))
