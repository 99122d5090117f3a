"""Stateful processors: what streams keep by key between batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

DAY_MS = 86_400_000
#: how long a session's claims are kept, by granularity
LEDGER_MS = {"5m": 3 * DAY_MS, "1d": 30 * DAY_MS}
STEP_SECONDS = {"5m": 300, "1d": 86_400}


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


class SessionLedger(StatefulProcessor):
    """Per (site, bucket, granularity, event type, session): the areas that the session is
    claimed for. Rows come out as what they add to each rollup key."""

    SCHEMA = _schema(
        site_id=StringType(), bucket=LongType(), granularity=StringType(), geo_level=StringType(), geo_area_id=StringType(), event_type=StringType(), device_type=StringType(), browser=StringType(),
        os=StringType(), is_bot=BooleanType(), country=StringType(), event_count=LongType(), unique_sessions=LongType(),
    )

    def __init__(self, granularities, ttl_ms: dict[str, int] | None = None):
        self.ttl = {g: (ttl_ms or LEDGER_MS)[g] for g in granularities}

    def init(self, handle: StatefulProcessorHandle) -> None:
        area, flag = _schema(geo_level=StringType(), geo_area_id=StringType()), _schema(claimed=BooleanType())
        self.claimed = {g: handle.getMapState(f"claimed_{g}", area, flag, ms) for g, ms in self.ttl.items()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        site, bucket, granularity, event_type, _ = key
        counts, first = Counter(), {}
        for r in rows:
            what, arrival = (r.device_type, r.browser, r.os, r.is_bot, r.country), (r.at, r.event_id)
            for area in zip(r.levels, r.ids):
                counts[area, what] += 1
                if area not in first or arrival < first[area][0]:
                    first[area] = (arrival, what)
        ledger, claims = self.claimed[granularity], set()
        for area, (_, what) in first.items():
            if not ledger.containsKey(area):
                ledger.updateValue(area, (True,))
                claims.add((area, what))
        for (area, what), n in counts.items():
            yield Row(*SessionLedger.SCHEMA.names)(site, bucket, granularity, *area, event_type, *what, n, int((area, what) in claims))

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """Per event id: when it was let through last."""

    def __init__(self, seconds: int, keep_ms: int):
        self.micros, self.keep_ms = seconds * 1_000_000, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", _schema(at=LongType()), self.keep_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        old = self.accepted.get()[0] if self.accepted.exists() else None
        if old is None or initialState._at > old:
            self.accepted.update((initialState._at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.accepted.get()[0] if self.accepted.exists() else None
        began = last
        for r in sorted(rows, key=lambda r: (r._at is not None, r._at or 0)):
            at = r._at if r._at is not None else timerValues.getCurrentProcessingTimeInMs() * 1000
            if last is None or at >= last + self.micros:
                last = at
                yield Row("_row")(r._row)
        if last != began:
            self.accepted.update((last,))

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """Per (site, visitor, page): when the last view that was let through expires."""

    def __init__(self, seconds: int, keep_ms: int):
        self.micros, self.keep_ms = seconds * 1_000_000, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expiry = handle.getValueState("expiry", _schema(at=LongType()), self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        until = began = self.expiry.get()[0] if self.expiry.exists() else None
        for t, event_id in sorted((r.t, r.event_id) for r in rows):
            if until is None or until <= t:
                until = t + self.micros
                yield Row("event_id", "t")(event_id, t)
        if until != began:
            self.expiry.update((until,))

    def close(self) -> None:
        pass


class AlertClock(StatefulProcessor):
    """Per (site, event type, level, granularity): the rules, the counts of the newest
    buckets by area, and for which buckets and when a rule has fired. Evaluated when a
    timer of the clock expires."""

    SCHEMA = _schema(
        rule_id=LongType(), site_id=StringType(), rule_name=StringType(), geo_area_id=StringType(), granularity=StringType(), bucket=LongType(), measured_value=LongType(), threshold=LongType(),
        comparator=StringType(), rule_version=LongType(), created=LongType(),
    )

    def __init__(self, tick_seconds: int, lookback: int):
        self.tick_ms, self.lookback = tick_seconds * 1000, max(1, lookback)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rule = _schema(name=StringType(), area=StringType(), threshold=LongType(), comparator=StringType(), cooldown=LongType(), enabled=BooleanType(), version=LongType())
        self.rules = handle.getMapState("rules", _schema(rule_id=LongType()), rule)
        self.counts = handle.getMapState("counts", _schema(bucket=LongType(), area=StringType()), _schema(n=LongType()))
        self.fired = handle.getMapState("fired", _schema(rule_id=LongType(), bucket=LongType()), _schema(created=LongType()))
        self.last = handle.getMapState("last", _schema(rule_id=LongType(), area=StringType()), _schema(created=LongType()))

    def _oldest(self, granularity: str, now_ms: int) -> int:
        """The oldest bucket that is looked at."""
        step = STEP_SECONDS[granularity]
        return (now_ms // 1000 // step - self.lookback + 1) * step

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        granularity, now = key[3], timerValues.getCurrentProcessingTimeInMs()
        if granularity not in STEP_SECONDS:  # a rule of no granularity is skipped alone
            return
        added = Counter()
        for r in rows:
            if r.rule_id is not None:
                old = self.rules.getValue((r.rule_id,)) if self.rules.containsKey((r.rule_id,)) else None
                if old is None or (r.version or 0) >= (old[6] or 0):
                    self.rules.updateValue((r.rule_id,), (r.name, r.area, r.threshold, r.comparator, r.cooldown_seconds, r.enabled, r.version))
            elif r.bucket >= self._oldest(granularity, now):
                added[r.bucket, r.area] += r.n
        for at, n in added.items():
            old = self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0
            self.counts.updateValue(at, (old + n,))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer((now // self.tick_ms + 1) * self.tick_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        site, _, _, granularity = key
        now, step = timerValues.getCurrentProcessingTimeInMs(), STEP_SECONDS[granularity]
        self.handle.registerTimer((now // self.tick_ms + 1) * self.tick_ms)
        oldest, counts = self._oldest(granularity, now), list(self.counts.iterator())
        for at, _ in counts:
            if at[0] < oldest:
                self.counts.removeKey(tuple(at))
        fired = {tuple(k) for k, _ in self.fired.iterator()}
        for old in fired:
            if old[1] < oldest:
                self.fired.removeKey(old)
        for (rule_id,), (name, area, threshold, comparator, cooldown, enabled, version) in list(self.rules.iterator()):
            if not enabled or comparator not in (">=", "<=") or threshold is None:
                continue
            for back in range(self.lookback):
                bucket = (now // 1000 // step - back) * step
                measured = sum(n[0] for at, n in counts if at[0] == bucket and area in ("", at[1]))
                if (measured >= threshold) if comparator == ">=" else (measured <= threshold):
                    last = self.last.getValue((rule_id, area))[0] if self.last.containsKey((rule_id, area)) else None
                    if (last is None or last < now - 1000 * (cooldown or 0)) and (rule_id, bucket) not in fired:
                        self.fired.updateValue((rule_id, bucket), (now,))
                        self.last.updateValue((rule_id, area), (now,))
                        yield Row(*AlertClock.SCHEMA.names)(rule_id, site, name, area, granularity, bucket, measured, threshold, comparator, version, now)
                    break

    def close(self) -> None:
        pass
