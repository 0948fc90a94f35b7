"""Held alerts as keyed state with event-time timers.

The state of an instance is the run it is in and the samples that wait for the watermark.
When the watermark has passed them they are taken in order of time, however they came; a
timer at the end of the hold fires an alert although no further sample comes. State lies in
the state store: an instance that is quiet and inactive keeps none, so what stays is the open
alerts and what arrived within the lateness. Needs a session set up by
``skyframe.session.configure``: several states of a key ask for RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "instance string, ts timestamp, state string"
EPOCH = datetime(1970, 1, 1)


def _micros(value) -> int:
    """Microseconds of a time that the state store or a frame gives, read as UTC."""
    stamp = pd.Timestamp(value)
    stamp = stamp.tz_convert("UTC").tz_localize(None) if stamp.tzinfo else stamp
    return (stamp.to_pydatetime() - EPOCH) // timedelta(microseconds=1)


def advance(
    run: tuple[bool, int, bool], samples: list[tuple[int, bool]], watermark_us: int, hold_us: int
) -> tuple[tuple[bool, int, bool], list[tuple[int, str]]]:
    """The run (active, since, fired) and its changes after samples in order of time, all of
    them before the watermark."""
    active, since, fired = run
    changes = []
    for at, now in samples:
        due = since + hold_us
        if active and not fired and (at > due or (now and at == due)):
            changes.append((due, "firing"))
            fired = True
        if now != active:
            changes.append((at, "pending" if now else "inactive"))
            active, since, fired = now, at, False
    if active and not fired and since + hold_us <= watermark_us:
        changes.append((since + hold_us, "firing"))
        fired = True
    return (active, since, fired), changes


class HoldProcessor(StatefulProcessor):
    def __init__(self, hold_seconds: int) -> None:
        self.hold_us = hold_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "active boolean, since_us long, fired boolean")
        self.waiting = handle.getListState("waiting", "ts_us long, active boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            came = [(_micros(t), bool(a)) for t, a in zip(frame["ts"], frame["active"])]
            self.waiting.appendList(came)
            latest = max([latest or came[0][0], *[t for t, _ in came]])
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((int(t), bool(a)) for t, a in self.waiting.get())
        ready = [s for s in held if s[0] <= watermark_us]
        rest = held[len(ready) :]
        known = self.run.get() if self.run.exists() else None
        run = (bool(known[0]), int(known[1]), bool(known[2])) if known is not None else (False, 0, False)
        run, changes = advance(run, ready, watermark_us, self.hold_us)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if run[0]:
            self.run.update(run)
            if not run[2]:
                self.handle.registerTimer(-(-(run[1] + self.hold_us) // 1000))
        else:
            self.run.clear()
        if changes:
            times = [datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=t) for t, _ in changes]
            yield pd.DataFrame({"instance": key[0], "ts": times, "state": [s for _, s in changes]})


def held_changes(samples: DataFrame, hold_seconds: int, lateness: str = "1 minute") -> DataFrame:
    """State changes (instance, ts, state) of a stream of samples (instance, ts, active):
    pending, firing once the condition has held, and inactive. Samples later than the
    lateness are dropped, as in any job with a watermark."""
    keyed = samples.select("instance", "ts", "active").withWatermark("ts", lateness).groupBy("instance")
    return keyed.transformWithStateInPandas(
        statefulProcessor=HoldProcessor(hold_seconds), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )
