"""Held alerts by timers: the run of one instance, late samples, and a stop between batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skyframe.session import configure
from skyframe.streaming import jobs as J
from skyframe.streaming.timers import advance, held_changes

HOLD = 300


def by_seconds(samples, hold, end):
    """Second by second: what an observer of all samples sees."""
    active, since, fired, out, state = False, 0, False, [], dict(samples)
    for t in range(0, end + 1):
        if active and not fired and t > since + hold:
            out.append((since + hold, "firing"))
            fired = True
        if t in state and state[t] != active:
            active, since, fired = state[t], t, False
            out.append((t, "pending" if active else "inactive"))
    if active and not fired and since + hold <= end:
        out.append((since + hold, "firing"))
    return out


def test_any_cut_of_the_samples_gives_the_same_changes():
    dice = random.Random(3)
    for _ in range(300):
        times = sorted(dice.sample(range(1, 900), dice.randrange(1, 25)))
        samples = [(t, dice.random() < 0.6) for t in times]
        run, found, taken = (False, 0, False), [], 0
        for mark in sorted(dice.sample(range(1, 1500), 4)) + [1500]:
            ready = [s for s in samples[taken:] if s[0] <= mark]
            run, changes = advance(run, ready, mark, 120)
            found += changes
            taken += len(ready)
        assert found == by_seconds(samples, 120, 1500)


def test_late_samples_and_restarts(spark, work):
    configure(spark)
    start = datetime(2026, 1, 1)
    at = lambda seconds: start + timedelta(seconds=seconds)
    schema = "instance string, ts timestamp, active boolean"
    arrivals = [
        [("a", at(60), True), ("a", at(0), False), ("b", at(10), True), ("c", at(0), False)],
        [("b", at(95), False), ("a", at(100), True), ("b", at(50), True)],  # later than others, not too late
        [("clock", at(2000), False)],
        [("a", at(2100), False), ("clock", at(4000), False)],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{work}/input")
        stream = spark.readStream.schema(schema).parquet(f"{work}/input")
        J.run_to_table(held_changes(stream, HOLD, "2 minutes"), f"{work}/out", f"{work}/state")
    found = spark.read.parquet(f"{work}/out").withColumn("s", F.unix_timestamp("ts") - int((start - datetime(1970, 1, 1)).total_seconds()))
    assert sorted((r.instance, r.s, r.state) for r in found.collect()) == [
        ("a", 60, "pending"), ("a", 360, "firing"), ("a", 2100, "inactive"), ("b", 10, "pending"), ("b", 95, "inactive"),
    ]
    stored = spark.read.format("statestore").option("stateVarName", "run").load(f"{work}/state")
    assert stored.count() == 0  # no alert is open
