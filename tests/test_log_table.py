"""Logs by day: retention by folders, commit marks, repeated batches, and sketches that merge."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from skyframe.operators import coverage as C
from skyframe.sources.log_table import HOUR_US, LINE, LogTable

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
START_US = int(START.timestamp()) * 1_000_000


def lines_of(spark, hours, service="api"):
    return spark.createDataFrame([("sky", service, START + timedelta(hours=h), f"line {h}") for h in hours], LINE)


def hours_in(table):
    return sorted(int(r["line"].split()[1]) for r in table.read().collect())


def test_days_are_dropped_and_the_cut_day_is_rewritten(spark, work):
    table = LogTable(spark, f"{work}/logs")
    assert table.read().collect() == []
    table.append(lines_of(spark, range(0, 96)), "one")
    table.append(lines_of(spark, range(0, 96), "worker"), "two")
    table.expire(START_US + 90 * HOUR_US, hours=60)  # cutoff at hour 30
    assert hours_in(table) == sorted([*range(30, 96)] * 2)
    assert table._inside("data") == ["day=2026-01-02", "day=2026-01-03", "day=2026-01-04"]
    assert table._inside("data/day=2026-01-02") == [f"part=kept_{START_US + 30 * HOUR_US}"]
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # A late batch on the cut day: its young lines are seen, its old ones are not.
    table.append(lines_of(spark, [25, 40], "late"), "three")
    assert hours_in(table) == sorted([*range(30, 96)] * 2 + [40])
    table.expire(START_US + 90 * HOUR_US, hours=60)
    table.expire(START_US + 80 * HOUR_US, hours=60)
    assert hours_in(table) == sorted([*range(30, 96)] * 2 + [40])
    table.expire(START_US + 100 * HOUR_US, hours=60)  # the same day once more
    assert hours_in(table) == sorted([*range(40, 96)] * 2 + [40])
    assert table._inside("data/day=2026-01-02") == [f"part=kept_{START_US + 40 * HOUR_US}"]


def test_a_failed_retention_shows_nothing_twice(spark, work):
    table = LogTable(spark, f"{work}/logs")
    table.append(lines_of(spark, range(48)), "one")
    table.append(lines_of(spark, range(48)), "one")
    # As if a run had written the kept part and been lost before its mark.
    lines_of(spark, range(30, 48)).write.parquet(f"{work}/logs/data/day=2026-01-02/part=kept_{START_US + 30 * HOUR_US}")
    assert hours_in(table) == [*range(48)]
    # As if it had been lost after its mark, before the folders went.
    table._delete = lambda name: None
    table.expire(START_US + 90 * HOUR_US, hours=60)
    assert hours_in(table) == [*range(30, 48)]


def test_sketches_of_days_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") * 7919 % 20_011).alias("key"))
    merged = C.merged_distinct(C.distinct_sketches(rows, ["day"], "key"), []).first()[0]
    assert abs(merged - 20_011) <= 0.02 * 20_011
    none = C.merged_distinct(C.distinct_sketches(rows.filter("false"), ["day"], "key"), ["day"])
    assert none.collect() == []
