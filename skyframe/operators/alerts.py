"""Alert conditions over metric series, hold times, grouping and inhibition.

A series row has ``job, instance`` and further labels, ``ts`` and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.functions.quality import MICROS
from skyframe.operators.sliced import (
    SLICE,
    earlier_slices,
    fitted_seconds,
    in_slice,
    inherit,
    up_to_now,
    with_previous,
    with_slice,
)

ON = ("job", "instance")


def and_on(rows: DataFrame, partner: DataFrame, on: tuple[str, ...] = ON) -> DataFrame:
    """Rows whose partner exists, matched on ``on``."""
    return rows.join(partner.select(*on).distinct(), list(on), "left_semi")


def counter_deltas(series: DataFrame, labels: list[str], slice_seconds: int | None = None) -> DataFrame:
    """Adds ``delta``: growth since the previous sample; after a reset the new value.

    The first sample of a series has no delta, as nothing is known before it.
    """
    slice_seconds = slice_seconds or fitted_seconds(series, labels, "ts")
    rows = with_previous(with_slice(series, "ts", slice_seconds), labels, ["ts", "value"], "value", "_before")
    before = F.col("_before")
    grown = F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value"))
    return rows.withColumn("delta", grown).drop("_before", SLICE)


def counter_increase(
    series: DataFrame, labels: list[str], window: str = K.INCREASE_WINDOW, slide: str = "1 minute"
) -> DataFrame:
    """Increase per label set and sliding window; only windows that grew.

    Growth is first summed per slide, and only these sums go to the windows they lie
    in: a row is not copied before it is aggregated."""
    deltas = counter_deltas(series, labels).filter("delta > 0")
    summed = deltas.groupBy(F.window("ts", slide).alias("s"), *labels).agg(F.sum("delta").alias("delta"))
    return (
        summed.withColumn("ts", F.col("s.start"))
        .groupBy(F.window("ts", window, slide).alias("w"), *labels)
        .agg(F.sum("delta").alias("increase"))
        .select(*labels, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "increase")
    )


def hold_for(
    samples: DataFrame, labels: list[str], hold_seconds: int, slice_seconds: int | None = None
) -> DataFrame:
    """Alert state per sample (``ts``, boolean ``active``): inactive, pending, and
    firing once the condition held for ``hold_seconds``. It clears at once.

    Gaps and islands: the begin of the current run is the last sample that turned
    active, in this slice or an earlier one.
    """
    slice_seconds = slice_seconds or fitted_seconds(samples, labels, "ts")
    rows = with_previous(with_slice(samples, "ts", slice_seconds), labels, ["ts", "active"], "active", "_was")
    turned = F.col("active") & ~F.coalesce("_was", F.lit(False))
    rows = rows.withColumn("_turned", F.when(turned, F.col("ts"))).drop("_was")
    rows = inherit(
        rows, labels, {"_newest": F.max("_turned")},
        {"_earlier": F.max("_newest").over(earlier_slices(labels))},
    )
    here = F.max("_turned").over(up_to_now(in_slice(labels, "ts")))
    since = F.when(F.col("active"), F.coalesce(here, F.col("_earlier")))
    held = (F.unix_micros("ts") - F.unix_micros("active_since")) >= hold_seconds * MICROS
    state = (
        F.when(~F.col("active"), F.lit("inactive")).when(held, F.lit("firing")).otherwise(F.lit("pending"))
    )
    return (
        rows.withColumn("active_since", since)
        .drop("_turned", "_earlier", SLICE)
        .withColumn("state", state)
    )


def stale_providers(executions: DataFrame, available: DataFrame, now: Column) -> DataFrame:
    """Providers observed at least once whose last success is too old, while their
    metrics are available (``available``: job, instance)."""
    limits = F.create_map(*[F.lit(x) for pair in K.STALE_AFTER_SECONDS.items() for x in pair])
    last = executions.filter("success").groupBy(*ON, "provider").agg(F.max("finished_at").alias("last_success"))
    age = (F.unix_micros(now) - F.unix_micros("last_success")) / F.lit(float(MICROS))
    old = last.withColumn("age_seconds", age).filter(
        F.col("age_seconds") > F.try_element_at(limits, F.col("provider"))
    )
    return and_on(old, available)


def coverage_condition(series: DataFrame) -> DataFrame:
    """Samples (``eligible``, ``earth_orbit``) with the ratio and whether it is too low."""
    ratio = F.try_divide(F.col("eligible").cast("double"), F.col("earth_orbit").cast("double"))
    low = (ratio < K.COVERAGE_ALERT_RATIO) & (F.col("earth_orbit") > 0)
    return series.withColumns({"ratio": ratio, "active": F.coalesce(low, F.lit(False))})


def recent_run_failures(runs: DataFrame, available: DataFrame, failures: str, now: Column) -> DataFrame:
    """Latest run per (job, instance) with failures, completed under 15 minutes ago."""
    columns = [c for c in runs.columns if c not in ON]
    latest = runs.groupBy(*ON).agg(F.max_by(F.struct(*columns), "run_id").alias("r")).select(*ON, "r.*")
    age = (F.unix_micros(now) - F.unix_micros("completed_at")) / F.lit(float(MICROS))
    hit = latest.withColumn("age_seconds", age).filter(
        (F.col(failures) > 0) & (F.col("age_seconds") >= 0) & (F.col("age_seconds") < K.RECENT_RUN_SECONDS)
    )
    return and_on(hit, available)


def alert_groups(alerts: DataFrame) -> DataFrame:
    """Alerts per (name, severity, component) with their count and span.

    The members stay rows of ``alerts`` under the group key: a storm of alerts in
    one group must not become one row.
    """
    return alerts.groupBy("alertname", "severity", "component").agg(
        F.count("*").alias("alerts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def inhibited(alerts: DataFrame) -> DataFrame:
    """Alerts without warnings muted by a critical one with equal name, component,
    provider and source; an absent label equals an absent label."""
    equal = ("alertname", "component", "provider", "source")
    critical = alerts.filter(F.col("severity") == "critical").select(
        *[F.col(c).alias(f"c_{c}") for c in equal]
    ).distinct()
    condition = F.col("severity") == "warning"
    for c in equal:
        condition = condition & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    return alerts.join(critical, condition, "left_anti")
