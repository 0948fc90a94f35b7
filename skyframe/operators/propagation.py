"""Sample grids, chunks and propagation of whole catalogues."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.orbit import STATE, KeplerJ2, OrbitModel
from skyframe.functions.quality import (
    MICROS,
    QualityLimits,
    age_seconds,
    ephemeris_status,
    expired_message,
    propagation_allowed,
)


def utc_micros(when: datetime) -> int:
    """Microseconds since the epoch; a naive time is an error."""
    if when.tzinfo is None:
        raise ValueError("time must be timezone-aware")
    delta = when.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return delta // timedelta(microseconds=1)


def sample_times_us(start_us: Column, end_us: Column, step_seconds: int) -> Column:
    """Array of sample times: start, every step, and the end when off the grid."""
    step = step_seconds * MICROS
    grid = F.sequence(start_us, end_us, F.lit(step))
    return F.when((end_us - start_us) % step == 0, grid).otherwise(F.concat(grid, F.array(end_us)))


def sample_count(horizon_seconds: int, step_seconds: int) -> int:
    if horizon_seconds <= 0 or step_seconds <= 0:
        raise ValueError("horizon_seconds and step_seconds must be greater than zero")
    if step_seconds > horizon_seconds:
        raise ValueError("step_seconds cannot exceed horizon_seconds")
    return -(-horizon_seconds // step_seconds) + 1


def chunk_intervals(step_seconds: int, chunk_seconds: int) -> int:
    """Sample intervals per chunk; a chunk must be a multiple of the step."""
    if step_seconds <= 0 or chunk_seconds < step_seconds:
        raise ValueError("chunk_seconds must be at least step_seconds, and both positive")
    if chunk_seconds % step_seconds:
        raise ValueError("chunk_seconds must be a multiple of step_seconds")
    return chunk_seconds // step_seconds


def chunks_of_sample(sample_index: Column, intervals: int, last_sample: int | Column) -> Column:
    """Chunk numbers that screen a sample. Neighbouring chunks share the sample
    between them; the last sample starts no chunk of its own."""
    own = F.floor(sample_index / intervals).cast("int")
    shared = (sample_index % intervals == 0) & (sample_index > 0)
    return (
        F.when(shared & (sample_index == last_sample), F.array(own - 1))
        .when(shared, F.array(own - 1, own))
        .otherwise(F.array(own))
    )


def on_grid(elements: DataFrame, start: datetime, horizon_seconds: int, step_seconds: int) -> DataFrame:
    """Every element at every sample time (``sample_index``, ``sample_us``).

    The grid is an array literal exploded in place: no join and no shuffle.
    """
    begin = utc_micros(start)
    end = begin + horizon_seconds * MICROS
    sample_count(horizon_seconds, step_seconds)
    times = sample_times_us(F.lit(begin), F.lit(end), step_seconds)
    return elements.select("*", F.posexplode(times).alias("sample_index", "sample_us"))


def propagate_grid(
    gridded: DataFrame,
    model: OrbitModel = KeplerJ2(),
    limits: QualityLimits = QualityLimits(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """States at each (object, sample) whose element is not expired then.

    Needs prepared elements on a grid. Failed states keep their ``error``; the
    screening drops them and the counters count them.
    """
    at = F.timestamp_micros("sample_us")
    usable = gridded.filter(propagation_allowed(F.col("epoch"), at, limits)).select(
        "object_id", "sample_index", "sample_us", *keep, *model.columns
    )
    return model.state_at(usable, "sample_us").select(
        "object_id", "sample_index", "sample_us", *keep, *STATE, "error"
    )


def propagate_once(
    elements: DataFrame,
    target: Column,
    model: OrbitModel = KeplerJ2(),
    limits: QualityLimits = QualityLimits(),
) -> DataFrame:
    """One row per element at ``target``: state, or the error as a row."""
    epoch, at = F.col("epoch"), F.timestamp_micros("target_us")
    rows = model.prepare(elements).withColumn("target_us", F.unix_micros(target))
    rows = model.state_at(rows, "target_us").withColumn("allowed", propagation_allowed(epoch, at, limits))
    good = F.col("allowed") & F.col("error").isNull()
    return rows.select(
        "object_id",
        "element_id",
        at.alias("target_time"),
        F.lit("TEME").alias("frame"),
        good.alias("success"),
        age_seconds(epoch, at).alias("ephemeris_age_seconds"),
        ephemeris_status(epoch, at, limits).alias("ephemeris_status"),
        *[
            F.when(good, F.col(c)).alias(
                f"position_{c}_km" if len(c) == 1 else f"velocity_{c[1]}_km_s"
            )
            for c in STATE
        ],
        F.when(~F.col("allowed"), F.lit("ExpiredEphemeris"))
        .when(F.col("error").isNotNull(), F.lit("PropagationError"))
        .alias("error_type"),
        F.when(~F.col("allowed"), expired_message(epoch, at, limits))
        .otherwise(F.col("error"))
        .alias("error_message"),
    )


def propagation_totals(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count("*").alias("total_objects"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def check_work_budget(
    elements: DataFrame,
    samples: int,
    max_objects: int | None = None,
    max_propagations: int | None = None,
) -> int:
    """Count the objects; refuse a run above a budget, if one is set, before any work."""
    objects = elements.count()
    if max_objects is not None and objects > max_objects:
        raise ValueError(f"object count {objects} exceeds the limit of {max_objects}")
    if max_propagations is not None and objects * samples > max_propagations:
        raise ValueError(
            f"propagation workload {objects * samples} exceeds the limit of {max_propagations}"
        )
    return objects


def duplicate_states(states: DataFrame, keys: tuple[str, ...] = ("sample_us", "object_id")) -> DataFrame:
    """Rows that break the one-state-per-object-and-time rule; empty when valid."""
    return states.groupBy(*keys).agg(F.count("*").alias("states")).filter("states > 1")
