"""A stored propagation run: the states of a catalogue at one time, and their header."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions.orbit import KeplerJ2, OrbitModel
from skyframe.operators import propagation as P
from skyframe.session import materialize
from skyframe.sources.tables import check_unique, write_run


def propagation_run(
    elements: DataFrame,
    target: datetime,
    run_id: int,
    source: str,
    started_at: datetime,
    completed_at: datetime,
    model: OrbitModel = KeplerJ2(),
) -> tuple[DataFrame, DataFrame]:
    """(states, header): one state per element set, with its run; the header counts them.

    The states are written once, as the header and the run table both read them.
    """
    at = F.lit(target).cast("timestamp")
    states = P.propagate_once(elements, at, model).withColumn("run_id", F.lit(run_id).cast("bigint"))
    states = materialize(states, "states")
    header = P.propagation_totals(states).select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(source).alias("source"),
        at.alias("target_time"),
        "total_objects", "successful", "failed",
        F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(completed_at).cast("timestamp").alias("completed_at"),
    )
    return states, header


def store_propagation_run(states: DataFrame, header: DataFrame, folder: str) -> None:
    """Write a run in one commit: its states first, its header as the mark."""
    write_run(check_unique(states, ["run_id", "object_id"]), header, folder, "states", "propagation_runs")
