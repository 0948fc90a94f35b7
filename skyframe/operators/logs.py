"""Log lines: labels, filters, level counts and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe import constants as K


def labelled(lines: DataFrame, project: str, platform: str) -> DataFrame:
    """Lines of one project with the two kept labels; every other label is dropped.

    ``lines`` has project, service, ts and line.
    """
    return lines.filter(F.col("project") == project).select(
        F.lit(platform).alias("platform"), F.col("service").alias("service_name"), "ts", "line"
    )


def of_services(lines: DataFrame, *services: str) -> DataFrame:
    return lines.filter(F.col("service_name").isin(*services))


def errors_and_warnings(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").rlike(K.LOG_LEVEL_PATTERN))


def retained(lines: DataFrame, now: Column) -> DataFrame:
    """Lines inside the retention time. On a table partitioned by day, compare the
    day as well, so that whole partitions are skipped."""
    return lines.filter(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(K.LOG_RETENTION_HOURS)))


def level_counts(lines: DataFrame, width: str = "1 minute") -> DataFrame:
    """Lines and error-like lines per service and tumbling window."""
    return (
        lines.groupBy(F.window("ts", width).alias("w"), "service_name")
        .agg(
            F.count("*").alias("lines"),
            F.count_if(F.col("line").rlike(K.LOG_LEVEL_PATTERN)).alias("alarming"),
        )
        .select("service_name", F.col("w.start").alias("window_start"), "lines", "alarming")
    )
