"""Stored tables: reading, run writing and reading runs back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.session import broadcast_if_small


#: Run ids (8 bytes each) that may be broadcast to the rows of runs.
BROADCAST_RUNS = 1_000_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, failing the job that writes it when ``keys`` repeat.

    The check is an aggregation of the keys alone, made before the write.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
    shown = [tuple(row) for row in repeated.limit(5).collect()]
    if shown:
        raise ValueError(f"rows repeat the key {keys}; some keys with their counts: {shown}")
    return df


def write_run(rows: DataFrame, header: DataFrame, folder: str, rows_name: str, header_name: str) -> None:
    """Write the rows of one run, then its header.

    Rows are partitioned by ``run_id`` and replace only that run's partition, so a
    retry after a lost executor or driver writes the same run again. The header
    goes last and is the commit mark: readers join to it, so a run without a header
    is never seen.
    """
    _overwrite_partition(rows, f"{folder}/{rows_name}")
    _overwrite_partition(header, f"{folder}/{header_name}")


def _overwrite_partition(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_runs(spark: SparkSession, folder: str, header_name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{header_name}")


def read_run_rows(spark: SparkSession, folder: str, rows_name: str, header_name: str) -> DataFrame:
    """Rows of committed runs only."""
    rows = spark.read.parquet(f"{folder}/{rows_name}")
    committed = read_runs(spark, folder, header_name).select("run_id")
    return rows.join(broadcast_if_small(committed, BROADCAST_RUNS), "run_id", "left_semi")
