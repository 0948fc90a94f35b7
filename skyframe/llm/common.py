"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch. Texts may be long, so the stock 10,000 rows of one
#: batch could outgrow a Python worker.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fields_of(df: DataFrame, *columns: str) -> str:
    """DDL of some columns of ``df``, as a Python step that passes them on declares them."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def groups_in_order(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000
) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups from batches that are sorted by ``keys``, several groups at once.

    Yields columns as arrays of about ``rows`` rows. No group is cut, so one block is
    at most ``rows`` plus the largest group.
    """
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names})
        size += batch.num_rows
        if size < rows:
            continue
        block = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
        same = np.ones(size, bool)
        for k in keys:
            same &= block[k] == block[k][-1]
        cut = size - int(same.sum())
        if cut:
            yield {n: c[:cut] for n, c in block.items()}
        held = [{n: c[cut:] for n, c in block.items()}]
        size -= cut
    if size:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def run_starts(block: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Where each group of a sorted block begins, with the end appended."""
    n = len(block[keys[0]])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= block[k][1:] != block[k][:-1]
    return np.append(np.flatnonzero(new), n)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``range(s, s + c)`` for every start and count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
