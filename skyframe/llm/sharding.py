"""Shards of near equal bytes by sampled splitters.

The key of a row is (hash of its text, id), so equal texts lie together and the order is
otherwise a random one. A sample of keys, drawn with a chance in proportion to a row's
size, gives quantiles of bytes; these split the keys into many small ranges. Ranges that
are still overfull, such as the copies of one text, are sampled again on their own and
subdivided, by id where the text is one. The exact bytes of each range then decide which
run of ranges makes a shard, and the exact rows where its slots begin.

What the driver sees is bounded by the number of ranges: the sample, one sum per range
and the splitters. Rows that repeat both text and id in full share one range.

Defined results: a null text has size 1 and the hash of null; a null id sorts first. An
empty table gives no rows. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from skyframe.session import materialize

#: Ranges at least, and per shuffle partition: enough that dealing whole ranges to
#: shards and to tasks comes out even.
LEAST_RANGES = 1024
RANGES_A_PARTITION = 16
#: Sampled keys per range.
SAMPLES = 8
#: A range is overfull above so many times the mean bytes.
OVERFULL = 2.0
ROUNDS = 4

_LOWEST = -(1 << 63)
OUTPUT = ("shard", "slot")


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text, plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


class Splitters:
    """Ordered keys (hash, id); key k lies in the range of the last splitter <= k."""

    def __init__(self, keys: list[tuple[int, int]]) -> None:
        keys = sorted(set(keys))
        self.hashes = np.array([k[0] for k in keys], np.int64)
        self.ids = np.array([k[1] for k in keys], np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def keys(self) -> list[tuple[int, int]]:
        return list(zip(self.hashes.tolist(), self.ids.tolist()))

    def place(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.hashes, hashes, "left")
        high = np.searchsorted(self.hashes, hashes, "right")
        for h in np.unique(hashes[high > low]):
            mine = hashes == h
            a, b = low[mine][0], high[mine][0]
            low[mine] = a + np.searchsorted(self.ids[a:b], ids[mine], "right")
        return low.astype(np.int32)

    def column(self, hash_column: str, id_column: str) -> Column:
        """The range of each row: Python sees two longs a row, never the text."""

        @F.pandas_udf(T.IntegerType())
        def place(h: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series(self.place(h.to_numpy(np.int64), i.to_numpy(np.int64)))

        return place(hash_column, id_column)


def _sampled(keys: DataFrame, bytes_a_sample: float) -> list[tuple[int, int, float]]:
    """(hash, id, weight) of a sample with chance size / bytes_a_sample, at most one;
    each key stands for the bytes of the rows it was drawn from."""
    luck = F.pmod(F.xxhash64("_h", "_i", F.lit(17)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = keys.filter(luck * bytes_a_sample < F.col("size"))
    weight = F.greatest(F.col("size").cast("double"), F.lit(bytes_a_sample))
    rows = drawn.groupBy("_h", "_i").agg(F.sum(weight).alias("w")).collect()
    return sorted((r["_h"], r["_i"], r["w"]) for r in rows)


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[int]:
    """Places in the sorted sample where the next of ``parts`` equal weights begins."""
    ends = np.cumsum([s[2] for s in sample])
    wanted = ends[-1] * np.arange(1, parts) / parts
    places = np.searchsorted(ends, wanted, "left") + 1
    return sorted({int(p) for p in places if p < len(sample)})


def choose_splitters(keys: DataFrame, total: int, ranges: int) -> tuple[Splitters, list]:
    """Splitters, and (range, bytes, rows) of each range that has rows."""
    target = total / ranges
    sample = _sampled(keys, target / SAMPLES)
    found = Splitters([(sample[p][0], _LOWEST) for p in _quantiles(sample, ranges)]) if sample else Splitters([])
    for attempt in range(ROUNDS + 1):
        placed = keys.withColumn("range", found.column("_h", "_i"))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        overfull = {r["range"]: r["bytes"] for r in sums if r["bytes"] > OVERFULL * target and r["rows"] > 1}
        if not overfull or attempt == ROUNDS:
            break
        inside = placed.filter(F.col("range").isin(list(overfull)))
        more = _sampled(inside, target / SAMPLES)
        where = found.place(np.array([m[0] for m in more], np.int64), np.array([m[1] for m in more], np.int64))
        new = found.keys()
        for r, size in overfull.items():
            mine = [m for m, w in zip(more, where.tolist()) if w == r]
            if mine:
                new += [mine[p][:2] for p in _quantiles(mine, int(np.ceil(size / target)))]
        finer = Splitters(new)
        if len(finer) == len(found):
            break  # single keys cannot be cut
        found = finer
    return found, sums


def shard_records(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard`` (from 0) and ``slot`` (gapless in its shard)."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUT])
    keyed = docs.withColumns(
        {"_h": F.xxhash64(text_column), "_i": F.coalesce(F.col(id_column).cast("long"), F.lit(_LOWEST))}
    )
    keys = materialize(keyed.select("_h", "_i", row_size(text_column).alias("size")), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(LEAST_RANGES, RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters, sums = choose_splitters(keys, max(total, 1), ranges)
    plan, before, rows_in = [], 0, [0] * shards
    for r in sorted(sums):
        shard = min(shards - 1, int(shards * (before + r["bytes"] / 2) / total))
        plan.append((r["range"], shard, rows_in[shard]))
        before += r["bytes"]
        rows_in[shard] += r["rows"]
    plan = spark.createDataFrame(plan, "_range int, shard int, _first long")
    placed = keyed.withColumn("_range", splitters.column("_h", "_i")).join(F.broadcast(plan), "_range")
    order = W.partitionBy("_range").orderBy("_h", "_i", F.xxhash64(*docs.columns))
    slot = (F.col("_first") + F.row_number().over(order) - 1).alias("slot")
    return placed.select(*docs.columns, "shard", slot)


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder ``shard=n`` for each shard, its rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
