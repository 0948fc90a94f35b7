"""Line dedup by levelled sorted runs: lines that many documents share lose all their places.

A run is a table of line hashes and of how many documents hold each, cut into hash buckets
and sorted inside them. Documents come in batches. The counts of a batch are merge-anti-joined
with the runs of settled hashes (those already known to be common), and what is left becomes
a run of level 0. ``fan_out`` runs of one level are compacted into one of the next: counts are
added up, hashes that reach ``min_docs`` move to a settled run, the others stay open. Runs of
one bucketing meet without an exchange of stored rows. After the last batch all open runs
are compacted once more, and the settled runs hold exactly the common lines.

All steps are DataFrame functions. Line keys are compared by two 64-bit hashes together.

Defined results: a null or empty text is one empty line. A line whose key is empty always
stays. Every row is a document, so repeated rows count as often as they occur, null ids too.
An empty table gives no rows. Input columns come back as they are, whatever their names;
one that is named like an output (n_lines, n_dropped, kept) is replaced by it.
"""

from __future__ import annotations

import string
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.session import materialize, new_folder

MIN_DOCS = 10
BATCHES = 4
FAN_OUT = 2
#: A hash is hot if it holds this share of all lines, so at most so many hashes are hot.
HOT_SHARE = 4096
WHITE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    # lower() is quick and the same on plain ASCII; beyond it only A-Z may change.
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def pair_of_hashes(*columns: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of some columns."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs) as bucketed tables.

    The tables are named ``{name}_{level}_{number}`` and ``{name}_settled_{number}``, so
    with a catalogue that outlives the session later batches go on where others ended.
    """

    def __init__(self, spark: SparkSession, name: str, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT) -> None:
        self.spark, self.name, self.min_docs, self.fan_out = spark, name, min_docs, fan_out
        # As many buckets as a shuffle has partitions: then stored rows are never dealt out again.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[str, list[str]] = {}
        for found in spark.catalog.listTables(pattern=f"{name}_*"):
            self.levels.setdefault(found.name.removeprefix(f"{name}_").rsplit("_", 1)[0], []).append(found.name)

    def _write(self, counts: DataFrame, level: str) -> None:
        run = f"{self.name}_{level}_{uuid4().hex}"
        placed = counts.select(*HASH, "n_docs").repartition(self.buckets, *HASH)
        placed.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").saveAsTable(run)
        self.levels.setdefault(level, []).append(run)

    def _merged(self, runs: list[str]) -> DataFrame:
        # A run holds a hash once, so runs are merged pair by pair like sorted lists.
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnRenamed("n_docs", "more")
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            return a.join(b.hint("merge"), HASH, "full_outer").select(*HASH, n_docs.alias("n_docs"))

        return reduce(both, [self.spark.table(r) for r in runs])

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """``counts`` without the hashes that are known to be common."""
        for run in self.levels.get("settled", []):
            counts = counts.join(self.spark.table(run).hint("merge"), HASH, "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """One batch: (h1, h2, n_docs), each hash once."""
        self._write(self.unsettled(counts), "0")
        level = 0
        while len(self.levels.get(str(level), [])) >= self.fan_out:
            self._compact([str(level)], str(level + 1))
            level += 1
        if len(self.levels.get("settled", [])) > self.fan_out:
            settled = self.levels.pop("settled")
            self._write(self._merged(settled), "settled")
            self._drop(settled)

    def _compact(self, levels: list[str], to: str | None) -> None:
        runs = [r for level in levels for r in self.levels.pop(level, [])]
        if not runs:
            return
        merged = self._merged(runs)
        self._write(merged.filter(F.col("n_docs") >= self.min_docs), "settled")
        if to is not None:
            self._write(merged.filter(F.col("n_docs") < self.min_docs), to)
            self._drop(runs)
        else:
            self.levels["open"] = runs

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def settled(self) -> DataFrame:
        """(h1, h2) of all common lines after the batches so far, each once."""
        self._compact([x for x in self.levels if x != "settled"], None)
        runs = self.levels.get("settled", [])
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(runs).select(*HASH)


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fan_out: int = FAN_OUT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept: the text without lines whose key at
    least ``min_docs`` documents hold. ``batches`` is how many deliveries the table is
    taken in; the result does not depend on it."""
    spark = docs.sparkSession
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input"))
    text, named = F.col("input")[text_column], F.col("input")[id_column]
    row_id = [c.alias(n) for c, n in zip(pair_of_hashes(text, named), ("i1", "i2"))]

    # All keys of a document in order, so that the first place of each key is known.
    keys = F.transform(lines_of(text), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("at")))
    in_order = packed.select(*row_id, F.array_sort(F.filter(keys, lambda k: k["key"] != "")).alias("keys"))
    marked = F.transform(
        "keys",
        lambda k, i: F.struct(
            k["at"].alias("at"),
            *[h.alias(n) for h, n in zip(pair_of_hashes(k["key"]), HASH)],
            ((i == 0) | (F.get("keys", i - 1)["key"] != k["key"])).alias("first"),
        ),
    )
    batch = F.pmod(F.col("i1"), F.lit(batches)).cast("int").alias("batch")
    folder = new_folder(spark, "lines")
    in_order.select("i1", "i2", batch, F.explode(marked).alias("k")).select("i1", "i2", "batch", "k.*").write.partitionBy(
        "batch"
    ).parquet(folder)
    lines = spark.read.schema("i1 long, i2 long, at int, h1 long, h2 long, first boolean, batch int").parquet(folder)

    runs = LineRuns(spark, f"lines_{uuid4().hex}", min_docs, fan_out)
    for number in range(batches):
        some = lines.filter((F.col("batch") == number) & F.col("first"))
        runs.add(some.groupBy(*HASH).agg(F.count("*").alias("n_docs")))
    common = materialize(runs.settled(), "common_lines")

    # A hot line is in many documents: its places are marked where they lie, by a broadcast
    # of at most HOT_SHARE hashes. All other lines are few of a kind and meet by a shuffle.
    total = lines.count()
    hot = lines.groupBy(*HASH).count().filter(F.col("count") * HOT_SHARE > total).select(*HASH)
    hot = materialize(hot, "hot_lines")
    hot_common = F.broadcast(hot.join(common, HASH, "left_semi"))
    places = lines.join(hot_common, HASH, "left_semi").unionByName(
        lines.join(F.broadcast(hot), HASH, "left_anti").join(common, HASH, "left_semi")
    )
    dropped = places.groupBy("i1", "i2").agg(F.collect_set("at").alias("dropped"))

    found = packed.select("input", *row_id).join(dropped, ["i1", "i2"], "left")
    found = found.select("input", lines_of(text).alias("lines"), "dropped")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    outputs = {
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
        "kept": F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(kept),
    }
    found = found.select("input", F.struct(*[c.alias(n) for n, c in outputs.items()]).alias("output"))
    same = [F.col("input")[c].alias(c) for c in docs.columns if c.lower() not in outputs]
    return found.select(*same, "output.*")
