"""A keyed table as two bucketed runs, changed batch by batch.

The base run holds rows, the delta run the changes since it was written. Both are Parquet
tables bucketed and sorted by the key, so they meet each other, and a batch meets them, without
an exchange of stored rows. A batch is composed with the delta alone; only when the delta
has grown to a share of the base is it merged into a new base.

A change either states single fields (null: says nothing, the stored value stays) or
replaces the fields named ``replaced`` (null is then a value). Changes compose: two in a row are
one change, which is what lets a delta stand for many batches.

Exactly once: every batch writes new folders and then a manifest that names the current two.
The manifest is the commit mark. A batch that runs again starts from the manifest before its
own and writes the same. Folders that the two newest manifests do not name are removed.
The files are the truth; a session's catalogue only names them.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The delta is merged into the base when it has more than this share of its rows.
DELTA_SHARE = 0.25
MANIFEST = "batch_id long, base string, delta string, base_rows long, delta_rows long, buckets int"


class RunTable:
    """``fields`` are the columns beside ``key`` and their types."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: dict[str, str], replaced: tuple[str, ...]) -> None:
        self.spark, self.path, self.key, self.fields, self.replaced = spark, path, key, fields, replaced
        self.digest = sha256(path.encode()).hexdigest()[:16]

    def _files(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place, system = self._files()
        inside = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, folder) if folder else place
        return [s.getPath().getName() for s in system.listStatus(inside)] if system.exists(inside) else []

    def manifest(self, before: int | None = None) -> dict | None:
        """The newest committed state, or the newest before a batch."""
        committed = [int(n) for n in self._names("manifests") if "_SUCCESS" in self._names(f"manifests/{n}")]
        known = [b for b in committed if before is None or b < before]
        if not known:
            return None
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{max(known)}").first().asDict()

    def _run(self, name: str | None, buckets: int) -> DataFrame:
        columns = {self.key: "bigint", "replaces": "boolean"} | self.fields
        if name is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items()))
        table = f"run_{self.digest}_{name}"
        if not self.spark.catalog.tableExists(table):
            ddl = ", ".join(f"`{c}` {t}" for c, t in columns.items())
            self.spark.sql(
                f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) "
                f"INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(table)

    def _write(self, rows: DataFrame, name: str, buckets: int) -> DataFrame:
        table = f"run_{self.digest}_{name}"
        ordered = rows.select(self.key, "replaces", *self.fields)
        (
            ordered.write.mode("overwrite").format("parquet").bucketBy(buckets, self.key).sortBy(self.key)
            .option("path", f"{self.path}/{name}").saveAsTable(table)
        )
        return self.spark.table(table)

    def composed(self, older: DataFrame, newer: DataFrame) -> DataFrame:
        """Two runs of changes as one."""
        names = ("replaces", *self.fields)
        old = older.select(self.key, F.struct(*names).alias("old"))
        new = newer.select(self.key, F.struct(*names).alias("new"))

        def field(name: str) -> Column:
            kept = F.coalesce(f"new.{name}", f"old.{name}")
            return F.when(F.col("new.replaces"), F.col(f"new.{name}")).otherwise(kept) if name in self.replaced else kept

        replaces = F.coalesce("new.replaces", F.lit(False)) | F.coalesce("old.replaces", F.lit(False))
        both = old.join(new, self.key, "full_outer")
        return both.select(self.key, replaces.alias("replaces"), *[field(c).alias(c) for c in self.fields])

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """Take up a batch of changes: the key once each, ``replaces``, and any of the fields."""
        absent = {c: F.lit(None).cast(t) for c, t in self.fields.items() if c not in changes.columns}
        changes = changes.withColumns(absent) if absent else changes
        last = self.manifest(batch_id)
        if last is None:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            base = self._write(changes, f"base_{self._number(batch_id)}", buckets)
            self._commit(batch_id, f"base_{self._number(batch_id)}", None, base.count(), 0, buckets)
            return
        buckets, name = last["buckets"], f"delta_{self._number(batch_id)}"
        if last["delta"] is None:
            delta = self._write(changes, name, buckets)
        else:
            delta = self._write(self.composed(self._run(last["delta"], buckets), changes), name, buckets)
        size = delta.count()
        if size <= DELTA_SHARE * last["base_rows"]:
            self._commit(batch_id, last["base"], name, last["base_rows"], size, buckets)
            return
        merged = f"base_{self._number(batch_id)}"
        base = self._write(self.composed(self._run(last["base"], buckets), delta), merged, buckets)
        self._commit(batch_id, merged, None, base.count(), 0, buckets)

    @staticmethod
    def _number(batch_id: int) -> str:
        return str(batch_id).replace("-", "m")

    def _commit(self, batch_id: int, base: str, delta: str | None, base_rows: int, delta_rows: int, buckets: int) -> None:
        row = self.spark.createDataFrame([(batch_id, base, delta, base_rows, delta_rows, buckets)], MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{batch_id}")
        before = self.manifest(batch_id)
        named = {base, delta} | ({before["base"], before["delta"]} if before else set())
        place, system = self._files()
        for old in self._names(""):
            if old != "manifests" and old not in named:
                self.spark.sql(f"DROP TABLE IF EXISTS run_{self.digest}_{old}")
                system.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, old), True)

    def read(self) -> DataFrame:
        """The rows after all committed batches: one join, and no exchange."""
        last = self.manifest()
        if last is None:
            return self._run(None, 1).drop("replaces")
        base = self._run(last["base"], last["buckets"])
        rows = base if last["delta"] is None else self.composed(base, self._run(last["delta"], last["buckets"]))
        return rows.select(self.key, *self.fields)

    def known(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``stored``: whether their key is in the table. Only ``rows`` are
        dealt out anew."""
        last = self.manifest()
        stored = F.lit(False)
        for number, name in enumerate([last["base"], last["delta"]] if last else []):
            if name is not None:
                mark = f"in_run_{number}"
                keys = self._run(name, last["buckets"]).select(self.key, F.lit(True).alias(mark))
                rows, stored = rows.join(keys.hint("merge"), self.key, "left"), stored | F.coalesce(mark, F.lit(False))
        return rows.withColumn("stored", stored).drop("in_run_0", "in_run_1")
