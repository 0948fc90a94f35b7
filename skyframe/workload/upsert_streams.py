"""Queries: catalogue upserts that arrive in parts on a stream."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from skyframe.session import checkpoint_dir
from skyframe.streaming import jobs as J
from skyframe.streaming import upserts as U
from skyframe.workload import views as V
from skyframe.workload.catalogue import ELEMENT_NUMBERS, GP, gp_records, satcat_records
from skyframe.workload.registry import REGISTRY, query
from skyframe.workload.views import ELEMENTS, OBJECTS, with_views

PARTS = 3
#: Bytes of a row group of the records: what a task of a batch reads at least.
ROW_GROUP_BYTES = 4 << 20


def work_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/streams_{spark.sparkContext.applicationId}/{name}_{uuid4().hex[:8]}"


def arrivals(records, work: str):
    """Streams over the records in parts of their order; a part's files land before its stream.

    A part is a stretch of the records, so only some tasks hold it. All parts are written
    in one pass, and in row groups small enough to be dealt out again.
    """
    spark = records.sparkSession
    low, high = records.agg(F.min("ordinal"), F.max("ordinal")).first()
    if low is None:
        return
    part = F.floor((F.col("ordinal") - low) * PARTS / (high - low + 1))
    parts = records.withColumn("part", part).write.partitionBy("part").option("parquet.block.size", ROW_GROUP_BYTES)
    parts.parquet(f"{work}/parts")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{work}/input")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    for i in range(PARTS):
        if J.path_exists(spark, f"{work}/parts/part={i}"):
            if not system.rename(hadoop.Path(f"{work}/parts/part={i}"), hadoop.Path(target, str(i))):
                raise OSError(f"part {i} of {work} cannot be moved to its input folder")
            yield spark.readStream.schema(records.schema).parquet(f"{work}/input/*")


def _upserted(spark, folder, name, records, changes):
    """Objects after all parts have come, each taken up by a run of its own."""
    work = work_folder(spark, name)
    table = U.object_table(spark, f"{work}/objects")
    U.load_objects(table, V.objects(spark, folder))
    for stream in arrivals(records, work):
        U.upsert_stream(stream, changes, table, f"{work}/state").awaitTermination()
    return U.read_objects(table)


@query(REGISTRY["satcat_upsert"].sql)
def stream_satcat_upsert(spark, folder):
    """D1 on a stream: equal to one batch of all records."""
    return _upserted(spark, folder, "satcat", satcat_records(spark, folder), U.satcat_changes)


@query(REGISTRY["gp_upsert"].sql)
def stream_gp_upsert(spark, folder):
    """D2 on a stream: fields that a record does not state stay, over all batches."""
    return _upserted(spark, folder, "gp", gp_records(spark, folder), U.gp_changes)


@query(
    with_views(OBJECTS, ELEMENTS, GP)
    + f"""SELECT object_id, epoch_us(epoch) AS epoch_us, {", ".join(ELEMENT_NUMBERS)} FROM (
      SELECT *, row_number() OVER (PARTITION BY object_id, epoch ORDER BY part) AS first FROM (
        SELECT g.* EXCLUDE (object_id), o.id AS object_id, row_number() OVER (PARTITION BY part, g.norad_cat_id ORDER BY ordinal DESC) AS n
        FROM (SELECT *, floor((ordinal - min(ordinal) OVER ()) * {PARTS} / (max(ordinal) OVER () - min(ordinal) OVER () + 1)) AS part FROM gp) g
        JOIN objects o ON o.norad_cat_id = g.norad_cat_id) WHERE n = 1) b
    WHERE first = 1 AND NOT EXISTS (SELECT 1 FROM elements e
      WHERE e.object_id = b.object_id AND e.source = 'space-track' AND e.epoch = b.epoch)"""
)
def stream_provider_sync(spark, folder):
    """D6 on a stream: new element sets of known objects, each stored once."""
    work = work_folder(spark, "provider")
    table = U.object_table(spark, f"{work}/objects")
    U.load_objects(table, V.objects(spark, folder))
    absent = {c: F.lit(None).cast("int") for c in ("element_set_no", "rev_at_epoch")}
    J.write_new_elements(V.elements(spark, folder).withColumns(absent), -1, f"{work}/elements")
    records = gp_records(spark, folder)
    for stream in arrivals(records, work):
        U.provider_stream(stream, table, f"{work}/elements", f"{work}/state").awaitTermination()
    stored = spark.read.option("mergeSchema", True).parquet(f"{work}/elements").filter("batch_id >= 0")
    return stored.select("object_id", F.unix_micros("epoch").alias("epoch_us"), *ELEMENT_NUMBERS)
