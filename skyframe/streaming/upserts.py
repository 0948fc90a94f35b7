"""Catalogue upserts on a stream: each batch changes the object table exactly once.

The table is a ``RunTable``: a batch is reduced to one change per object and composed with
the changes since the last merge, so what is stored is neither shuffled nor rewritten for it.
A batch that runs again has no further effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.operators.catalogue import (
    CATALOGUE_FIELDS,
    GP_FIELDS,
    OBJECT_TYPES,
    gp_elements,
    gp_objects,
    last_per_key,
    satcat_objects,
)
from skyframe.sources.run_table import RunTable
from skyframe.streaming.jobs import write_new_elements

KEY = "norad_cat_id"
FLAGS = {"has_current_elements": False, "is_on_orbit": True, "is_earth_orbit": False}


def object_table(spark: SparkSession, path: str) -> RunTable:
    return RunTable(spark, path, KEY, {"known_id": "bigint"} | OBJECT_TYPES, CATALOGUE_FIELDS)


def load_objects(table: RunTable, objects: DataFrame) -> None:
    """Fill an empty table (batch -1, so that batches of a stream come after it)."""
    rows = objects.withColumnRenamed("id", "known_id").withColumn("replaces", F.lit(True))
    table.write(rows.select(KEY, "replaces", "known_id", *OBJECT_TYPES), -1)


def read_objects(table: RunTable) -> DataFrame:
    """Objects after all batches. New ones take their catalogue number as id and start
    with the stored defaults."""
    flags = {c: F.coalesce(c, F.lit(v)) for c, v in FLAGS.items()}
    rows = table.read().withColumns(flags)
    return rows.select(F.coalesce("known_id", KEY).alias("id"), KEY, *OBJECT_TYPES)


def satcat_changes(records: DataFrame) -> DataFrame:
    """Catalogue records: the last one per object replaces its fields, nulls too."""
    return last_per_key(satcat_objects(records)).withColumn("replaces", F.lit(True))


def gp_changes(records: DataFrame) -> DataFrame:
    """Element-set records: the last value stated of each field, record by record."""
    batch = gp_objects(records)
    stated = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in GP_FIELDS]
    flags = {"has_current_elements": F.lit(True), "is_on_orbit": F.lit(True), "replaces": F.lit(False)}
    return batch.groupBy(KEY).agg(*stated).withColumns(flags)


def upsert_stream(records: DataFrame, changes: Callable[[DataFrame], DataFrame], table: RunTable, checkpoint: str):
    """Started query that takes up what is available now."""
    return (
        records.writeStream.foreachBatch(lambda batch, batch_id: table.write(changes(batch), batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def provider_batch(records: DataFrame, batch_id: int, table: RunTable, elements: str) -> None:
    """One batch of the second provider: the last record of each known object becomes an
    element set, if its epoch is new, and marks the object. Unknown objects are not created."""
    usable = records.filter(F.coalesce(F.col("NORAD_CAT_ID"), F.lit("")) != "")
    number = "catalogue_number"
    last = last_per_key(usable.withColumn(number, F.col("NORAD_CAT_ID").cast("bigint")), number)
    matched = table.known(last.drop("NORAD_CAT_ID").withColumnRenamed(number, KEY)).filter("stored").drop("stored")
    # The mapping reads the number as text. Column names do not tell upper and lower case apart.
    matched = matched.withColumns({KEY: F.col(KEY).cast("string"), "ordinal": F.lit(0)})
    mapped = gp_elements(matched, source="space-track")
    ids = read_objects(table).select(KEY, F.col("id").alias("object_id"))
    write_new_elements(mapped.join(ids, KEY).drop("ordinal"), batch_id, elements)
    # Marked after the elements are stored. If the batch runs again, both steps do. The numbers
    # alone say what to mark, so the records are not gathered again.
    numbers = usable.select(F.col("NORAD_CAT_ID").cast("bigint").alias(KEY)).distinct()
    marks = table.known(numbers).filter("stored").select(KEY, F.lit(False).alias("replaces"), F.lit(True).alias("has_current_elements"))
    table.write(marks, batch_id)


def provider_stream(records: DataFrame, table: RunTable, elements: str, checkpoint: str):
    """Started query: ``provider_batch`` for what is available now."""
    return (
        records.writeStream.foreachBatch(lambda batch, batch_id: provider_batch(batch, batch_id, table, elements))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
