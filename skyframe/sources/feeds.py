"""Landed feed files: catalogue CSV and element-set JSON, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe import constants as K
from skyframe.functions.text import group_name, optional_string
from skyframe.session import broadcast_if_small

#: Names of groups that may be broadcast to the records.
MAX_GROUPS = 100_000

OMM_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (*K.OMM_FIELDS, "_corrupt_record")]
)


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds ``ordinal``, which orders records as they stand in the landed files."""
    return df.withColumn(
        "ordinal",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_satcat_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue records as text. The header must name the required fields; records
    without a number are dropped; a file without records is an error."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    raw = with_file_order(raw)
    raw = raw.select([F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in raw.columns])
    missing = sorted(set(K.SATCAT_REQUIRED_FIELDS) - set(raw.columns))
    if missing:
        raise ValueError("catalogue CSV lacks required fields: " + ", ".join(missing))
    absent = [c for c in K.SATCAT_FIELDS if c not in raw.columns]
    records = raw.withColumns({c: F.lit(None).cast("string") for c in absent}).filter(
        F.coalesce(F.col("NORAD_CAT_ID"), F.lit("")) != ""
    )
    if records.isEmpty():
        raise ValueError("catalogue CSV holds no records")
    return records.select(*K.SATCAT_FIELDS, "ordinal")


def read_gp_json(spark: SparkSession, path: str) -> DataFrame:
    """Element-set records from JSON arrays, all fields as text. Broken documents
    fail; so does an empty batch."""
    raw = spark.read.schema(OMM_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    records = with_file_order(raw)
    if records.isEmpty():
        raise ValueError("element-set JSON holds no records")
    return unbroken(records)


def unbroken(records: DataFrame) -> DataFrame:
    """The records; the job fails where a document could not be read."""
    broken = F.raise_error(
        F.format_string("broken record of %s: %s", F.col("NORAD_CAT_ID"), F.col("_corrupt_record"))
    )
    return records.filter(
        F.when(F.col("_corrupt_record").isNull(), F.lit(True)).otherwise(broken.cast("boolean"))
    ).drop("_corrupt_record")


def read_group_files(spark: SparkSession, path: str) -> DataFrame:
    """All group files of a folder partitioned as ``group=<NAME>``, in one read. A broken
    document fails, as in ``read_gp_json``."""
    raw = spark.read.schema(OMM_SCHEMA.add("group", T.StringType())).option("multiLine", True).json(path)
    return unbroken(with_file_order(raw).withColumn("group", group_name(F.col("group"))))


def current_gp(records: DataFrame, now: Column) -> DataFrame:
    """The second provider's own filter: not decayed and an epoch of the last ten
    days. Rows keep their order column; the provider's order by id is a sort key."""
    epoch = F.col("EPOCH").try_cast("timestamp")
    young = epoch > now - F.make_dt_interval(days=F.lit(K.CURRENT_GP_MAX_AGE_DAYS))
    return records.filter(optional_string(F.col("DECAY_DATE")).isNull() & young)


def guard_record_count(records: DataFrame, maximum: int | None = None) -> DataFrame:
    """``records`` itself, or an error when it holds more than ``maximum`` rows."""
    if maximum is not None and records.limit(maximum + 1).count() > maximum:
        raise ValueError(f"feed holds more than {maximum} records")
    return records


def group_record_report(records: DataFrame, maximum: int, group: str = "group") -> DataFrame:
    """Records of each group of a feed, and the ``error`` of those above the limit."""
    counted = records.groupBy(group).agg(F.count("*").alias("records"))
    text = F.format_string("group %s holds %s records; the limit is %s", F.col(group), F.col("records"), F.lit(maximum))
    return counted.withColumn("error", F.when(F.col("records") > maximum, text))


def within_group_limit(records: DataFrame, maximum: int, group: str = "group") -> DataFrame:
    """The records of groups within the limit, whole. The groups above it are few rows of
    a report, so the join sends them to the records and not the records to them."""
    over = group_record_report(records, maximum, group).filter("error IS NOT NULL").select(group)
    return records.join(broadcast_if_small(over, MAX_GROUPS), group, "left_anti")
