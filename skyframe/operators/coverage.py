"""Catalogue coverage, status histograms and legends, zero filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.functions.quality import QualityLimits, ephemeris_status
from skyframe.functions.text import display_kind


def zero_filled(counted: DataFrame, key: str, values: tuple[str, ...], count: str = "objects") -> DataFrame:
    """Every value of a short fixed list with its count, absent ones as zero."""
    spark = counted.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(key))
    return wanted.join(counted, key, "left").select(
        key, F.coalesce(count, F.lit(0)).cast("bigint").alias(count)
    )


def object_coverage(objects: DataFrame) -> DataFrame:
    """Objects in total, in earth orbit, with elements, and both; one pass."""
    earth, current = F.col("is_earth_orbit"), F.col("has_current_elements")
    return objects.agg(
        F.count("*").alias("total_objects"),
        F.count_if(earth).alias("earth_orbit_objects"),
        F.count_if(current).alias("objects_with_elements"),
        F.count_if(earth & current).alias("earth_orbit_with_elements"),
    )


def latest_epochs(elements: DataFrame) -> DataFrame:
    """Newest epoch per object: age needs neither source priority nor the record."""
    return elements.groupBy("object_id").agg(F.max("epoch").alias("epoch"))


def status_histogram(
    elements: DataFrame, objects: DataFrame, now: Column, limits: QualityLimits = QualityLimits()
) -> DataFrame:
    """Earth-orbit objects by age of their newest element; all four statuses."""
    earth = objects.filter("is_earth_orbit").select(F.col("id").alias("object_id"))
    newest = latest_epochs(elements.join(earth, "object_id", "left_semi"))
    counted = newest.groupBy(ephemeris_status(F.col("epoch"), now, limits).alias("status")).agg(
        F.count("*").alias("objects")
    )
    return zero_filled(counted, "status", K.EPHEMERIS_STATUSES)


def coverage_metrics(
    elements: DataFrame, objects: DataFrame, now: Column, limits: QualityLimits = QualityLimits()
) -> DataFrame:
    """(metric, value): object counts, objects with any element, eligible objects and
    the status histogram, from one pass over each table."""
    newest = latest_epochs(elements)
    facts = objects.select(F.col("id").alias("object_id"), "is_earth_orbit", "has_current_elements")
    rows = facts.join(newest, "object_id", "full_outer")
    status = ephemeris_status(F.col("epoch"), now, limits)
    known, earth = F.col("is_earth_orbit").isNotNull(), F.col("is_earth_orbit")
    tracked = F.col("epoch").isNotNull()
    counted = rows.agg(
        F.count_if(known).alias("catalog_total_objects"),
        F.count_if(earth).alias("earth_orbit_objects"),
        F.count_if("has_current_elements").alias("objects_with_current_elements"),
        F.count_if(tracked).alias("canonical_elements_total"),
        F.count_if(earth & tracked & (status != "expired")).alias("screening_eligible_objects"),
        *[
            F.count_if(earth & tracked & (status == s)).alias(f"ephemeris_objects_{s}")
            for s in K.EPHEMERIS_STATUSES
        ],
    )
    return counted.unpivot([], counted.columns, "metric", "value")


def propagation_status_counts(states: DataFrame, runs: DataFrame) -> DataFrame:
    """States of the latest propagation run by ephemeris status, zero filled."""
    newest = runs.agg(F.max("run_id")).scalar()
    counted = (
        states.filter(F.col("run_id") == newest)
        .groupBy(F.col("ephemeris_status").alias("status"))
        .agg(F.count("*").alias("objects"))
    )
    return zero_filled(counted, "status", K.EPHEMERIS_STATUSES)


def kind_legend(objects: DataFrame) -> DataFrame:
    """Objects by the four display kinds, zero filled."""
    counted = objects.groupBy(display_kind(F.col("object_type")).alias("kind")).agg(
        F.count("*").alias("objects")
    )
    return zero_filled(counted, "kind", K.DISPLAY_KINDS)


def objects_with_source(elements: DataFrame, source: str) -> DataFrame:
    """Distinct objects that have an element of a source."""
    return elements.filter(F.col("source") == source).agg(
        F.count_distinct("object_id").alias("objects")
    )


#: Registers of a distinct-count sketch, as a power of two: 64 kB a sketch, 0.4 % of error.
SKETCH_BITS = 16


def distinct_sketches(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """One mergeable sketch of the distinct keys per group, to be stored beside the rows."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(key, SKETCH_BITS).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Estimated distinct keys of wider groups, from stored sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
