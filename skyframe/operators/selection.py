"""Latest and canonical element sets, quality, eligibility and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.functions.quality import (
    QualityLimits,
    age_seconds,
    ephemeris_status,
    propagation_allowed,
)


def _best_per_object(elements: DataFrame, order: Column) -> DataFrame:
    """One row per object by the greatest ``order``.

    ``max_by`` combines on the map side, so an object that owns a large share of
    the history is reduced before the shuffle, and no full sort is needed.
    """
    columns = [c for c in elements.columns if c != "object_id"]
    best = elements.groupBy("object_id").agg(F.max_by(F.struct(*columns), order).alias("best"))
    return best.select("object_id", *[F.col(f"best.{c}").alias(c) for c in columns]).select(elements.columns)


def latest_by_source(elements: DataFrame, source: str) -> DataFrame:
    """Newest element per object of one source; ties go to the greater id."""
    return _best_per_object(elements.filter(F.col("source") == source), F.struct("epoch", "element_id"))


def source_priority(source: Column) -> Column:
    expression = F.when(F.lit(False), F.lit(0))
    for name, rank in K.SOURCE_PRIORITY.items():
        expression = expression.when(source == name, F.lit(rank))
    return expression.otherwise(F.lit(K.OTHER_SOURCE_PRIORITY))


def earth_orbit_only(elements: DataFrame, objects: DataFrame) -> DataFrame:
    """Keep elements of earth-orbit objects, ahead of any ranking."""
    earth = objects.filter("is_earth_orbit").select(F.col("id").alias("object_id"))
    return elements.join(earth, "object_id", "left_semi")


def canonical_latest(elements: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Newest element per object over all sources. Source priority decides only
    between equal epochs, the greater id only between equal priorities. With
    ``objects`` given, earth-orbit objects only."""
    if objects is not None:
        elements = earth_orbit_only(elements, objects)
    order = F.struct(
        F.col("epoch").alias("epoch"),
        (-source_priority(F.col("source"))).alias("preference"),
        F.col("element_id").alias("element_id"),
    )
    return _best_per_object(elements, order)


def with_quality(elements: DataFrame, target: Column, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Adds age_seconds, age_hours, status and allowed at ``target``."""
    epoch = F.col("epoch")
    return elements.withColumns(
        {
            "age_seconds": age_seconds(epoch, target),
            "age_hours": age_seconds(epoch, target) / 3600.0,
            "status": ephemeris_status(epoch, target, limits),
            "allowed": propagation_allowed(epoch, target, limits),
        }
    )


def judge_canonical(
    elements: DataFrame, objects: DataFrame, target: Column, limits: QualityLimits = QualityLimits()
) -> DataFrame:
    """Canonical elements of earth-orbit objects with quality, object type and the
    ``eligible`` flag."""
    facts = objects.select(
        F.col("id").alias("object_id"), "object_type", "is_earth_orbit", F.lit(True).alias("known")
    )
    judged = with_quality(canonical_latest(elements, objects), target, limits).join(facts, "object_id", "left")
    eligible = F.col("allowed") & F.coalesce("known", F.lit(False)) & F.coalesce("is_earth_orbit", F.lit(False))
    return judged.withColumn("eligible", eligible).drop("known")


def eligible_elements(judged: DataFrame) -> DataFrame:
    return judged.filter("eligible").drop("eligible", "allowed", "object_type", "is_earth_orbit")


def selection_totals(judged: DataFrame) -> DataFrame:
    """One row: canonical_total, eligible_total, expired_total (all not eligible)."""
    return judged.agg(
        F.count("*").alias("canonical_total"),
        F.count_if("eligible").alias("eligible_total"),
        F.count_if(~F.col("eligible")).alias("expired_total"),
    )


def selection_counts(judged: DataFrame) -> DataFrame:
    """(dimension, value, objects): all by status and source, eligible by source
    and object type, in one pass with grouping sets over three small columns."""
    rows = judged.select(
        F.col("status"),
        F.col("source"),
        F.coalesce("object_type", F.lit("UNKNOWN")).alias("object_type"),
        "eligible",
    )
    grouped = rows.groupingSets(
        [("status",), ("source",), ("object_type",)], "status", "source", "object_type"
    ).agg(
        F.count("*").alias("all_rows"),
        F.count_if("eligible").alias("eligible_rows"),
        F.grouping_id().alias("gid"),
    )
    # grouping_id marks the columns that were grouped away: 3 keeps status,
    # 5 keeps source, 6 keeps the object type.
    entry = lambda dimension, value, count: F.struct(
        F.lit(dimension).alias("dimension"), value.alias("value"), count.alias("objects")
    )
    everything, usable = F.col("all_rows"), F.col("eligible_rows")
    entries = (
        F.when(F.col("gid") == 3, F.array(entry("status", F.col("status"), everything)))
        .when(
            F.col("gid") == 5,
            F.array(
                entry("source", F.col("source"), everything),
                entry("eligible_source", F.col("source"), usable),
            ),
        )
        .otherwise(F.array(entry("eligible_object_type", F.col("object_type"), usable)))
    )
    return grouped.select(F.inline(entries)).filter(F.col("objects") > 0)


def eligibility_report(judged: DataFrame) -> DataFrame:
    """Eligible objects per type with their share of all canonical objects in
    percent, largest first."""
    totals = judged.groupBy(F.coalesce("object_type", F.lit("UNKNOWN")).alias("object_type")).agg(
        F.count("*").alias("canonical"), F.count_if("eligible").alias("eligible")
    )
    return totals.withColumn("eligible_percent", F.col("eligible") * 100.0 / F.col("canonical")).orderBy(
        F.desc("eligible"), "object_type"
    )
