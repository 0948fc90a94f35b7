"""Feed mapping, upserts and tags of the object catalogue.

Tables are plain Parquet, so an upsert is a full outer join and an overwrite, and
an insert-if-new is a left anti join and an append. Every batch is first reduced
to one row per key with aggregates that combine on the map side: a key that fills
a large share of a batch costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.functions.text import (
    lenient_date,
    lenient_double,
    object_type,
    optional_string,
    strict_date,
    strict_double,
    strict_epoch,
    strict_int,
)

CATALOGUE_FIELDS = (
    "object_name", "object_id", "object_type", "ops_status_code", "owner", "launch_date",
    "launch_site", "decay_date", "period_minutes", "inclination_deg", "apogee_km", "perigee_km",
    "rcs_m2", "data_status_code", "orbit_center", "orbit_type", "is_on_orbit", "is_earth_orbit",
    "source",
)
GP_FIELDS = ("object_name", "object_id", "object_type", "country_code", "launch_date", "decay_date", "source")
OBJECT_TYPES = {
    "object_name": "string", "object_id": "string", "object_type": "string",
    "ops_status_code": "string", "owner": "string", "country_code": "string",
    "launch_date": "date", "launch_site": "string", "decay_date": "date",
    "period_minutes": "double", "inclination_deg": "double", "apogee_km": "double",
    "perigee_km": "double", "rcs_m2": "double", "data_status_code": "string",
    "orbit_center": "string", "orbit_type": "string", "is_on_orbit": "boolean",
    "is_earth_orbit": "boolean", "has_current_elements": "boolean", "source": "string",
}
ELEMENT_KEY = ("object_id", "source", "epoch")
TAG_KEY = ("orbital_object_id", "namespace", "tag")


def _named(name: Column, norad: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("NORAD "), norad.cast("string")))


def _norad(column: str) -> Column:
    text = F.col(column)
    missing = F.raise_error(F.lit("record is missing NORAD_CAT_ID")).cast("bigint")
    return F.when(text.isNull() | (text == ""), missing).otherwise(text.cast("bigint"))


def is_earth_orbit(decay_date: Column, center: Column, orbit_type: Column) -> Column:
    return decay_date.isNull() & center.eqNullSafe(F.lit("EA")) & orbit_type.eqNullSafe(F.lit("ORB"))


def satcat_objects(records: DataFrame) -> DataFrame:
    """Catalogue records to object rows (``norad_cat_id``, fields, ``ordinal``)."""
    norad = _norad("NORAD_CAT_ID")
    decay = lenient_date(F.col("DECAY_DATE"))
    center, kind = optional_string(F.col("ORBIT_CENTER")), optional_string(F.col("ORBIT_TYPE"))
    return records.select(
        norad.alias("norad_cat_id"),
        _named(optional_string(F.col("OBJECT_NAME")), norad).alias("object_name"),
        optional_string(F.col("OBJECT_ID")).alias("object_id"),
        object_type(F.col("OBJECT_TYPE")).alias("object_type"),
        optional_string(F.col("OPS_STATUS_CODE")).alias("ops_status_code"),
        optional_string(F.col("OWNER")).alias("owner"),
        lenient_date(F.col("LAUNCH_DATE")).alias("launch_date"),
        optional_string(F.col("LAUNCH_SITE")).alias("launch_site"),
        decay.alias("decay_date"),
        lenient_double(F.col("PERIOD")).alias("period_minutes"),
        lenient_double(F.col("INCLINATION")).alias("inclination_deg"),
        lenient_double(F.col("APOGEE")).alias("apogee_km"),
        lenient_double(F.col("PERIGEE")).alias("perigee_km"),
        lenient_double(F.col("RCS")).alias("rcs_m2"),
        optional_string(F.col("DATA_STATUS_CODE")).alias("data_status_code"),
        center.alias("orbit_center"),
        kind.alias("orbit_type"),
        decay.isNull().alias("is_on_orbit"),
        is_earth_orbit(decay, center, kind).alias("is_earth_orbit"),
        F.lit("celestrak").alias("source"),
        "ordinal",
    )


def gp_objects(records: DataFrame) -> DataFrame:
    """Element-set records to object rows. A null means that the record says
    nothing about the field, so it must not blank a stored value."""
    norad = _norad("NORAD_CAT_ID")

    def stated(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    return records.select(
        norad.alias("norad_cat_id"),
        _named(stated("OBJECT_NAME"), norad).alias("object_name"),
        stated("OBJECT_ID").alias("object_id"),
        F.when(stated("OBJECT_TYPE").isNotNull(), object_type(F.col("OBJECT_TYPE"))).alias("object_type"),
        stated("COUNTRY_CODE").alias("country_code"),
        strict_date(F.col("LAUNCH_DATE")).alias("launch_date"),
        strict_date(F.col("DECAY_DATE")).alias("decay_date"),
        F.lit("celestrak").alias("source"),
        "ordinal",
    )


def missing_fields() -> Column:
    """Names of the required element fields that a record leaves blank."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(name))
                for name in K.OMM_REQUIRED_FIELDS
            ]
        )
    )


def split_complete(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete records, rejected records with the list of ``missing`` fields)."""
    marked = records.withColumn("missing", missing_fields())
    return marked.filter(F.size("missing") == 0).drop("missing"), marked.filter(F.size("missing") > 0)


def gp_elements(records: DataFrame, source: str = "celestrak") -> DataFrame:
    """Element-set records to element rows, keyed by ``norad_cat_id``. A record
    without a required field fails the job, naming the fields; use
    ``split_complete`` to set such records aside. The whole record is kept."""
    missing = missing_fields()
    message = F.concat(F.lit("record is missing required fields: "), F.array_join(missing, ", "))
    raw = F.to_json(F.struct(*[c for c in records.columns if c in K.OMM_FIELDS]))
    number = {name: strict_double(F.col(name)) for name in K.OMM_REQUIRED_FIELDS}
    return records.select(
        _norad("NORAD_CAT_ID").alias("norad_cat_id"),
        F.when(F.size(missing) > 0, F.raise_error(message).cast("string")).otherwise(F.lit(source)).alias("source"),
        strict_epoch(F.col("EPOCH")).alias("epoch"),
        strict_int(F.col("ELEMENT_SET_NO")).alias("element_set_no"),
        strict_int(F.col("EPHEMERIS_TYPE")).alias("ephemeris_type"),
        *[number[name].alias(name.lower()) for name in K.OMM_REQUIRED_FIELDS],
        strict_double(F.col("MEAN_MOTION_DOT")).alias("mean_motion_dot"),
        strict_double(F.col("MEAN_MOTION_DDOT")).alias("mean_motion_ddot"),
        strict_double(F.col("BSTAR")).alias("bstar"),
        strict_int(F.col("REV_AT_EPOCH")).alias("rev_at_epoch"),
        raw.alias("raw_omm"),
        "ordinal",
    )


def with_raw_variant(records: DataFrame, name: str = "raw") -> DataFrame:
    """Records with the whole record as one variant: fields that nobody parses at ingest
    keep their names and can be read later (``raw_field``), without text to parse again."""
    fields = [c for c in records.columns if c != "ordinal"]
    return records.withColumn(name, F.parse_json(F.to_json(F.struct(*fields))))


def raw_field(path: str, kind: str = "string", name: str = "raw") -> Column:
    """A field of stored raw records; null where a record lacks it or it does not fit."""
    return F.try_variant_get(name, f"$.{path}", kind)


def last_per_key(batch: DataFrame, key: str = "norad_cat_id") -> DataFrame:
    """The last record per key in batch order."""
    columns = [c for c in batch.columns if c not in (key, "ordinal")]
    best = batch.groupBy(key).agg(F.max_by(F.struct(*columns), "ordinal").alias("r"))
    return best.select(key, "r.*")


def _outer(objects: DataFrame, batch: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Stored and batch rows side by side; ``fields`` gives the batch's columns."""
    known = objects.select("norad_cat_id", F.struct(*objects.columns).alias("old"))
    return known.join(batch, "norad_cat_id", "full_outer").select(
        "norad_cat_id",
        F.coalesce("old.id", "norad_cat_id").alias("id"),
        *[
            fields.get(c, F.col(f"old.{c}")).alias(c)
            for c in objects.columns
            if c not in ("id", "norad_cat_id")
        ],
    ).select(objects.columns)


def upsert_satcat(objects: DataFrame, batch: DataFrame) -> DataFrame:
    """Objects after a catalogue batch: each batch field overwrites, nulls too.

    A new object takes its catalogue number as id: unique, the same on every
    retry, and assigned without coordination.
    """
    last = last_per_key(batch).select("norad_cat_id", F.struct(*CATALOGUE_FIELDS).alias("new"))
    fields = {
        c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        for c in CATALOGUE_FIELDS
    }
    fields["has_current_elements"] = F.coalesce("old.has_current_elements", F.lit(False))
    return _outer(objects, last, fields)


def satcat_report(objects: DataFrame, batch: DataFrame) -> DataFrame:
    """One row of batch counts: created / updated, types, on orbit / decayed."""
    last = last_per_key(batch)
    known = objects.select("norad_cat_id", F.lit(True).alias("stored"))
    rows = last.join(known, "norad_cat_id", "left")
    kind = F.col("object_type")
    return rows.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("stored").isNull()).alias("created"),
        F.count_if(F.col("stored").isNotNull()).alias("updated"),
        F.count_if(kind == "PAYLOAD").alias("payloads"),
        F.count_if(kind == "ROCKET_BODY").alias("rocket_bodies"),
        F.count_if(kind == "DEBRIS").alias("debris"),
        F.count_if(kind == "UNKNOWN").alias("unknown"),
        F.count_if(~kind.isin(*K.COUNTED_OBJECT_TYPES)).alias("other"),
        F.count_if("is_on_orbit").alias("on_orbit"),
        F.count_if(~F.col("is_on_orbit")).alias("decayed"),
    )


def upsert_gp(objects: DataFrame, batch: DataFrame, with_elements: bool = True) -> DataFrame:
    """Objects after an element-set batch: only stated fields overwrite, record by
    record, so the last stated value of a batch counts per field. With elements the
    object also gets ``has_current_elements`` and ``is_on_orbit``."""
    stated = batch.groupBy("norad_cat_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in GP_FIELDS]
    )
    merged = stated.select("norad_cat_id", F.struct(*GP_FIELDS).alias("new"))
    present = F.col("new").isNotNull()
    fields = {c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) for c in GP_FIELDS}
    if with_elements:
        for flag in ("has_current_elements", "is_on_orbit"):
            fields[flag] = F.when(present, F.lit(True)).otherwise(F.col(f"old.{flag}"))
    for flag in ("has_current_elements", "is_on_orbit", "is_earth_orbit"):
        # A new object starts with the stored defaults.
        default = F.lit(flag == "is_on_orbit")
        fields[flag] = F.coalesce(fields.get(flag, F.col(f"old.{flag}")), default)
    return _outer(objects, merged, fields)


def gp_report(objects: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts of a record-by-record upsert: the first record of a new object
    creates it, every other record updates."""
    per_key = batch.groupBy("norad_cat_id").agg(F.count("*").alias("records"))
    known = objects.select("norad_cat_id", F.lit(True).alias("stored"))
    rows = per_key.join(known, "norad_cat_id", "left")
    created = F.count_if(F.col("stored").isNull())
    records = F.coalesce(F.sum("records"), F.lit(0)).cast("bigint")
    return rows.agg(
        records.alias("records"),
        created.alias("objects_created"),
        (records - created).alias("objects_updated"),
    )


def new_elements(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch elements whose (object, source, epoch) is not stored yet; the first
    record wins inside the batch. ``batch`` carries ``ordinal``."""
    columns = [c for c in batch.columns if c not in (*ELEMENT_KEY, "ordinal")]
    first = batch.groupBy(*ELEMENT_KEY).agg(F.min_by(F.struct(*columns), "ordinal").alias("r"))
    return first.select(*ELEMENT_KEY, "r.*").join(stored.select(*ELEMENT_KEY), list(ELEMENT_KEY), "left_anti")


def attach_objects(batch: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of known objects with ``object_id``, records of unknown objects)."""
    known = objects.select("norad_cat_id", F.col("id").alias("object_id"))
    return (
        batch.join(known, "norad_cat_id", "inner"),
        batch.join(known, "norad_cat_id", "left_anti"),
    )


def provider_sync(
    records: DataFrame, objects: DataFrame, stored: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Second-provider batch: (new elements, objects after, one-row report).

    Blank numbers are skipped, the last record per number counts, unknown objects
    are counted and never created, known ones get ``has_current_elements``.
    """
    usable = records.filter(F.coalesce(F.col("NORAD_CAT_ID"), F.lit("")) != "")
    number = "catalogue_number"
    last = last_per_key(usable.withColumn(number, F.col("NORAD_CAT_ID").cast("bigint")), number)
    known = objects.select(F.col("norad_cat_id").alias(number), F.lit(True).alias("known"))
    matched = last.join(known.select(number), number, "left_semi").withColumn("ordinal", F.lit(0))
    mapped, _ = attach_objects(gp_elements(matched, source="space-track"), objects)
    fresh = new_elements(mapped, stored)
    touched = mapped.select(F.col("object_id").alias("id"), F.lit(True).alias("touched"))
    after = (
        objects.join(touched, "id", "left")
        .withColumn("has_current_elements", F.coalesce("touched", "has_current_elements"))
        .select(objects.columns)
    )
    flags = last.select(number).join(known, number, "left")
    created = fresh.agg(F.count("*")).scalar()
    report = flags.agg(
        F.count("*").alias("records"),
        F.count_if("known").alias("matched_objects"),
        F.count_if(F.col("known").isNull()).alias("unmatched_objects"),
    ).withColumn("elements_created", created).withColumn(
        "elements_existing", F.col("matched_objects") - F.col("elements_created")
    )
    return fresh, after, report


def record_counts(provider: str, received: Column, report: dict[str, Column]) -> Column:
    """(received, matched, imported, unmatched) of a sync by provider rule."""
    if provider == "space-track":
        matched, imported, unmatched = report["matched_objects"], report["elements_created"], report["unmatched_objects"]
    elif provider == "satcat":
        matched, imported, unmatched = report["created"] + report["updated"], report["created"], F.lit(0)
    else:
        matched = report["objects_created"] + report["objects_updated"]
        imported, unmatched = report["elements_created"], F.lit(0)
    parts = zip(K.RECORD_RESULTS, (received, matched, imported, unmatched))
    return F.struct(*[value.cast("bigint").alias(name) for name, value in parts])


def new_tags(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidate tags that are not stored yet, each once."""
    once = candidates.dropDuplicates(list(TAG_KEY))
    return once.join(stored.select(*TAG_KEY), list(TAG_KEY), "left_anti")


def type_tags(objects: DataFrame) -> DataFrame:
    return objects.filter("object_type IS NOT NULL").select(
        F.col("id").alias("orbital_object_id"),
        F.lit("object_type").alias("namespace"),
        F.lower("object_type").alias("tag"),
        F.lit("satcat").alias("source"),
    )


def group_rules(spark: SparkSession) -> DataFrame:
    """The fixed rule table, one row per group with its tags (33 rows)."""
    rows = [(group, list(tags)) for group, tags in K.GROUP_TAGS.items()]
    return spark.createDataFrame(rows, "group string, tags array<struct<namespace string, tag string>>")


def group_tags(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Tags of all groups at once. ``records`` has ``group`` and ``NORAD_CAT_ID``;
    a group outside the rule table is left out."""
    ids = (
        records.filter(F.coalesce(F.col("NORAD_CAT_ID"), F.lit("")) != "")
        .select("group", F.col("NORAD_CAT_ID").cast("bigint").alias("norad_cat_id"))
        .distinct()
    )
    known = objects.select("norad_cat_id", F.col("id").alias("orbital_object_id"))
    rules = F.broadcast(group_rules(records.sparkSession))  # 33 rows, fixed
    own = F.struct(F.lit("celestrak_group").alias("namespace"), F.lower("group").alias("tag"))
    return (
        ids.join(rules, "group")
        .join(known, "norad_cat_id")
        .select("orbital_object_id", F.inline(F.array_append("tags", own)))
        .withColumn("source", F.lit("celestrak_group"))
    )


def tagged_objects(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count_distinct("orbital_object_id").alias("tagged_objects"))


def derive_has_elements(objects: DataFrame, elements: DataFrame) -> DataFrame:
    """Sets ``has_current_elements`` for objects that own any element."""
    owners = elements.select(F.col("object_id").alias("id")).distinct().withColumn("owns", F.lit(True))
    return (
        objects.join(owners, "id", "left")
        .withColumn("has_current_elements", F.coalesce("owns", F.lit(False)))
        .select(objects.columns)
    )


def derive_earth_orbit(objects: DataFrame) -> DataFrame:
    return objects.withColumn(
        "is_earth_orbit",
        is_earth_orbit(F.col("decay_date"), F.col("orbit_center"), F.col("orbit_type")),
    )


def derive_chunk_metrics(runs: DataFrame) -> DataFrame:
    """Old runs as one chunk each: chunk = window rounded up to whole steps, and the
    chunk maxima equal the run's own counters."""
    window = (F.unix_micros("window_end") - F.unix_micros("window_start")) / F.lit(1e6)
    steps = F.ceil(window / F.col("step_seconds")) * F.col("step_seconds")
    return runs.withColumns(
        {
            "chunk_seconds": F.greatest(F.col("step_seconds").cast("bigint"), steps.cast("bigint")),
            "max_chunk_raw_candidates": F.col("raw_candidates"),
            "max_chunk_unique_candidates": F.col("unique_candidates"),
            "max_chunk_refinement_attempts": F.col("refinement_attempts"),
        }
    )
