"""Queries: feed mapping, upserts, tags and backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.functions import text as T
from skyframe.operators import catalogue as C
from skyframe.plans.classification import classification_report, classify
from skyframe.sources.tables import read_run_rows, write_run
from skyframe.sources import feeds
from skyframe.session import checkpoint_dir, materialize
from skyframe.workload import views as V
from skyframe.workload.registry import query
from skyframe.workload.views import CONJUNCTIONS, ELEMENTS, OBJECTS, RUNS, with_views

def satcat_records(spark, folder):
    """One catalogue record per order, about half of them for unknown objects."""
    key = F.col("o_orderkey")
    orders = V.table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rank = F.col("o_orderpriority")
    blank = F.lit(None).cast("string")
    return orders.select(
        F.when(key % 7 == 0, "  ").otherwise(F.concat(F.lit(" SAT-"), key.cast("string"), F.lit(" "))).alias("OBJECT_NAME"),
        F.concat(F.lit("D-"), key.cast("string")).alias("OBJECT_ID"),
        (F.col("o_custkey") * 2 + 10000).cast("string").alias("NORAD_CAT_ID"),
        F.when(rank == "1-URGENT", "PAY").when(rank == "2-HIGH", " r/b ").when(rank == "3-MEDIUM", "deb")
        .when(rank == "4-NOT SPECIFIED", "rocket stage").alias("OBJECT_TYPE"),
        F.col("o_orderstatus").alias("OPS_STATUS_CODE"),
        F.when(key % 5 == 0, "").otherwise("US").alias("OWNER"),
        day.alias("LAUNCH_DATE"),
        F.lit(" AFETR").alias("LAUNCH_SITE"),
        F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("T00:00:00")))
        .when(F.col("o_orderstatus") == "P", "n/a").otherwise("").alias("DECAY_DATE"),
        F.when(key % 3 == 0, "bad").otherwise((key % 1000).cast("string")).alias("PERIOD"),
        F.concat(F.lit(" "), (key % 98).cast("string"), F.lit(".5 ")).alias("INCLINATION"),
        (key % 900).cast("string").alias("APOGEE"),
        F.lit("").alias("PERIGEE"),
        blank.alias("RCS"),
        blank.alias("DATA_STATUS_CODE"),
        F.when(key % 10 == 0, "MO").otherwise(" EA").alias("ORBIT_CENTER"),
        F.when(key % 4 == 0, "IMP").otherwise("ORB").alias("ORBIT_TYPE"),
        key.alias("ordinal"),
    )


SATCAT = """satcat AS (
  SELECT o_custkey * 2 + 10000 AS norad_cat_id,
    CASE WHEN o_orderkey % 7 = 0 THEN 'NORAD ' || (o_custkey * 2 + 10000)::VARCHAR ELSE 'SAT-' || o_orderkey::VARCHAR END AS object_name,
    'D-' || o_orderkey::VARCHAR AS object_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'PAYLOAD' WHEN '2-HIGH' THEN 'ROCKET_BODY' WHEN '3-MEDIUM' THEN 'DEBRIS'
      WHEN '4-NOT SPECIFIED' THEN 'ROCKET_STAGE' ELSE 'UNKNOWN' END AS object_type,
    o_orderstatus AS ops_status_code, CASE WHEN o_orderkey % 5 <> 0 THEN 'US' END AS owner,
    o_orderdate::DATE AS launch_date, 'AFETR' AS launch_site,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END AS decay_date,
    CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 1000)::DOUBLE END AS period_minutes,
    (o_orderkey % 98) + 0.5::DOUBLE AS inclination_deg, (o_orderkey % 900)::DOUBLE AS apogee_km,
    NULL::DOUBLE AS perigee_km, NULL::DOUBLE AS rcs_m2, NULL::VARCHAR AS data_status_code,
    CASE WHEN o_orderkey % 10 = 0 THEN 'MO' ELSE 'EA' END AS orbit_center,
    CASE WHEN o_orderkey % 4 = 0 THEN 'IMP' ELSE 'ORB' END AS orbit_type,
    o_orderstatus <> 'F' AS is_on_orbit,
    o_orderstatus <> 'F' AND o_orderkey % 10 <> 0 AND o_orderkey % 4 <> 0 AS is_earth_orbit,
    'celestrak' AS source, o_orderkey AS ordinal
  FROM orders
), satcat_last AS (
  SELECT * EXCLUDE (n, ordinal) FROM (
    SELECT *, row_number() OVER (PARTITION BY norad_cat_id ORDER BY ordinal DESC) AS n FROM satcat) WHERE n = 1
)"""
FIELDS = ", ".join(C.CATALOGUE_FIELDS)


@query(with_views(SATCAT) + f"SELECT norad_cat_id, {FIELDS}, ordinal FROM satcat")
def satcat_normalise(spark, folder):
    return C.satcat_objects(satcat_records(spark, folder))


@query(
    with_views(OBJECTS, SATCAT)
    + "SELECT coalesce(o.id, n.norad_cat_id) AS id, coalesce(o.norad_cat_id, n.norad_cat_id) AS norad_cat_id, "
    + ", ".join(
        f"CASE WHEN n.norad_cat_id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in C.CATALOGUE_FIELDS
    )
    + """, o.country_code, coalesce(o.has_current_elements, false) AS has_current_elements
    FROM objects o FULL JOIN satcat_last n ON n.norad_cat_id = o.norad_cat_id"""
)
def satcat_upsert(spark, folder):
    return C.upsert_satcat(V.objects(spark, folder), C.satcat_objects(satcat_records(spark, folder)))


@query(
    with_views(OBJECTS, SATCAT)
    + """SELECT count(*) AS records, count(*) FILTER (o.id IS NULL) AS created,
      count(*) FILTER (o.id IS NOT NULL) AS updated,
      count(*) FILTER (n.object_type = 'PAYLOAD') AS payloads,
      count(*) FILTER (n.object_type = 'ROCKET_BODY') AS rocket_bodies,
      count(*) FILTER (n.object_type = 'DEBRIS') AS debris, count(*) FILTER (n.object_type = 'UNKNOWN') AS unknown,
      count(*) FILTER (n.object_type NOT IN ('PAYLOAD', 'ROCKET_BODY', 'DEBRIS', 'UNKNOWN')) AS other,
      count(*) FILTER (n.is_on_orbit) AS on_orbit, count(*) FILTER (NOT n.is_on_orbit) AS decayed
    FROM satcat_last n LEFT JOIN objects o ON o.norad_cat_id = n.norad_cat_id"""
)
def satcat_report(spark, folder):
    return C.satcat_report(V.objects(spark, folder), C.satcat_objects(satcat_records(spark, folder)))


def gp_records(spark, folder):
    """One element-set record per order; the lower numbers are unknown objects."""
    key = F.col("o_orderkey")
    orders = V.table(spark, folder, "orders")
    c = F.floor(F.col("o_custkey") / 2)
    blank = F.lit(None).cast("string")
    text = {
        "NORAD_CAT_ID": (F.col("o_custkey") + 9000),
        "INCLINATION": 30.0 + c % 70,
        "RA_OF_ASC_NODE": (c % 360).cast("double"),
        "ECCENTRICITY": (c % 100) / 10000.0,
        "ARG_OF_PERICENTER": (key % 360).cast("double"),
        "MEAN_ANOMALY": (key % 359).cast("double"),
        "MEAN_MOTION": 12.0 + c % 4,
        "ELEMENT_SET_NO": key % 1000,
        "REV_AT_EPOCH": key % 50000,
    }
    stamp = F.date_format(F.timestamp_micros(V.epoch_us()), "yyyy-MM-dd'T'HH:mm:ss")
    return orders.select(
        *[value.cast("string").alias(name) for name, value in text.items()],
        F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("GP-"), key.cast("string"))).alias("OBJECT_NAME"),
        F.when(key % 2 == 0, F.concat(F.lit("X-"), key.cast("string"))).alias("OBJECT_ID"),
        F.when(key % 3 == 0, "pay").when(key % 3 == 1, "").alias("OBJECT_TYPE"),
        F.when(key % 5 == 0, "FR").alias("COUNTRY_CODE"),
        F.when(key % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("LAUNCH_DATE"),
        F.lit("").alias("DECAY_DATE"),
        F.when(key % 2 == 0, F.concat(stamp, F.lit("Z"))).otherwise(stamp).alias("EPOCH"),
        blank.alias("MEAN_MOTION_DOT"),
        F.lit("").alias("MEAN_MOTION_DDOT"),
        F.when(key % 2 == 1, "0.00025").alias("BSTAR"),
        F.lit("0").alias("EPHEMERIS_TYPE"),
        F.lit("U").alias("CLASSIFICATION_TYPE"),
        key.alias("ordinal"),
    )


GP = """gp AS (
  SELECT o_custkey + 9000 AS norad_cat_id,
    CASE WHEN o_orderkey % 6 = 0 THEN 'NORAD ' || (o_custkey + 9000)::VARCHAR ELSE 'GP-' || o_orderkey::VARCHAR END AS object_name,
    CASE WHEN o_orderkey % 2 = 0 THEN 'X-' || o_orderkey::VARCHAR END AS object_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'PAYLOAD' END AS object_type,
    CASE WHEN o_orderkey % 5 = 0 THEN 'FR' END AS country_code,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE END AS launch_date, NULL::DATE AS decay_date,
    'celestrak' AS source, o_orderkey AS ordinal,
    TIMESTAMP '2026-01-01 00:00:00' + to_minutes(5 * date_diff('day', DATE '1995-01-01', o_orderdate::DATE)) AS epoch,
    30.0::DOUBLE + (o_custkey // 2) % 70 AS inclination, ((o_custkey // 2) % 360)::DOUBLE AS ra_of_asc_node,
    ((o_custkey // 2) % 100) / 10000.0::DOUBLE AS eccentricity, (o_orderkey % 360)::DOUBLE AS arg_of_pericenter,
    (o_orderkey % 359)::DOUBLE AS mean_anomaly, 12.0::DOUBLE + (o_custkey // 2) % 4 AS mean_motion,
    (o_orderkey % 1000)::INTEGER AS element_set_no, (o_orderkey % 50000)::INTEGER AS rev_at_epoch,
    CASE WHEN o_orderkey % 2 = 1 THEN 0.00025::DOUBLE END AS bstar
  FROM orders
)"""
GP_FIELDS = ", ".join(C.GP_FIELDS)


@query(with_views(GP) + f"SELECT norad_cat_id, {GP_FIELDS}, ordinal FROM gp")
def gp_mapping(spark, folder):
    return C.gp_objects(gp_records(spark, folder))


@query(
    with_views(GP)
    + """SELECT ordinal, epoch, 'U' AS classification, norad_cat_id AS number,
      CASE WHEN ordinal % 2 = 1 THEN 0.00025::DOUBLE END AS bstar, CASE WHEN ordinal % 6 = 0 THEN '' ELSE 'GP-' || ordinal::VARCHAR END AS name
    FROM (SELECT ordinal, epoch_us(epoch) AS epoch, norad_cat_id FROM gp)"""
)
def raw_fields(spark, folder):
    """Element sets stored with their raw record as a variant; fields of it read afterwards,
    some of which no column was made of at ingest."""
    raw = C.with_raw_variant(gp_records(spark, folder)).select("ordinal", "raw")
    stored = materialize(raw, "raw_records")
    return stored.select(
        "ordinal",
        F.unix_micros(C.raw_field("EPOCH", "timestamp")).alias("epoch"),
        C.raw_field("CLASSIFICATION_TYPE").alias("classification"),
        C.raw_field("NORAD_CAT_ID", "bigint").alias("number"),
        C.raw_field("BSTAR", "double").alias("bstar"),
        C.raw_field("OBJECT_NAME").alias("name"),
    )


ELEMENT_NUMBERS = (
    "inclination", "ra_of_asc_node", "eccentricity", "arg_of_pericenter", "mean_anomaly", "mean_motion", "bstar",
    "element_set_no", "rev_at_epoch",
)


@query(
    with_views(GP)
    + "SELECT norad_cat_id, 'celestrak' AS source, epoch_us(epoch) AS epoch_us, "
    + ", ".join(ELEMENT_NUMBERS)
    + ", 0 AS ephemeris_type FROM gp"
)
def element_mapping(spark, folder):
    rows = C.gp_elements(gp_records(spark, folder)).withColumn("epoch_us", F.unix_micros("epoch"))
    return rows.select("norad_cat_id", "source", "epoch_us", *ELEMENT_NUMBERS, "ephemeris_type")


GP_LAST = """gp_last AS (SELECT norad_cat_id, max_by(object_name, ordinal) AS object_name,
  max_by(object_id, ordinal) FILTER (object_id IS NOT NULL) AS object_id,
  max_by(object_type, ordinal) FILTER (object_type IS NOT NULL) AS object_type,
  max_by(country_code, ordinal) FILTER (country_code IS NOT NULL) AS country_code,
  max_by(launch_date, ordinal) FILTER (launch_date IS NOT NULL) AS launch_date,
  NULL::DATE AS decay_date, 'celestrak' AS source FROM gp GROUP BY norad_cat_id)"""
KEPT = [c for c in C.OBJECT_TYPES if c not in (*C.GP_FIELDS, "has_current_elements", "is_on_orbit", "is_earth_orbit")]


@query(
    with_views(OBJECTS, GP, GP_LAST)
    + "SELECT coalesce(o.id, n.norad_cat_id) AS id, coalesce(o.norad_cat_id, n.norad_cat_id) AS norad_cat_id, "
    + ", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in C.GP_FIELDS)
    + ", " + ", ".join(f"o.{c}" for c in KEPT)
    + """, n.norad_cat_id IS NOT NULL OR o.has_current_elements AS has_current_elements,
      n.norad_cat_id IS NOT NULL OR o.is_on_orbit AS is_on_orbit, coalesce(o.is_earth_orbit, false) AS is_earth_orbit
    FROM objects o FULL JOIN gp_last n ON n.norad_cat_id = o.norad_cat_id"""
)
def gp_upsert(spark, folder):
    return C.upsert_gp(V.objects(spark, folder), C.gp_objects(gp_records(spark, folder)))


@query(
    with_views(OBJECTS, GP)
    + """SELECT count(*) AS records, count(DISTINCT g.norad_cat_id) FILTER (o.id IS NULL) AS objects_created,
      count(*) - count(DISTINCT g.norad_cat_id) FILTER (o.id IS NULL) AS objects_updated
    FROM gp g LEFT JOIN objects o ON o.norad_cat_id = g.norad_cat_id"""
)
def gp_report(spark, folder):
    return C.gp_report(V.objects(spark, folder), C.gp_objects(gp_records(spark, folder)))


@query(
    with_views(OBJECTS, ELEMENTS, GP)
    + """SELECT object_id, source, epoch_us(epoch) AS epoch_us, element_set_no, mean_anomaly FROM (
      SELECT o.id AS object_id, 'celestrak' AS source, g.epoch, g.element_set_no, g.mean_anomaly,
        row_number() OVER (PARTITION BY o.id, g.epoch ORDER BY g.ordinal) AS n
      FROM gp g JOIN objects o ON o.norad_cat_id = g.norad_cat_id) b
    WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM elements e
      WHERE e.object_id = b.object_id AND e.source = b.source AND e.epoch = b.epoch)"""
)
def element_insert(spark, folder):
    batch, _ = C.attach_objects(C.gp_elements(gp_records(spark, folder)), V.objects(spark, folder))
    fresh = C.new_elements(batch, V.elements(spark, folder))
    return fresh.select(
        "object_id", "source", F.unix_micros("epoch").alias("epoch_us"), "element_set_no", "mean_anomaly"
    )


PROVIDER = """last_gp AS (SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY norad_cat_id ORDER BY ordinal DESC) AS n FROM gp) WHERE n = 1),
matched AS (SELECT g.*, o.id AS matched_id FROM last_gp g LEFT JOIN objects o ON o.norad_cat_id = g.norad_cat_id),
fresh AS (SELECT * FROM matched m WHERE matched_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM elements e
  WHERE e.object_id = m.matched_id AND e.source = 'space-track' AND e.epoch = m.epoch))"""


@query(
    with_views(OBJECTS, ELEMENTS, GP, PROVIDER)
    + """SELECT count(*) AS records, count(matched_id) AS matched_objects,
      count(*) - count(matched_id) AS unmatched_objects, (SELECT count(*) FROM fresh) AS elements_created,
      count(matched_id) - (SELECT count(*) FROM fresh) AS elements_existing FROM matched"""
)
def provider_sync(spark, folder):
    _, _, report = C.provider_sync(gp_records(spark, folder), V.objects(spark, folder), V.elements(spark, folder))
    return report


@query(
    with_views(OBJECTS, ELEMENTS, GP, PROVIDER)
    + "SELECT matched_id AS object_id, epoch_us(epoch) AS epoch_us, mean_motion FROM fresh"
)
def provider_elements(spark, folder):
    fresh, _, _ = C.provider_sync(gp_records(spark, folder), V.objects(spark, folder), V.elements(spark, folder))
    return fresh.select("object_id", F.unix_micros("epoch").alias("epoch_us"), "mean_motion")


@query(
    with_views(OBJECTS, ELEMENTS, GP, PROVIDER)
    + """SELECT o.id, o.has_current_elements OR m.matched_id IS NOT NULL AS has_current_elements
    FROM objects o LEFT JOIN matched m ON m.matched_id = o.id"""
)
def provider_flags(spark, folder):
    _, after, _ = C.provider_sync(gp_records(spark, folder), V.objects(spark, folder), V.elements(spark, folder))
    return after.select("id", "has_current_elements")


@query(
    with_views(OBJECTS, ELEMENTS, GP, PROVIDER)
    + """SELECT unnest(['received', 'matched', 'imported', 'unmatched']) AS result,
      unnest([(SELECT count(*) FROM gp), (SELECT count(matched_id) FROM matched), (SELECT count(*) FROM fresh),
        (SELECT count(*) - count(matched_id) FROM matched)]) AS records"""
)
def ingestion_records(spark, folder):
    records = gp_records(spark, folder)
    _, _, report = C.provider_sync(records, V.objects(spark, folder), V.elements(spark, folder))
    received = records.agg(F.count("*")).scalar()
    counts = C.record_counts("space-track", received, {c: F.col(c) for c in report.columns})
    return report.select(counts.alias("c")).select("c.*").unpivot([], list(K.RECORD_RESULTS), "result", "records")


GROUP_LIST = list(K.GROUP_TAGS)


def group_records(spark, folder):
    """Each order puts its object into one group of the rule table, or into none."""
    names = F.array(*[F.lit(g) for g in (*GROUP_LIST, "UNLISTED")])
    return gp_records(spark, folder).withColumn(
        "group", F.element_at(names, (F.col("ordinal") % (len(GROUP_LIST) + 1) + 1).cast("int"))
    )


RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{group}', '{namespace}', '{tag}')"
    for group, tags in K.GROUP_TAGS.items()
    for namespace, tag in (*tags, ("celestrak_group", group.lower()))
) + ") r(grp, namespace, tag))"
GROUPED = f"""grouped AS (SELECT *, [{', '.join(f"'{g}'" for g in (*GROUP_LIST, 'UNLISTED'))}][ordinal % {len(GROUP_LIST) + 1} + 1] AS grp FROM gp)"""
STORED_TAGS = "stored AS (SELECT id AS orbital_object_id, 'object_type' AS namespace, lower(object_type) AS tag FROM objects WHERE object_type IS NOT NULL)"


@query(
    with_views(OBJECTS)
    + """SELECT id AS orbital_object_id, 'object_type' AS namespace, lower(object_type) AS tag, 'satcat' AS source
      FROM objects WHERE object_type IS NOT NULL"""
)
def type_tags(spark, folder):
    tags = C.type_tags(V.objects(spark, folder))
    return C.new_tags(tags, tags.limit(0))


@query(
    with_views(OBJECTS, GP, GROUPED, RULES)
    + """SELECT DISTINCT o.id AS orbital_object_id, r.namespace, r.tag, 'celestrak_group' AS source
    FROM grouped g JOIN rules r ON r.grp = g.grp JOIN objects o ON o.norad_cat_id = g.norad_cat_id"""
)
def group_tags(spark, folder):
    tags = C.group_tags(group_records(spark, folder), V.objects(spark, folder))
    return C.new_tags(tags, tags.limit(0))


def _classified(spark, folder):
    stored = C.type_tags(V.objects(spark, folder))
    return classify(group_records(spark, folder), V.objects(spark, folder), V.elements(spark, folder), stored)


@query(
    with_views(OBJECTS, GP, GROUPED, RULES)
    + """SELECT DISTINCT g.norad_cat_id AS orbital_object_id, r.namespace, r.tag, 'celestrak_group' AS source
    FROM grouped g JOIN rules r ON r.grp = g.grp"""
)
def classification_tags(spark, folder):
    """Type tags are stored already, so only group tags are new."""
    return _classified(spark, folder)[2]


@query(
    with_views(OBJECTS, GP, GROUPED, RULES)
    + """, tagged AS (SELECT DISTINCT g.norad_cat_id AS id FROM grouped g JOIN rules r ON r.grp = g.grp)
    SELECT count(DISTINCT id) AS tagged_objects,
      (SELECT count(*) FROM (SELECT id FROM tagged UNION SELECT id FROM objects WHERE has_current_elements)) AS objects_with_elements
    FROM (SELECT id FROM tagged UNION SELECT id FROM objects WHERE object_type IS NOT NULL)"""
)
def tagged_count(spark, folder):
    after, _, fresh, _ = _classified(spark, folder)
    tags = C.type_tags(V.objects(spark, folder)).unionByName(fresh)
    return classification_report(after, tags)


@query(
    with_views(OBJECTS, ELEMENTS)
    + """SELECT id, id IN (SELECT object_id FROM elements) AS has_current_elements,
      decay_date IS NULL AND orbit_center = 'EA' AND orbit_type = 'ORB' AS is_earth_orbit FROM objects"""
)
def backfill_flags(spark, folder):
    objects = C.derive_has_elements(V.objects(spark, folder), V.elements(spark, folder))
    return C.derive_earth_orbit(objects).select("id", "has_current_elements", "is_earth_orbit")


@query(
    with_views(CONJUNCTIONS, RUNS)
    + """SELECT run_id, greatest(60, (ceil((epoch_us(window_end) - epoch_us(window_start)) / 1000000.0 / 60) * 60)::BIGINT) AS chunk_seconds,
      raw_candidates AS max_chunk_raw_candidates, unique_candidates AS max_chunk_unique_candidates,
      refinement_attempts AS max_chunk_refinement_attempts FROM runs"""
)
def backfill_chunks(spark, folder):
    return C.derive_chunk_metrics(V.runs(spark, folder)).select(
        "run_id", "chunk_seconds", "max_chunk_raw_candidates", "max_chunk_unique_candidates",
        "max_chunk_refinement_attempts",
    )


def _landing(spark, folder: str, name: str) -> str:
    """A folder for this job's own files beside the checkpoints, on shared storage."""
    tables = folder.strip("/").replace("/", "_")
    return f"{checkpoint_dir(spark)}/landed_{spark.sparkContext.applicationId}/{tables}/{name}"


@query(with_views(SATCAT) + f"SELECT norad_cat_id, {FIELDS} FROM satcat_last")
def satcat_feed_read(spark, folder):
    """The catalogue batch written as CSV and read back as a landed feed."""
    path = _landing(spark, folder, "satcat")
    records = satcat_records(spark, folder)
    # Ranges in file order keep the order of records without one task writing all.
    ranged = records.repartitionByRange("ordinal").sortWithinPartitions("ordinal").drop("ordinal")
    ranged.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return C.last_per_key(C.satcat_objects(feeds.read_satcat_csv(spark, path)))


@query(
    with_views(GP)
    + """SELECT norad_cat_id, epoch_us(epoch) AS epoch_us, inclination, mean_motion, bstar FROM gp
      WHERE epoch > TIMESTAMP '2026-01-14 08:00:00' - INTERVAL 10 DAY"""
)
def gp_feed_read(spark, folder):
    """Element sets written as JSON arrays and read back, current ones only."""
    path = _landing(spark, folder, "gp")
    gp_records(spark, folder).drop("ordinal").write.mode("overwrite").json(path)
    landed = feeds.with_file_order(spark.read.schema(feeds.OMM_SCHEMA).json(path)).drop("_corrupt_record")
    now = F.timestamp_micros(F.lit(V.NOW_US + 5 * 86_400_000_000))
    rows = C.gp_elements(feeds.current_gp(landed, now))
    return rows.select("norad_cat_id", F.unix_micros("epoch").alias("epoch_us"), "inclination", "mean_motion", "bstar")


@query(
    with_views(CONJUNCTIONS, RUNS)
    + """SELECT event_id, run_id, epoch_us(tca) AS tca_us, miss_distance_km FROM conjunctions
      WHERE run_id IN (SELECT run_id FROM runs)"""
)
def run_roundtrip(spark, folder):
    """Events and run headers written, then read back through the commit mark."""
    path = _landing(spark, folder, "runs")
    write_run(V.conjunctions(spark, folder), V.runs(spark, folder), path, "events", "runs")
    rows = read_run_rows(spark, path, "events", "runs")
    return rows.select(
        "event_id", F.col("run_id").cast("bigint").alias("run_id"), F.unix_micros("tca").alias("tca_us"), "miss_distance_km"
    )


@query(
    """SELECT s_suppkey, upper(trim(' ' || replace(s_name, '#', '-') || ' ')) AS group_name FROM supplier"""
)
def feed_groups(spark, folder):
    suppliers = V.table(spark, folder, "supplier")
    raw = F.concat(F.lit(" "), F.replace(F.col("s_name"), F.lit("#"), F.lit("-")), F.lit(" "))
    return suppliers.select("s_suppkey", T.group_name(raw).alias("group_name"))
