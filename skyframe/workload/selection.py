"""Queries: element selection, quality, coverage and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.operators import coverage as C
from skyframe.operators import lookup as L
from skyframe.operators import selection as S
from skyframe.session import materialize
from skyframe.workload import views as V
from skyframe.workload.registry import query
from skyframe.workload.views import CONJUNCTIONS, ELEMENTS, NOW_SQL, OBJECTS, RUNS, with_views

CHOSEN = ("object_id", "element_id", "source", "epoch_us")

LATEST_SQL = """
SELECT object_id, element_id, source, epoch_us(epoch) AS epoch_us FROM (
  SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY epoch DESC, element_id DESC) AS n
  FROM elements WHERE source = 'celestrak') WHERE n = 1"""

CANONICAL = """canonical AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.object_id ORDER BY epoch DESC,
      CASE e.source WHEN 'space-track' THEN 0 WHEN 'celestrak' THEN 1 ELSE 9 END, element_id DESC) AS n
    FROM elements e JOIN objects o ON o.id = e.object_id WHERE o.is_earth_orbit) WHERE n = 1
)"""

STATUS = f"""CASE WHEN epoch >= {NOW_SQL} - INTERVAL 12 HOUR THEN 'fresh'
    WHEN epoch >= {NOW_SQL} - INTERVAL 24 HOUR THEN 'aging'
    WHEN epoch >= {NOW_SQL} - INTERVAL 72 HOUR THEN 'stale' ELSE 'expired' END"""

JUDGED = f"""judged AS (
  SELECT c.*, o.object_type, {STATUS} AS status, epoch >= {NOW_SQL} - INTERVAL 72 HOUR AS eligible
  FROM canonical c JOIN objects o ON o.id = c.object_id
)"""


def _epoch_us(df):
    return df.withColumn("epoch_us", F.unix_micros("epoch"))


def judged(spark, folder):
    return S.judge_canonical(V.elements(spark, folder), V.objects(spark, folder), V.now())


@query(with_views(ELEMENTS) + LATEST_SQL)
def latest_by_source(spark, folder):
    return _epoch_us(S.latest_by_source(V.elements(spark, folder), "celestrak")).select(*CHOSEN)


@query(
    with_views(OBJECTS, ELEMENTS, CANONICAL)
    + "SELECT object_id, element_id, source, epoch_us(epoch) AS epoch_us FROM canonical"
)
def canonical_latest(spark, folder):
    best = S.canonical_latest(V.elements(spark, folder), V.objects(spark, folder))
    return _epoch_us(best).select(*CHOSEN)


@query(
    with_views(ELEMENTS)
    + f"""SELECT element_id, epoch_us({NOW_SQL}) / 1e6 - epoch_us(epoch) / 1e6 AS age_seconds,
      round((epoch_us({NOW_SQL}) - epoch_us(epoch)) / 3600e6, 6) AS age_hours, {STATUS} AS status,
      epoch >= {NOW_SQL} - INTERVAL 72 HOUR AS allowed FROM elements"""
)
def ephemeris_quality(spark, folder):
    rows = S.with_quality(V.elements(spark, folder), V.now())
    return rows.select(
        "element_id", "age_seconds", F.round("age_hours", 6).alias("age_hours"), "status", "allowed"
    )


@query(
    with_views(OBJECTS, ELEMENTS, CANONICAL, JUDGED)
    + """SELECT 'status' AS dimension, status AS value, count(*) AS objects FROM judged GROUP BY status
    UNION ALL SELECT 'source', source, count(*) FROM judged GROUP BY source
    UNION ALL SELECT 'eligible_source', source, count(*) FROM judged WHERE eligible GROUP BY source
    UNION ALL SELECT 'eligible_object_type', coalesce(object_type, 'UNKNOWN'), count(*)
      FROM judged WHERE eligible GROUP BY 2"""
)
def selection_counts(spark, folder):
    return S.selection_counts(judged(spark, folder))


@query(
    with_views(OBJECTS, ELEMENTS, CANONICAL, JUDGED)
    + """SELECT count(*) AS canonical_total, count(*) FILTER (eligible) AS eligible_total,
      count(*) FILTER (NOT eligible) AS expired_total FROM judged"""
)
def selection_totals(spark, folder):
    return S.selection_totals(judged(spark, folder))


@query(
    with_views(OBJECTS, ELEMENTS, CANONICAL, JUDGED)
    + """SELECT coalesce(object_type, 'UNKNOWN') AS object_type, count(*) AS canonical,
      count(*) FILTER (eligible) AS eligible,
      round(count(*) FILTER (eligible) * 100.0::DOUBLE / count(*), 6) AS eligible_percent
      FROM judged GROUP BY 1 ORDER BY eligible DESC, 1"""
)
def eligibility_report(spark, folder):
    report = S.eligibility_report(judged(spark, folder))
    return report.withColumn("eligible_percent", F.round("eligible_percent", 6))


@query(
    with_views(OBJECTS)
    + """SELECT count(*) AS total_objects, count(*) FILTER (is_earth_orbit) AS earth_orbit_objects,
      count(*) FILTER (has_current_elements) AS objects_with_elements,
      count(*) FILTER (is_earth_orbit AND has_current_elements) AS earth_orbit_with_elements FROM objects"""
)
def object_coverage(spark, folder):
    return C.object_coverage(V.objects(spark, folder))


NEWEST = "newest AS (SELECT object_id, max(epoch) AS epoch FROM elements GROUP BY object_id)"


@query(
    with_views(OBJECTS, ELEMENTS, NEWEST)
    + f""", rows AS (SELECT o.*, n.epoch, n.object_id IS NOT NULL AS tracked, {STATUS} AS status
        FROM objects o FULL JOIN newest n ON n.object_id = o.id),
    c AS (SELECT count(id) AS catalog_total_objects, count(*) FILTER (is_earth_orbit) AS earth_orbit_objects,
      count(*) FILTER (has_current_elements) AS objects_with_current_elements,
      count(*) FILTER (tracked) AS canonical_elements_total,
      count(*) FILTER (is_earth_orbit AND tracked AND status <> 'expired') AS screening_eligible_objects,
      count(*) FILTER (is_earth_orbit AND tracked AND status = 'fresh') AS ephemeris_objects_fresh,
      count(*) FILTER (is_earth_orbit AND tracked AND status = 'aging') AS ephemeris_objects_aging,
      count(*) FILTER (is_earth_orbit AND tracked AND status = 'stale') AS ephemeris_objects_stale,
      count(*) FILTER (is_earth_orbit AND tracked AND status = 'expired') AS ephemeris_objects_expired
      FROM rows)
    SELECT metric, value FROM (UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE value)"""
)
def coverage_metrics(spark, folder):
    return C.coverage_metrics(V.elements(spark, folder), V.objects(spark, folder), V.now())


STATUS_LIST = "(VALUES ('fresh'), ('aging'), ('stale'), ('expired')) s(status)"


@query(
    with_views(OBJECTS, ELEMENTS, NEWEST)
    + f"""SELECT s.status, count(r.status) AS objects FROM {STATUS_LIST} LEFT JOIN (
        SELECT {STATUS} AS status FROM newest n JOIN objects o ON o.id = n.object_id WHERE is_earth_orbit
      ) r ON r.status = s.status GROUP BY s.status"""
)
def status_histogram(spark, folder):
    return C.status_histogram(V.elements(spark, folder), V.objects(spark, folder), V.now())


@query(
    with_views(OBJECTS)
    + """SELECT k.kind, count(o.kind) AS objects
    FROM (VALUES ('PAYLOAD'), ('DEBRIS'), ('ROCKET_BODY'), ('UNKNOWN')) k(kind) LEFT JOIN (
      SELECT CASE WHEN t IN ('PAYLOAD', 'DEBRIS', 'ROCKET_BODY') THEN t ELSE 'UNKNOWN' END AS kind FROM (
        SELECT replace(replace(upper(trim(coalesce(object_type, 'UNKNOWN'))), ' ', '_'), '-', '_') AS t
        FROM objects)) o ON o.kind = k.kind GROUP BY k.kind"""
)
def kind_legend(spark, folder):
    return C.kind_legend(V.objects(spark, folder))


@query(
    with_views(ELEMENTS)
    + "SELECT count(DISTINCT object_id) AS objects FROM elements WHERE source = 'space-track'"
)
def objects_with_source(spark, folder):
    return C.objects_with_source(V.elements(spark, folder), "space-track")


@query(
    with_views(CONJUNCTIONS, RUNS)
    + """SELECT run_id, source, epoch_us(completed_at) AS completed_us, event_count
      FROM runs ORDER BY run_id DESC LIMIT 1"""
)
def latest_run(spark, folder):
    return _run_columns(L.latest_run(V.runs(spark, folder)))


def _run_columns(runs):
    return runs.select("run_id", "source", F.unix_micros("completed_at").alias("completed_us"), "event_count")


@query(
    with_views(CONJUNCTIONS, RUNS)
    + """SELECT run_id, source, epoch_us(completed_at) AS completed_us, event_count FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY completed_at DESC, run_id DESC) AS n
      FROM runs) WHERE n = 1"""
)
def latest_run_per_source(spark, folder):
    return _run_columns(L.latest_run_per_source(V.runs(spark, folder)))


EVENT_FACTS = """SELECT c.event_id, c.run_id, c.primary_object_id, c.secondary_object_id,
  epoch_us(c.tca) AS tca_us, c.miss_distance_km, p.norad_cat_id AS primary_norad_cat_id,
  p.object_name AS primary_object_name, p.object_type AS primary_object_type,
  s.norad_cat_id AS secondary_norad_cat_id, s.object_name AS secondary_object_name,
  s.object_type AS secondary_object_type
FROM conjunctions c JOIN objects p ON p.id = c.primary_object_id
  JOIN objects s ON s.id = c.secondary_object_id"""


def _event_columns(events):
    names = [f"{side}_{c}" for side in ("primary", "secondary") for c in ("norad_cat_id", "object_name", "object_type")]
    return events.select(
        "event_id", "run_id", "primary_object_id", "secondary_object_id",
        F.unix_micros("tca").alias("tca_us"), "miss_distance_km", *names,
    )


@query(with_views(OBJECTS, CONJUNCTIONS) + EVENT_FACTS)
def events_with_objects(spark, folder):
    return _event_columns(L.events_with_objects(V.conjunctions(spark, folder), V.objects(spark, folder)))


@query(
    with_views(OBJECTS, CONJUNCTIONS)
    + EVENT_FACTS
    + " WHERE c.run_id = 40 ORDER BY c.miss_distance_km, c.tca, c.event_id LIMIT 100"
)
def closest_events(spark, folder):
    return _event_columns(L.closest_events(V.conjunctions(spark, folder), V.objects(spark, folder), 40))


@query(
    with_views(CONJUNCTIONS)
    + f"""SELECT event_id, run_id, epoch_us(tca) AS tca_us FROM conjunctions
      WHERE tca >= {NOW_SQL} ORDER BY tca, event_id"""
)
def upcoming_events(spark, folder):
    events = L.upcoming_events(V.conjunctions(spark, folder), V.now())
    return events.select("event_id", "run_id", F.unix_micros("tca").alias("tca_us"))


@query(
    with_views(CONJUNCTIONS)
    + """SELECT run_id, event_id, rank FROM (
      SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY tca, event_id)::INTEGER AS rank
      FROM conjunctions WHERE tca >= TIMESTAMP '2026-01-03 00:00:00') WHERE rank <= 5"""
)
def priority_events_per_run(spark, folder):
    since = F.timestamp_micros(F.lit(V.EPOCH_BASE_US + 2 * 86_400_000_000))
    ranked = L.priority_events_per_run(V.conjunctions(spark, folder), since)
    return ranked.select("run_id", "event_id", "rank")


@query(
    with_views(CONJUNCTIONS)
    + f"""SELECT event_id, epoch_us(tca) AS tca_us FROM conjunctions
      WHERE tca >= {NOW_SQL} ORDER BY tca, event_id LIMIT 5"""
)
def priority_events(spark, folder):
    events = L.priority_events(V.conjunctions(spark, folder), V.now())
    return events.select("event_id", F.unix_micros("tca").alias("tca_us"))


@query(
    with_views(CONJUNCTIONS, RUNS)
    + f"""SELECT coalesce((SELECT window_end IS NULL OR window_end < {NOW_SQL}
      FROM runs ORDER BY run_id DESC LIMIT 1), false) AS screening_is_stale"""
)
def screening_is_stale(spark, folder):
    return L.screening_is_stale(V.runs(spark, folder), V.now())


GROUNDED = """grounded AS (
  SELECT c.*, r.run_id AS run_found, r.source AS run_source, r.window_start, r.window_end,
    p.norad_cat_id AS primary_norad, s.norad_cat_id AS secondary_norad,
    pe.object_id AS primary_owner, se.object_id AS secondary_owner,
    p.object_type AS primary_object_type, s.object_type AS secondary_object_type,
    pe.source AS primary_element_source, se.source AS secondary_element_source
  FROM conjunctions c LEFT JOIN runs r ON r.run_id = c.run_id
  LEFT JOIN objects p ON p.id = c.primary_object_id LEFT JOIN objects s ON s.id = c.secondary_object_id
  LEFT JOIN elements pe ON pe.element_id = c.primary_element_id
  LEFT JOIN elements se ON se.element_id = c.secondary_element_id
)"""
GROUNDING_PROBLEM = """CASE
  WHEN run_found IS NULL OR primary_norad IS NULL OR secondary_norad IS NULL
    OR primary_owner IS NULL OR secondary_owner IS NULL THEN 'incomplete'
  WHEN run_source <> 'canonical' THEN 'run'
  WHEN primary_object_id = secondary_object_id THEN 'pair'
  WHEN primary_owner <> primary_object_id OR secondary_owner <> secondary_object_id THEN 'provenance'
  WHEN NOT tca BETWEEN window_start AND window_end THEN 'outside_window' END"""


def grounded(spark, folder):
    return L.grounded_events(
        V.conjunctions(spark, folder), V.runs(spark, folder), V.objects(spark, folder), V.elements(spark, folder)
    )


@query(
    with_views(OBJECTS, ELEMENTS, CONJUNCTIONS, RUNS, GROUNDED)
    + f"""SELECT event_id, {GROUNDING_PROBLEM} AS problem, run_source, primary_norad AS primary_norad_cat_id,
      secondary_norad AS secondary_norad_cat_id, primary_element_source, secondary_element_source FROM grounded"""
)
def grounding(spark, folder):
    return grounded(spark, folder).select(
        "event_id", "problem", "run_source", "primary_norad_cat_id", "secondary_norad_cat_id",
        "primary_element_source", "secondary_element_source",
    )


@query(
    with_views(OBJECTS)
    + """, q AS (SELECT p_partkey AS query_id,
        upper(trim(CASE WHEN p_size % 3 = 0 THEN (p_partkey + 10000)::VARCHAR
          WHEN p_size % 3 = 1 THEN 'omer#00000' || p_partkey::VARCHAR
          ELSE right(p_partkey::VARCHAR, 3) END)) AS query FROM part),
    hits AS (SELECT query_id, query, id, norad_cat_id, object_name,
        CASE WHEN norad_cat_id::VARCHAR = query THEN 0
          WHEN starts_with(upper(object_name), query) OR starts_with(norad_cat_id::VARCHAR, query) THEN 1
          WHEN contains(upper(object_name), query) THEN 2 END AS rank
      FROM q, objects WHERE length(query) >= 2
        AND (contains(upper(object_name), query) OR starts_with(norad_cat_id::VARCHAR, query)))
    SELECT query_id, query, place, rank, id, norad_cat_id, object_name FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id)::INTEGER AS place
      FROM hits WHERE rank IS NOT NULL) WHERE place <= 12"""
)
def catalog_search(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    queries = V.table(spark, folder, "part").select(
        key.alias("query_id"),
        F.when(size % 3 == 0, (key + 10000).cast("string"))
        .when(size % 3 == 1, F.concat(F.lit("omer#00000"), key.cast("string")))
        .otherwise(F.right(key.cast("string"), F.lit(3)))
        .alias("text"),
    )
    objects = V.objects(spark, folder).withColumn("ordinal", F.col("id"))
    return L.search_many(objects, queries)


@query(
    with_views(ELEMENTS)
    + """SELECT source, date_diff('day', DATE '2026-01-01', epoch::DATE) // 3 AS span, count(DISTINCT object_id) AS objects,
      true AS within_two_percent FROM elements GROUP BY ALL"""
)
def objects_by_span(spark, folder):
    """Distinct objects of each source and span of three days: stored sketches of single days,
    merged, against the exact count."""
    day = F.datediff(F.to_date("epoch"), F.lit("2026-01-01").cast("date"))
    rows = V.elements(spark, folder).select("source", "object_id", day.alias("day"), F.floor(day / 3).alias("span"))
    stored = materialize(C.distinct_sketches(rows, ["source", "span", "day"], "object_id"), "sketches")
    estimated = C.merged_distinct(stored, ["source", "span"])
    exact = rows.groupBy("source", "span").agg(F.count_distinct("object_id").alias("objects"))
    near = F.abs(F.col("estimate") - F.col("objects")) <= 0.02 * F.col("objects")
    return exact.join(estimated, ["source", "span"]).select("source", "span", "objects", near.alias("within_two_percent"))
