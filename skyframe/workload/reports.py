"""Queries: landed feeds through their readers, run reports, lookups, uniqueness."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.operators import catalogue as C
from skyframe.operators import coverage as Cov
from skyframe.operators import episodes as E
from skyframe.operators import lookup as L
from skyframe.operators import operations as O
from skyframe.operators import propagation as P
from skyframe.operators import selection as Sel
from skyframe.operators import trajectory as T
from skyframe.plans.propagation_run import propagation_run, store_propagation_run
from skyframe.session import broadcast_if_small, new_folder
from skyframe.sources import feeds
from skyframe.sources.tables import check_unique, read_run_rows, read_runs
from skyframe.workload import views as V
from skyframe.workload.catalogue import GP, GP_LAST, GROUPED, KEPT, gp_records, group_records
from skyframe.workload.registry import query
from skyframe.workload.screening import DETECTIONS, LATEST, MODEL, NOW_US, ONCE, ONCE_STATES, STATUS, detections, prepared_sql
from skyframe.workload.views import CONJUNCTIONS, ELEMENTS, EXECUTIONS, OBJECTS, RUNS, with_views

#: Records of one landed JSON array.
ARRAY_ROWS = 500


def land_arrays(records, path: str, keys: tuple[str, ...] = ()) -> None:
    """Write records as files that hold one JSON array each, below ``keys`` folders. Each
    folder has as many files as its own records fill."""
    fields = [c for c in records.columns if c in K.OMM_FIELDS]
    parts = F.ceil(F.count("*") / ARRAY_ROWS).alias("parts")
    if keys:
        sizes = records.groupBy(*keys).agg(parts)
        records = records.join(broadcast_if_small(sizes, feeds.MAX_GROUPS), [*keys])
    else:
        records = records.crossJoin(F.broadcast(records.agg(parts)))
    part = F.pmod(F.xxhash64(*fields), F.col("parts")).alias("part")
    arrays = records.groupBy(*keys, part).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value")).drop("part")
    writer = arrays.write.option("maxRecordsPerFile", 1)
    (writer.partitionBy(*keys) if keys else writer).text(path)


@query(with_views(GP) + "SELECT norad_cat_id, epoch_us(epoch) AS epoch_us, mean_motion, bstar, element_set_no FROM gp")
def gp_json_read(spark, folder):
    """Element sets landed as JSON arrays and read by the feed's own reader."""
    path = new_folder(spark, "gp")
    land_arrays(gp_records(spark, folder), path)
    records = feeds.guard_record_count(feeds.read_gp_json(spark, path), 10**9)
    rows = C.gp_elements(records)
    return rows.select("norad_cat_id", F.unix_micros("epoch").alias("epoch_us"), "mean_motion", "bstar", "element_set_no")


@query(
    with_views(GP, GROUPED)
    + "SELECT grp, count(*) AS records, count(DISTINCT norad_cat_id) AS objects, sum(element_set_no)::BIGINT AS element_sets FROM grouped GROUP BY grp"
)
def group_feed_read(spark, folder):
    """Group files, one folder a group, read as one table."""
    path = new_folder(spark, "groups")
    land_arrays(group_records(spark, folder), path, ("group",))
    read = feeds.read_group_files(spark, path)
    return read.groupBy(F.col("group").alias("grp")).agg(
        F.count("*").alias("records"),
        F.count_distinct("NORAD_CAT_ID").alias("objects"),
        F.sum(F.col("ELEMENT_SET_NO").cast("bigint")).alias("element_sets"),
    )


@query(
    with_views(GP, GROUPED)
    + """, counted AS (SELECT grp, count(*) AS records FROM grouped GROUP BY grp),
    limits AS (SELECT (SELECT count(*) FROM grouped) // (SELECT count(*) FROM counted) AS most)
    SELECT grp, records, CASE WHEN records > most THEN printf('group %s holds %d records; the limit is %d', grp, records, most) END AS error,
      CASE WHEN records > most THEN 0 ELSE records END AS taken FROM counted, limits"""
)
def feed_limits(spark, folder):
    """Group feeds against a limit of the mean: groups above it are reported, and left out whole."""
    records = group_records(spark, folder)
    most = records.agg((F.count("*") / F.count_distinct("group")).cast("bigint")).first()[0]
    report = feeds.group_record_report(records, most)
    taken = feeds.within_group_limit(records, most).groupBy("group").agg(F.count("*").alias("taken"))
    rows = report.join(taken, "group", "left")
    return rows.select(F.col("group").alias("grp"), "records", "error", F.coalesce("taken", F.lit(0)).alias("taken"))


@query(
    with_views(GP, GROUPED)
    + """SELECT ordinal, 'MEAN_MOTION' || CASE WHEN ordinal % 14 = 0 THEN ', ECCENTRICITY' ELSE '' END AS fields FROM (
      SELECT ordinal FROM grouped WHERE ordinal % 7 = 0 AND grp <> 'UNLISTED')"""
)
def classification_rejected(spark, folder):
    """Records of known groups that a classification sets aside, with what they lack."""
    from skyframe.plans.classification import classify

    key = F.col("ordinal")
    records = group_records(spark, folder).withColumns(
        {
            "MEAN_MOTION": F.when(key % 7 == 0, "").otherwise(F.col("MEAN_MOTION")),
            "ECCENTRICITY": F.when(key % 14 == 0, F.lit(None)).otherwise(F.col("ECCENTRICITY")),
        }
    )
    stored = C.type_tags(V.objects(spark, folder))
    _, _, _, rejected = classify(records, V.objects(spark, folder), V.elements(spark, folder), stored)
    return rejected.select("ordinal", F.array_join(F.array_sort("missing", lambda a, b: F.when(a > b, -1).otherwise(1)), ", ").alias("fields"))


@query(
    """SELECT epoch_us(l_shipdate::TIMESTAMP) AS sample_us, l_suppkey AS object_id, count(*) AS states
      FROM lineitem GROUP BY ALL HAVING count(*) > 1"""
)
def repeated_states(spark, folder):
    """Suppliers that ship more than once a day break the rule of one state a time."""
    lines = V.table(spark, folder, "lineitem")
    return P.duplicate_states(lines.select(V.micros("l_shipdate").alias("sample_us"), F.col("l_suppkey").alias("object_id")))


@query(
    with_views(OBJECTS)
    + "SELECT id, norad_cat_id, object_name FROM objects WHERE norad_cat_id IN (SELECT o_custkey + 10000 FROM orders)"
)
def objects_by_number(spark, folder):
    wanted = V.table(spark, folder, "orders").select((F.col("o_custkey") + 10000).alias("norad_cat_id"))
    return L.objects_by_number(V.objects(spark, folder), wanted).select("id", "norad_cat_id", "object_name")


@query(
    with_views(OBJECTS, CONJUNCTIONS)
    + """SELECT event_id, run_id, p.norad_cat_id AS primary_norad_cat_id, p.object_name AS primary_name,
      s.norad_cat_id AS secondary_norad_cat_id, s.object_name AS secondary_name, miss_distance_km
    FROM conjunctions LEFT JOIN objects p ON p.id = primary_object_id LEFT JOIN objects s ON s.id = secondary_object_id"""
)
def run_report_events(spark, folder):
    """Events with the labels of both objects, as a run's report lists them."""
    return L.labelled_events(V.conjunctions(spark, folder), V.objects(spark, folder)).select(
        "event_id", "run_id", "primary_norad_cat_id", "primary_name", "secondary_norad_cat_id", "secondary_name", "miss_distance_km"
    )


@query(with_views(CONJUNCTIONS, RUNS) + "SELECT run_id, source, event_count FROM runs WHERE run_id = 12")
def one_run(spark, folder):
    return L.by_key(V.runs(spark, folder), "run_id", 12).select(F.col("run_id").cast("bigint").alias("run_id"), "source", "event_count")


@query(
    with_views(OBJECTS, GP, GP_LAST)
    + "SELECT coalesce(o.id, n.norad_cat_id) AS id, coalesce(o.norad_cat_id, n.norad_cat_id) AS norad_cat_id, "
    + ", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in C.GP_FIELDS)
    + ", " + ", ".join(f"o.{c}" for c in KEPT)
    + """, coalesce(o.has_current_elements, false) AS has_current_elements, coalesce(o.is_on_orbit, true) AS is_on_orbit,
      coalesce(o.is_earth_orbit, false) AS is_earth_orbit FROM objects o FULL JOIN gp_last n ON n.norad_cat_id = o.norad_cat_id"""
)
def gp_upsert_fields(spark, folder):
    """The upsert of a feed that brings no elements: flags stay as they are."""
    return C.upsert_gp(V.objects(spark, folder), C.gp_objects(gp_records(spark, folder)), with_elements=False)


def _stored_run(spark, folder):
    """Two propagation runs, the second a minute later, stored and read back."""
    path = new_folder(spark, "propagation")
    latest = Sel.latest_by_source(V.elements(spark, folder), "celestrak")
    for run_id in (1, 2):
        ended = V.NOW + timedelta(seconds=60 * run_id)
        states, header = propagation_run(latest, V.NOW, run_id, "celestrak", V.NOW, ended, MODEL)
        store_propagation_run(states, header, path)
    return path


@query(
    with_views(ELEMENTS, LATEST, prepared_sql("latest"), ONCE, ONCE_STATES)
    + f"""SELECT run_id, 'celestrak' AS source, count(*) AS total_objects, count(*) FILTER (good) AS successful,
      count(*) FILTER (NOT good) AS failed, {NOW_US} + run_id * 60000000 AS completed_us
    FROM (SELECT error IS NULL AND {NOW_US} - epoch_us(epoch) <= 72 * 3600000000 AS good FROM once_states),
      (SELECT unnest([1, 2])::BIGINT AS run_id) GROUP BY run_id"""
)
def propagation_runs(spark, folder):
    runs = read_runs(spark, _stored_run(spark, folder), "propagation_runs")
    return runs.select(
        F.col("run_id").cast("bigint").alias("run_id"), "source", "total_objects", "successful", "failed",
        F.unix_micros("completed_at").alias("completed_us"),
    )


@query(
    with_views(ELEMENTS, LATEST, prepared_sql("latest"), ONCE, ONCE_STATES)
    + f"""SELECT s.status, count(c.object_id) AS objects FROM (SELECT unnest({list(K.EPHEMERIS_STATUSES)}) AS status) s
    LEFT JOIN (SELECT object_id, {STATUS} AS status FROM once_states) c ON c.status = s.status GROUP BY s.status"""
)
def propagation_status_counts(spark, folder):
    """States of the latest stored run by ephemeris status."""
    path = _stored_run(spark, folder)
    states = read_run_rows(spark, path, "states", "propagation_runs")
    return Cov.propagation_status_counts(states, read_runs(spark, path, "propagation_runs"))


@query(
    with_views(EXECUTIONS)
    + """, syncs AS (SELECT provider, execution_id, finished_at, success, execution_id % 100 AS received, execution_id % 90 AS matched,
      execution_id % 80 AS imported, execution_id % 10 AS unmatched FROM executions),
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY finished_at DESC, execution_id DESC) AS n
      FROM syncs WHERE success) WHERE n = 1)
    SELECT provider, result, records FROM (SELECT provider, received, matched, imported, unmatched FROM newest)
      UNPIVOT (records FOR result IN (received, matched, imported, unmatched))"""
)
def last_record_counts(spark, folder):
    key = F.col("execution_id")
    syncs = V.executions(spark, folder).select(
        "provider", "execution_id", "finished_at", "success",
        *[(key % n).alias(c) for c, n in zip(K.RECORD_RESULTS, (100, 90, 80, 10))],
    )
    return O.last_record_counts(syncs)


@query(
    with_views(DETECTIONS)
    + """, numbered AS (SELECT *, sum(CASE WHEN gap <= 600000000 THEN 0 ELSE 1 END) OVER (
        PARTITION BY primary_object_id, secondary_object_id ORDER BY tca_us ROWS UNBOUNDED PRECEDING) AS episode
      FROM (SELECT *, tca_us - lag(tca_us) OVER (PARTITION BY primary_object_id, secondary_object_id ORDER BY tca_us) AS gap
        FROM detections))
    SELECT primary_object_id, secondary_object_id, min(miss_distance_km) AS miss_distance_km, 2 * count(*) AS merged
    FROM numbered GROUP BY primary_object_id, secondary_object_id, episode"""
)
def episodes_tied(spark, folder):
    """Each detection comes twice, as from two chunks: every encounter is one event."""
    rows = detections(spark, folder)
    events = E.merge_episodes(rows.unionByName(rows), E.within_gap(600))
    return events.select("primary_object_id", "secondary_object_id", "miss_distance_km", "merged")


@query(with_views(CONJUNCTIONS) + "SELECT run_id, count(*) AS events FROM conjunctions GROUP BY run_id")
def event_uniqueness(spark, folder):
    """Events counted by run after the check that no event repeats."""
    events = check_unique(V.conjunctions(spark, folder), ["run_id", "event_id"])
    return events.groupBy("run_id").agg(F.count("*").alias("events"))


@query(
    with_views(ELEMENTS)
    + """, asked AS (
      SELECT element_id // 16 AS request_id, element_id AS wanted, object_id AS owner, element_id % 5 AS kind FROM elements
      UNION ALL SELECT element_id // 16, -element_id, object_id, 0 FROM elements WHERE element_id % 112 = 3
      UNION ALL SELECT 1000000000 + element_id // 128, element_id, object_id, 0 FROM elements),
    sets AS (SELECT request_id, list_sort(list_distinct(list(wanted))) AS wanted,
        CASE WHEN request_id % 5 <> 2 THEN list_sort(list_distinct(list(CASE WHEN request_id % 5 = 1 AND kind = 0 THEN NULL ELSE owner END))) END AS objects
      FROM asked GROUP BY request_id),
    owners AS (SELECT request_id, list_sort(list_distinct(list(object_id))) AS found
      FROM (SELECT request_id, unnest(wanted) AS element_id FROM sets) JOIN elements USING (element_id) GROUP BY request_id),
    judged AS (SELECT *, list_sort(list_filter(wanted, lambda w: w < 0)) AS missing FROM sets LEFT JOIN owners USING (request_id)),
    outcomes AS (SELECT request_id, wanted, CASE WHEN len(wanted) > 16 THEN 'playback supports at most 16 targeted elements'
        WHEN len(missing) > 0 THEN 'unknown element ids: ' || array_to_string(missing, ', ')
        WHEN objects IS NOT NULL AND objects <> found THEN 'element ids do not match the requested objects' END AS error FROM judged)
    SELECT request_id, NULL AS element_id, NULL AS object_id, NULL AS source, NULL AS epoch_us, error FROM outcomes WHERE error IS NOT NULL
    UNION ALL SELECT request_id, element_id, object_id, source, epoch_us(epoch), NULL
      FROM (SELECT request_id, unnest(wanted) AS element_id FROM outcomes WHERE error IS NULL) JOIN elements USING (element_id)"""
)
def exact_replay_elements(spark, folder):
    """Every element is named by a replay request of up to 16 neighbours. Some requests also
    name unknown elements, leave out objects, or name no objects; and wider ones are too many."""
    elements = V.elements(spark, folder)
    number, owner = F.col("element_id"), F.col("object_id")

    def named(rows, request, wanted, kind):
        return rows.select(request.alias("request_id"), wanted.alias("wanted"), owner.alias("owner"), kind.alias("kind"))

    narrow = F.floor(number / 16)
    asked = (
        named(elements, narrow, number, number % 5)
        .unionByName(named(elements.filter(number % 112 == 3), narrow, -number, F.lit(0)))
        .unionByName(named(elements, 1_000_000_000 + F.floor(number / 128), number, F.lit(0)))
    )
    partial = F.when((F.col("request_id") % 5 == 1) & (F.col("kind") == 0), F.lit(None)).otherwise(F.col("owner"))
    requests = asked.groupBy("request_id").agg(
        F.collect_set("wanted").alias("element_ids"), F.collect_set(partial).alias("object_ids")
    ).withColumn("object_ids", F.when(F.col("request_id") % 5 != 2, F.col("object_ids")))
    chosen = T.replay_requests(requests, elements.select("element_id", "object_id", "source", "epoch"))
    return chosen.select("request_id", "element_id", "object_id", "source", F.unix_micros("epoch").alias("epoch_us"), "error")


@query(
    with_views(OBJECTS, ELEMENTS)
    + """SELECT 'self' AS compared, true AS same UNION ALL SELECT 'catalogue', NOT EXISTS (
        SELECT id FROM objects EXCEPT SELECT object_id FROM elements) AND NOT EXISTS (
        SELECT object_id FROM elements EXCEPT SELECT id FROM objects)"""
)
def same_id_sets(spark, folder):
    """Whether elements name the same objects as themselves and as the catalogue."""
    ids = V.elements(spark, folder).select("object_id")
    catalogue = V.objects(spark, folder).select(F.col("id").alias("object_id"))
    answers = [("self", T.same_ids(ids, ids, "object_id")), ("catalogue", T.same_ids(ids, catalogue, "object_id"))]
    return spark.createDataFrame(answers, "compared string, same boolean")
