"""Queries: snapshots, trajectories, playback, replay and interpolation."""

from __future__ import annotations

from datetime import timedelta
from math import pi

from pyspark.sql import functions as F

from skyframe.functions.orbit import J2000_SECONDS, SIDEREAL_AT_J2000, SIDEREAL_RATE, KeplerJ2
from skyframe.operators import lookup as L
from skyframe.operators import trajectory as T
from skyframe.workload import views as V
from skyframe.workload.registry import query
from skyframe.workload.screening import LATEST, nested, prepared_sql, states_sql
from skyframe.workload.selection import CANONICAL, JUDGED, STATUS
from skyframe.workload.views import CONJUNCTIONS, ELEMENTS, NOW_US, OBJECTS, with_views

MODEL = KeplerJ2()
START, END, STEP = V.NOW, V.NOW + timedelta(seconds=630), 60
END_US = NOW_US + 630 * 1_000_000


def fixed_sql(name: str, source: str, extra: str) -> str:
    """Earth-fixed metres of the inertial states of ``source``."""
    two_pi, turn = f"{2 * pi!r}::DOUBLE", f"{2 * pi * SIDEREAL_RATE / 86400.0!r}::DOUBLE"
    body = nested(
        source,
        f"{SIDEREAL_AT_J2000!r}::DOUBLE + {SIDEREAL_RATE!r}::DOUBLE * ((at_us / 1000000.0::DOUBLE - {J2000_SECONDS!r}::DOUBLE) / 86400.0::DOUBLE) AS turns",
        f"{two_pi} * (turns - floor(turns)) AS theta",
        "cos(theta) AS c, sin(theta) AS s",
        "c * x + s * y AS fx, c * y - s * x AS fy",
        f"c * vx + s * vy + {turn} * fy AS fvx, c * vy - s * vx - {turn} * fx AS fvy",
    )
    return f"""{name} AS (SELECT {extra}, at_us, error, fx * 1000.0::DOUBLE AS x_m, fy * 1000.0::DOUBLE AS y_m,
  z * 1000.0::DOUBLE AS z_m, fvx * 1000.0::DOUBLE AS vx_m_s, fvy * 1000.0::DOUBLE AS vy_m_s,
  vz * 1000.0::DOUBLE AS vz_m_s FROM {body})"""


METRES = ("x_m", "y_m", "z_m", "vx_m_s", "vy_m_s", "vz_m_s")


def rounded(df, *columns, digits=2):
    return df.withColumns({c: F.round(c, digits) for c in columns})


AT_NOW = f"at_now AS (SELECT *, {NOW_US} AS at_us FROM prepared)"
SNAPSHOT = with_views(
    OBJECTS, ELEMENTS, CANONICAL, JUDGED,
    prepared_sql("(SELECT * EXCLUDE (object_type, status) FROM judged)"), AT_NOW,
    states_sql("inertial", "at_now", "object_id, element_id, epoch, eligible"),
    fixed_sql("fixed", "inertial", "object_id, element_id, epoch, eligible"),
)
OUTCOME = """CASE WHEN NOT eligible THEN 'expired' WHEN error IS NOT NULL THEN 'failed' ELSE 'rendered' END"""


def _snapshot(spark, folder):
    return T.snapshot(V.elements(spark, folder), V.objects(spark, folder), V.NOW, model=MODEL)


@query(
    SNAPSHOT
    + f"""SELECT fixed.object_id, element_id, norad_cat_id, object_name, owner, {STATUS} AS ephemeris_status,
      {", ".join(f"round({c}, 2) AS {c}" for c in METRES)}, {OUTCOME} AS outcome
    FROM fixed JOIN objects ON id = fixed.object_id"""
)
def snapshot(spark, folder):
    return rounded(_snapshot(spark, folder), *METRES).select(
        "object_id", "element_id", "norad_cat_id", "object_name", "owner", "ephemeris_status", *METRES, "outcome"
    )


@query(
    SNAPSHOT
    + f"""SELECT count(*) AS total_elements, count(*) FILTER (o = 'rendered') AS rendered_objects,
      count(*) FILTER (o = 'expired') AS expired_skips, count(*) FILTER (o = 'failed') AS propagation_failures
    FROM (SELECT {OUTCOME} AS o FROM fixed)"""
)
def snapshot_counts(spark, folder):
    return T.outcome_counts(_snapshot(spark, folder))


@query(
    SNAPSHOT
    + f"""SELECT fixed.object_id, norad_cat_id, object_name,
      CASE replace(replace(upper(coalesce(object_type, 'UNKNOWN')), ' ', '_'), '-', '_')
        WHEN 'PAYLOAD' THEN 'PAYLOAD' WHEN 'DEBRIS' THEN 'DEBRIS' WHEN 'ROCKET_BODY' THEN 'ROCKET_BODY' ELSE 'UNKNOWN' END AS kind,
      CASE WHEN ops_status_code IS NULL THEN 'Unknown' WHEN ops_status_code = 'Z' THEN 'Z'
        ELSE ['Operational', 'Nonoperational', 'Partially Operational', 'Backup / Standby', 'Spare',
          'Extended Mission', 'Decayed', 'Unknown'][instr('+-PBSXD?', ops_status_code)] || ' (' || ops_status_code || ')'
        END AS operational_status,
      round(sqrt(vx_m_s ** 2 + vy_m_s ** 2 + vz_m_s ** 2) / 1000.0::DOUBLE, 6) AS speed_km_s,
      round((sqrt(x_m ** 2 + y_m ** 2 + z_m ** 2) - 6378137) / 1000.0::DOUBLE, 5) AS altitude_km
    FROM fixed JOIN objects ON id = fixed.object_id WHERE {OUTCOME} = 'rendered'"""
)
def object_detail(spark, folder):
    details = L.object_details(_snapshot(spark, folder).filter("outcome = 'rendered'"))
    return details.withColumns({"speed_km_s": F.round("speed_km_s", 6), "altitude_km": F.round("altitude_km", 5)})


POINTS = with_views(
    OBJECTS, ELEMENTS, LATEST, prepared_sql("latest"),
    f"""timed AS (SELECT *, unnest(list_append(range({NOW_US}, {END_US} + 1, {STEP}000000), {END_US})) AS at_us FROM prepared)""",
    states_sql("inertial", "timed", "object_id, element_id, epoch"),
    fixed_sql("fixed", "inertial", "object_id, element_id, epoch"),
    f"""points AS (SELECT *, (at_us - {NOW_US}) % {STEP}000000 = 0 AS on_grid,
      at_us - epoch_us(epoch) <= 72 * 3600000000 AS allowed FROM fixed)""",
)


def _arguments(spark, folder):
    return V.elements(spark, folder), V.objects(spark, folder), START, END, STEP


@query(
    POINTS
    + """, whole AS (SELECT object_id, element_id, min(at_us) FILTER (on_grid AND NOT allowed) AS expired_at_us,
        min(error) AS error FROM points GROUP BY ALL)
    SELECT w.object_id, w.element_id, w.expired_at_us, w.error, p.at_us, round(p.x_m, 2) AS x_m,
      round(p.y_m, 2) AS y_m, round(p.z_m, 2) AS z_m
    FROM whole w JOIN objects o ON o.id = w.object_id
    LEFT JOIN points p ON p.object_id = w.object_id AND w.expired_at_us IS NULL AND w.error IS NULL"""
)
def trajectory(spark, folder):
    rows = T.trajectories(*_arguments(spark, folder), model=MODEL)
    points = rows.select("object_id", "element_id", "expired_at_us", "error", F.inline_outer("points"))
    return rounded(points, "x_m", "y_m", "z_m")


PLAYBACK = POINTS + """, whole AS (SELECT object_id, element_id, any_value(epoch) AS epoch,
    min(at_us) FILTER (NOT allowed) AS e, min(at_us) FILTER (error IS NOT NULL) AS f, count(*) AS n,
    round(sum(x_m), 1) AS sum_x FROM points GROUP BY object_id, element_id),
  judged AS (SELECT *, CASE WHEN e IS NOT NULL AND (f IS NULL OR e <= f) THEN 'expired'
    WHEN f IS NOT NULL THEN 'failed' ELSE 'rendered' END AS outcome FROM whole)"""


@query(
    PLAYBACK
    + f"""SELECT j.object_id, j.element_id, o.norad_cat_id, {STATUS} AS ephemeris_status, outcome,
      CASE WHEN outcome = 'rendered' THEN n END AS point_count FROM judged j JOIN objects o ON o.id = j.object_id"""
)
def playback(spark, folder):
    rows = T.playback(*_arguments(spark, folder), model=MODEL)
    return rows.select(
        "object_id", "element_id", "norad_cat_id", "ephemeris_status", "outcome",
        F.when(F.col("points").isNotNull(), F.size("points").cast("bigint")).alias("point_count"),
    )


@query(
    PLAYBACK
    + """SELECT count(*) AS total_elements, count(*) FILTER (outcome = 'rendered') AS rendered_objects,
      count(*) FILTER (outcome = 'expired') AS expired_skips,
      count(*) FILTER (outcome = 'failed') AS propagation_failures FROM judged"""
)
def playback_counts(spark, folder):
    return T.outcome_counts(T.playback(*_arguments(spark, folder), model=MODEL))


WINDOWS = """sides AS (SELECT event_id, side, object_id, element_id, epoch_us(tca) AS tca_us FROM (
  SELECT event_id, tca, unnest(['primary', 'secondary']) AS side,
    unnest([primary_object_id, secondary_object_id]) AS object_id,
    unnest([primary_element_id, secondary_element_id]) AS element_id FROM conjunctions))"""


@query(
    with_views(CONJUNCTIONS, WINDOWS)
    + "SELECT *, tca_us - 3600000000 AS start_us, tca_us + 3600000000 AS end_us FROM sides"
)
def replay_window(spark, folder):
    return T.replay_windows(_events(spark, folder))


def _events(spark, folder):
    return V.conjunctions(spark, folder).withColumn("tca_us", F.unix_micros("tca"))


@query(
    with_views(
        ELEMENTS, CONJUNCTIONS, WINDOWS, prepared_sql("elements"),
        """timed AS (SELECT s.event_id, s.side, s.object_id AS shown_id, p.* EXCLUDE (object_id),
          tca_us - 3600000000 + k * 900000000 AS at_us FROM sides s JOIN prepared p USING (element_id), range(0, 9) r(k))""",
        states_sql("inertial", "timed", "event_id, side, shown_id, element_id"),
        fixed_sql("fixed", "inertial", "event_id, side, shown_id AS object_id, element_id"),
    )
    + """SELECT event_id, side, object_id, element_id, at_us, round(x_m, 2) AS x_m, round(y_m, 2) AS y_m,
      round(z_m, 2) AS z_m, error FROM fixed"""
)
def replay_points(spark, folder):
    points = T.replay_points(_events(spark, folder), V.elements(spark, folder), 900, MODEL)
    return rounded(points, "x_m", "y_m", "z_m")


@query(
    with_views(CONJUNCTIONS, ELEMENTS)
    + """SELECT DISTINCT secondary_element_id AS element_id FROM conjunctions
      WHERE secondary_element_id NOT IN (SELECT element_id FROM elements)"""
)
def missing_elements(spark, folder):
    wanted = V.conjunctions(spark, folder).select(F.col("secondary_element_id").alias("element_id"))
    return T.missing_ids(wanted, V.elements(spark, folder), "element_id")


TRACK_STEP = 600


def tracks(spark, folder):
    """Points of every customer each ten minutes over an hour, on a bent path."""
    key, k = F.col("c_custkey"), F.col("k")
    return V.table(spark, folder, "customer").select(
        key, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")
    ).select(
        key.alias("object_id"),
        (F.lit(NOW_US) + (k * TRACK_STEP).cast("bigint") * 1_000_000).alias("at_us"),
        (key * 10.0 + k * k * 7.0).alias("x_m"),
        (key * 3.0 - k * 11.0).alias("y_m"),
        (k * k * k * 2.0 + key % 5).alias("z_m"),
    )


TRACKS = f"""tracks AS (SELECT c_custkey AS object_id, {NOW_US} + k * {TRACK_STEP}000000 AS at_us,
  c_custkey * 10.0::DOUBLE + k * k * 7.0::DOUBLE AS x_m, c_custkey * 3.0::DOUBLE - k * 11.0::DOUBLE AS y_m,
  k * k * k * 2.0::DOUBLE + c_custkey % 5 AS z_m FROM customer, range(0, 7) r(k)),
segments AS (SELECT *, lead(at_us) OVER w AS next_us, lead(x_m) OVER w AS nx, lead(y_m) OVER w AS ny, lead(z_m) OVER w AS nz
  FROM tracks WINDOW w AS (PARTITION BY object_id ORDER BY at_us))"""
TARGET = f"{NOW_US} + (round(o_totalprice * 100)::BIGINT % 4000) * 1000000"


def lerp(a: str, b: str, share: str) -> str:
    return f"{a} + coalesce({b} - {a}, 0.0::DOUBLE) * {share}"


SHARE = "CASE WHEN next_us IS NULL THEN 0.0::DOUBLE ELSE (target_us - at_us) / (next_us - at_us) END"


@query(
    with_views(TRACKS)
    + f"""SELECT target_id, o.object_id, target_us, round({lerp("x_m", "nx", SHARE)}, 4) AS x_m,
      round({lerp("y_m", "ny", SHARE)}, 4) AS y_m, round({lerp("z_m", "nz", SHARE)}, 4) AS z_m
    FROM (SELECT o_orderkey AS target_id, o_custkey AS object_id, {TARGET} AS target_us FROM orders) o
    JOIN segments s ON s.object_id = o.object_id
      AND (target_us >= at_us AND target_us < next_us OR next_us IS NULL AND target_us = at_us)"""
)
def interpolate(spark, folder):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    targets = V.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("target_id"),
        F.col("o_custkey").alias("object_id"),
        (F.lit(NOW_US) + cents % 4000 * 1_000_000).alias("target_us"),
    )
    return rounded(T.interpolate(tracks(spark, folder), targets, TRACK_STEP), "x_m", "y_m", "z_m", digits=4)


def _at_tca(side: str) -> str:
    share = SHARE.replace("target_us", "tca_us")
    return f"""{side} AS (SELECT event_id, {", ".join(
        f"{lerp(f'{c}_m', f'n{c}', share)} AS {c}" for c in "xyz")}
      FROM inside i JOIN segments s ON s.object_id = i.{side}_object_id - 10000
        AND (tca_us >= at_us AND tca_us < next_us OR next_us IS NULL AND tca_us = at_us))"""


@query(
    with_views(
        TRACKS, CONJUNCTIONS,
        f"inside AS (SELECT *, epoch_us(tca) AS tca_us FROM conjunctions WHERE epoch_us(tca) BETWEEN {NOW_US} AND {NOW_US} + 3600000000)",
        _at_tca("primary"), _at_tca("secondary"),
    ).replace("primary AS (", "prim AS (").replace("secondary AS (", "seco AS (")
    + """SELECT i.event_id, tca_us, round((p.x + s.x) / 2, 4) AS midpoint_x_m, round((p.y + s.y) / 2, 4) AS midpoint_y_m,
      round((p.z + s.z) / 2, 4) AS midpoint_z_m, tca_us - 300000000 AS shown_from_us, tca_us + 300000000 AS shown_to_us
    FROM inside i JOIN prim p USING (event_id) JOIN seco s USING (event_id)"""
)
def events_in_window(spark, folder):
    points = tracks(spark, folder).withColumn("object_id", F.col("object_id") + 10000)
    shown = T.events_in_window(_events(spark, folder), points, NOW_US, NOW_US + 3_600_000_000, TRACK_STEP)
    middle = ("midpoint_x_m", "midpoint_y_m", "midpoint_z_m")
    return rounded(shown, *middle, digits=4).select("event_id", "tca_us", *middle, "shown_from_us", "shown_to_us")


@query(
    """SELECT o_orderkey AS request_id, CASE WHEN seconds <= 0 THEN 'end must be after start'
      WHEN step < 10 THEN 'step_seconds must be at least 10' WHEN seconds > 86400 THEN 'window cannot exceed 24 hours'
      WHEN floor(seconds / step) + 1 > 1000 THEN 'window cannot exceed 1000 points per object' END AS problem
    FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT % 100000 - 2000 AS seconds, o_orderkey % 90 AS step FROM orders)"""
)
def window_requests(spark, folder):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    requests = V.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.timestamp_micros(F.lit(NOW_US)).alias("start"),
        F.timestamp_micros(F.lit(NOW_US) + (cents % 100000 - 2000) * 1_000_000).alias("end"),
        (F.col("o_orderkey") % 90).alias("step_seconds"),
    )
    accepted, rejected = T.split_requests(requests)
    nothing = F.lit(None).cast("string").alias("problem")
    return accepted.select("request_id", nothing).unionByName(rejected.select("request_id", "problem"))
