"""Queries: pair search, propagation, refinement, episodes and whole runs."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.functions.motion import acceleration_bound_km_s2
from skyframe.functions.orbit import STATE, KeplerJ2, StraightLine
from skyframe.operators import episodes as E
from skyframe.operators import propagation as P
from skyframe.operators import screening as S
from skyframe.operators import selection as Sel
from skyframe.operators.spatial import fixed_radius_pairs
from skyframe.plans.screening_run import ScreeningOptions, budget_report, chunk_report, run_screening, screen
from skyframe.plans.screening_run import refine_candidates as refined_pairs
from skyframe.workload import views as V
from skyframe.workload.registry import query
from skyframe.workload.selection import CANONICAL, JUDGED, STATUS
from skyframe.workload.views import (
    ELEMENTS,
    EPOCH_BASE_US,
    NOW_US,
    OBJECTS,
    STRAIGHT_STATES,
    with_views,
)

RADIUS = 90.0  # 10 km + 16 km/s over half of a 10 s step

# Pairs by bands along x only: one join per band and its neighbour.
STRAIGHT_PAIRS = f"""banded AS (SELECT *, floor(x / {RADIUS})::BIGINT AS band FROM states),
pairs AS (
  SELECT sample_us, a.object_id AS a_id, b.object_id AS b_id, sqrt(d2) AS separation_km,
    b.x - a.x AS rx, b.y - a.y AS ry, b.z - a.z AS rz,
    b.vx - a.vx AS ux, b.vy - a.vy AS uy, b.vz - a.vz AS uz,
    a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz
  FROM (
    SELECT a.sample_us, a, b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
    FROM banded a JOIN (SELECT *, unnest([band - 1, band, band + 1]) AS near FROM banded) b
      ON a.sample_us = b.sample_us AND a.band = b.near AND a.object_id < b.object_id
  ) WHERE d2 <= {RADIUS} * {RADIUS}
)"""


@query(
    with_views(STRAIGHT_STATES, STRAIGHT_PAIRS)
    + """SELECT sample_us, a_id AS a_object_id, b_id AS b_object_id,
      round(separation_km, 6) AS separation_km FROM pairs"""
)
def radius_pairs(spark, folder):
    pairs = fixed_radius_pairs(V.straight_states(spark, folder), RADIUS)
    return pairs.select("sample_us", "a_object_id", "b_object_id", F.round("separation_km", 6).alias("separation_km"))


APPROACH = """approach AS (
  SELECT *, sqrt((rx + ux * dt) * (rx + ux * dt) + (ry + uy * dt) * (ry + uy * dt)
      + (rz + uz * dt) * (rz + uz * dt)) AS miss, sqrt(u2) AS speed
  FROM (SELECT *, ux * ux + uy * uy + uz * uz AS u2,
      CASE WHEN u2 = 0 THEN 0.0::DOUBLE
        ELSE greatest(-5.0::DOUBLE, least(5.0::DOUBLE, -(rx * ux + ry * uy + rz * uz) / u2)) END AS dt
    FROM pairs)
)"""


@query(
    with_views(STRAIGHT_STATES, STRAIGHT_PAIRS, APPROACH)
    + """SELECT a_id AS primary_object_id, b_id AS secondary_object_id, tca_us,
      round(dt, 6) AS delta_t_seconds, round(miss, 6) AS miss_distance_km,
      round(speed, 6) AS relative_velocity_km_s, 'linear-relative-motion' AS method
    FROM (SELECT *, sample_us + round_even(dt * 1000000.0::DOUBLE, 0)::BIGINT AS tca_us FROM (
        SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY separation_km, sample_us) AS n FROM approach)
      WHERE n = 1 AND miss <= 10)
    WHERE tca_us BETWEEN (SELECT min(sample_us) FROM states) AND (SELECT max(sample_us) FROM states)"""
)
def linear_screening(spark, folder):
    events = S.linear_screening(V.straight_states(spark, folder), step_seconds=10)
    rounded = ("delta_t_seconds", "miss_distance_km", "relative_velocity_km_s")
    return S.final_order(events).withColumns({c: F.round(c, 6) for c in rounded})


@query(
    with_views(STRAIGHT_STATES, STRAIGHT_PAIRS, APPROACH)
    + f"""SELECT sample_us, a_id AS a_object_id, b_id AS b_object_id,
      round(miss - 8.0::DOUBLE * 0.5::DOUBLE * 25.0::DOUBLE * (
        {K.EARTH_MU_KM3_S2}::DOUBLE / (ax * ax + ay * ay + az * az)
        + {K.EARTH_MU_KM3_S2}::DOUBLE / (bx * bx + by_ * by_ + bz * bz)), 6) AS slack_km
    FROM approach WHERE miss - 100.0::DOUBLE * (
        {K.EARTH_MU_KM3_S2}::DOUBLE / (ax * ax + ay * ay + az * az)
        + {K.EARTH_MU_KM3_S2}::DOUBLE / (bx * bx + by_ * by_ + bz * bz)) <= 10"""
)
def prefilter_pairs(spark, folder):
    pairs = fixed_radius_pairs(V.straight_states(spark, folder), RADIUS, payload=S.VELOCITY)
    kept = S.within_slack(pairs, 5.0, 10.0)
    return kept.select("sample_us", "a_object_id", "b_object_id", F.round("slack_km", 6).alias("slack_km"))


@query(
    with_views(STRAIGHT_STATES)
    + """SELECT sample_us, object_id, count(*) AS states FROM states
      GROUP BY sample_us, object_id HAVING count(*) > 1"""
)
def duplicate_states(spark, folder):
    return P.duplicate_states(V.straight_states(spark, folder))


FINGERPRINT = ", ".join(S.FINGERPRINT)
GROUPS = f"""shared AS (
  SELECT {FINGERPRINT}, min(object_id) AS solution_id, count(DISTINCT object_id) AS objects
  FROM elements GROUP BY ALL HAVING count(DISTINCT object_id) >= 2
)"""


@query(
    with_views(ELEMENTS, GROUPS)
    + "SELECT solution_id, objects, (objects * (objects - 1)) // 2 AS pairs FROM shared"
)
def shared_solutions(spark, folder):
    return S.shared_solution_groups(V.elements(spark, folder)).select("solution_id", "objects", "pairs")


@query(
    with_views(ELEMENTS, GROUPS)
    + """SELECT count(*) AS shared_solution_groups, coalesce(sum(objects), 0)::BIGINT AS shared_solution_objects,
      coalesce(sum((objects * (objects - 1)) // 2), 0)::BIGINT AS shared_pairs FROM shared"""
)
def shared_solution_totals(spark, folder):
    return S.shared_solution_totals(S.shared_solution_groups(V.elements(spark, folder)))


@query(
    with_views(STRAIGHT_STATES, STRAIGHT_PAIRS)
    + """SELECT a_id AS a_object_id, b_id AS b_object_id, count(*) AS detections,
      a_id // 4 = b_id // 4 AS shared FROM pairs GROUP BY ALL"""
)
def exclude_shared(spark, folder):
    """Orders whose keys share a block of four stand for one solution."""
    states = V.straight_states(spark, folder).withColumn("solution_id", F.floor(F.col("object_id") / 4))
    pairs = fixed_radius_pairs(states, RADIUS, payload=("solution_id",))
    return pairs.groupBy("a_object_id", "b_object_id", S.same_solution().alias("shared")).agg(
        F.count("*").alias("detections")
    )


@query(
    """WITH r AS (SELECT c_custkey AS request_id, 60 + c_custkey % 3600 AS horizon FROM customer),
    times AS (
      SELECT request_id, t, row_number() OVER (PARTITION BY request_id ORDER BY t) - 1 AS i,
        count(*) OVER (PARTITION BY request_id) - 1 AS last
      FROM (SELECT request_id, unnest(range(0, horizon + 1, 60)) AS t FROM r
        UNION SELECT request_id, horizon FROM r))
    SELECT request_id, i::INTEGER AS sample_index, t AS seconds, chunk::INTEGER AS chunk
    FROM times JOIN range(0, 10) c(chunk) ON i BETWEEN chunk * 15 AND chunk * 15 + 15
      AND chunk * 15 < last"""
)
def sample_chunks(spark, folder):
    customers = V.table(spark, folder, "customer")
    start = F.lit(EPOCH_BASE_US)
    end = start + (60 + F.col("c_custkey") % 3600) * 1_000_000
    times = P.sample_times_us(start, end, 60)
    rows = customers.select(
        F.col("c_custkey").alias("request_id"),
        (F.size(times) - 1).alias("last"),
        F.posexplode(times).alias("sample_index", "sample_us"),
    )
    return rows.select(
        "request_id",
        "sample_index",
        ((F.col("sample_us") - EPOCH_BASE_US) / 1_000_000).cast("bigint").alias("seconds"),
        F.explode(P.chunks_of_sample(F.col("sample_index"), P.chunk_intervals(60, 900), F.col("last"))).alias("chunk"),
    )


def nested(source: str, *levels: str) -> str:
    """Each level computes from the one before; an alias inside one SELECT would be
    written out again at every use."""
    for level in levels:
        source = f"(SELECT *, {level} FROM {source})"
    return source


def prepared_sql(source: str) -> str:
    """Model constants of the rows of ``source``."""
    mu, radius, j2 = K.WGS72_MU_KM3_S2, K.WGS72_RADIUS_KM, K.WGS72_J2
    body = nested(
        source,
        "eccentricity >= 0 AND eccentricity < 1 AND mean_motion > 0 AS fine, epoch_us(epoch) AS k_epoch_us",
        f"""CASE WHEN fine THEN eccentricity END AS k_e,
    CASE WHEN fine THEN mean_motion * ({2 * pi!r}::DOUBLE / 86400.0::DOUBLE) END AS k_n,
    cos(radians(inclination)) AS k_cosi, sin(radians(inclination)) AS k_sini,
    radians(mean_anomaly) AS k_m0, radians(ra_of_asc_node) AS k_node0, radians(arg_of_pericenter) AS k_peri0""",
        f"pow({mu}::DOUBLE / (k_n * k_n), 1.0::DOUBLE / 3.0::DOUBLE) AS k_a, sqrt(1.0::DOUBLE - k_e * k_e) AS k_b",
        f"1.5::DOUBLE * {j2}::DOUBLE * k_n * pow({radius}::DOUBLE / (k_a * k_b * k_b), 2.0::DOUBLE) AS drift",
        """-drift * k_cosi AS k_nodedot, drift * (2.0::DOUBLE - 2.5::DOUBLE * k_sini * k_sini) AS k_peridot,
    k_n + drift * k_b * (1.0::DOUBLE - 1.5::DOUBLE * k_sini * k_sini) AS k_mdot""",
    )
    return f"prepared AS (SELECT * FROM {body})"


def states_sql(name: str, source: str, extra: str) -> str:
    """States of the rows of ``source`` (model constants and ``at_us``)."""
    return f"{name} AS MATERIALIZED (SELECT {extra}, at_us, x, y, z, vx, vy, vz, error FROM {moved_sql(source)})"


def moved_sql(source: str) -> str:
    """The rows of ``source`` with their states."""
    two_pi = f"{2 * pi!r}::DOUBLE"
    newton = [
        f"e{i} - (e{i} - k_e * sin(e{i}) - m) / (1.0::DOUBLE - k_e * cos(e{i})) AS e{i + 1}" for i in range(5)
    ]
    return nested(
        source,
        "(at_us - k_epoch_us) / 1000000.0::DOUBLE AS dt",
        "k_m0 + k_mdot * dt AS turned, k_node0 + k_nodedot * dt AS node, k_peri0 + k_peridot * dt AS peri",
        f"turned - {two_pi} * floor(turned / {two_pi}) AS m",
        "m + k_e * sin(m) AS e0",
        *newton,
        "cos(e5) AS ce, sin(e5) AS se, cos(peri) AS cw, sin(peri) AS sw, cos(node) AS cn, sin(node) AS sn",
        "k_a * (1.0::DOUBLE - k_e * ce) AS r, k_a * k_n / (1.0::DOUBLE - k_e * ce) AS rate",
        """k_a * (ce - k_e) AS px, k_a * k_b * se AS py, -rate * se AS pvx, rate * k_b * ce AS pvy,
    cn * cw - sn * sw * k_cosi AS xa, -cn * sw - sn * cw * k_cosi AS xb,
    sn * cw + cn * sw * k_cosi AS ya, -sn * sw + cn * cw * k_cosi AS yb,
    sw * k_sini AS za, cw * k_sini AS zb""",
        f"""xa * px + xb * py AS x, ya * px + yb * py AS y, za * px + zb * py AS z,
    xa * pvx + xb * pvy AS vx, ya * pvx + yb * pvy AS vy, za * pvx + zb * pvy AS vz,
    CASE WHEN r IS NULL THEN 'elements outside the model''s range'
      WHEN r < {K.WGS72_RADIUS_KM}::DOUBLE THEN 'object has decayed' END AS error""",
    )


HORIZON, STEP, DISTANCE = 1800, 60, 25.0
SCREEN_RADIUS = DISTANCE + 16.0 * STEP / 2
OPTIONS = ScreeningOptions(start=V.NOW, horizon_seconds=HORIZON, step_seconds=STEP, distance_km=DISTANCE)
MODEL = KeplerJ2()

CHOSEN = "chosen AS (SELECT * EXCLUDE (object_type, status, eligible) FROM judged WHERE eligible)"
GRID = f"""gridded AS (
  SELECT *, unnest(range(0, {HORIZON // STEP + 1})) AS sample_index,
    {NOW_US} + sample_index * {STEP}000000 AS at_us FROM prepared
), live AS (SELECT * FROM gridded WHERE at_us - epoch_us(epoch) <= 72 * 3600000000)"""
GRID_STATES = states_sql("grid_states", "live", "object_id, element_id, sample_index")
ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in STATE)


def _chosen(spark, folder):
    judged = Sel.judge_canonical(V.elements(spark, folder), V.objects(spark, folder), V.now())
    return MODEL.prepare(Sel.eligible_elements(judged))


@query(
    with_views(OBJECTS, ELEMENTS, CANONICAL, JUDGED, CHOSEN, prepared_sql("chosen"), GRID, GRID_STATES)
    + f"SELECT object_id, sample_index::INTEGER AS sample_index, at_us AS sample_us, {ROUNDED}, error FROM grid_states"
)
def propagate_grid(spark, folder):
    states = P.propagate_grid(P.on_grid(_chosen(spark, folder), V.NOW, HORIZON, STEP), MODEL)
    return states.withColumns({c: F.round(c, 4) for c in STATE})


LATEST = """latest AS (SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY epoch DESC, element_id DESC) AS n
  FROM elements WHERE source = 'celestrak') WHERE n = 1)"""
ONCE = f"once AS (SELECT *, {NOW_US} AS at_us FROM prepared)"
ONCE_STATES = states_sql("once_states", "once", "object_id, element_id, epoch")
STATE_NAMES = {c: (f"position_{c}_km" if len(c) == 1 else f"velocity_{c[1]}_km_s") for c in STATE}


@query(
    with_views(ELEMENTS, LATEST, prepared_sql("latest"), ONCE, ONCE_STATES)
    + "SELECT object_id, element_id, 'TEME' AS frame, live AND error IS NULL AS success, "
    + f"({NOW_US} - epoch_us(epoch)) / 1000000.0::DOUBLE AS ephemeris_age_seconds, {STATUS} AS ephemeris_status, "
    + ", ".join(f"CASE WHEN success THEN round({c}, 4) END AS {n}" for c, n in STATE_NAMES.items())
    + f""", CASE WHEN NOT live THEN 'ExpiredEphemeris' WHEN error IS NOT NULL THEN 'PropagationError' END AS error_type,
      CASE WHEN NOT live THEN printf('Orbital element age %.2fh exceeds maximum %.2fh',
        ({NOW_US} - epoch_us(epoch)) / 3600000000.0::DOUBLE, 72.0::DOUBLE) ELSE error END AS error_message
    FROM (SELECT *, {NOW_US} - epoch_us(epoch) <= 72 * 3600000000 AS live FROM once_states)"""
)
def batch_states(spark, folder):
    latest = Sel.latest_by_source(V.elements(spark, folder), "celestrak")
    states = P.propagate_once(latest, V.now(), MODEL).drop("target_time")
    return states.withColumns({n: F.round(n, 4) for n in STATE_NAMES.values()})


@query(
    with_views(ELEMENTS, LATEST, prepared_sql("latest"), ONCE, ONCE_STATES)
    + f"""SELECT count(*) AS total_objects, count(*) FILTER (good) AS successful, count(*) FILTER (NOT good) AS failed
    FROM (SELECT error IS NULL AND {NOW_US} - epoch_us(epoch) <= 72 * 3600000000 AS good FROM once_states)"""
)
def propagation_totals(spark, folder):
    latest = Sel.latest_by_source(V.elements(spark, folder), "celestrak")
    return P.propagation_totals(P.propagate_once(latest, V.now(), MODEL))


# The whole run in SQL: every pair at every sample, best per chunk and pair,
# sampled refinement, and detections of one pair within a second as one episode.
SCREENED = f"""raw AS (
  SELECT sample_us, sample_index, a_id, b_id, sqrt(d2) AS separation_km,
    CASE WHEN u2 = 0 THEN 0.0::DOUBLE ELSE greatest(-{STEP / 2}::DOUBLE, least({STEP / 2}::DOUBLE,
      -(rx * ux + ry * uy + rz * uz) / u2)) END AS dt,
    sqrt((rx + ux * dt) ** 2 + (ry + uy * dt) ** 2 + (rz + uz * dt) ** 2)
      - {8.0 * 0.5 * (STEP / 2) ** 2}::DOUBLE * ({K.EARTH_MU_KM3_S2}::DOUBLE / ra + {K.EARTH_MU_KM3_S2}::DOUBLE / rb) AS slack
  FROM (
    SELECT a.at_us AS sample_us, a.sample_index, a.object_id AS a_id, b.object_id AS b_id,
      b.x - a.x AS rx, b.y - a.y AS ry, b.z - a.z AS rz, rx * rx + ry * ry + rz * rz AS d2,
      b.vx - a.vx AS ux, b.vy - a.vy AS uy, b.vz - a.vz AS uz, ux * ux + uy * uy + uz * uz AS u2,
      a.x * a.x + a.y * a.y + a.z * a.z AS ra, b.x * b.x + b.y * b.y + b.z * b.z AS rb
    FROM grid_states a JOIN grid_states b ON a.sample_index = b.sample_index AND a.object_id < b.object_id
    WHERE a.error IS NULL AND b.error IS NULL)
  WHERE d2 <= {SCREEN_RADIUS}::DOUBLE * {SCREEN_RADIUS}::DOUBLE
), solutions AS (
  SELECT {FINGERPRINT}, min(object_id) AS solution_id FROM chosen GROUP BY ALL HAVING count(DISTINCT object_id) >= 2
), members AS (
  SELECT c.object_id, s.solution_id FROM chosen c JOIN solutions s ON c.source = s.source AND c.epoch = s.epoch
    AND c.inclination = s.inclination AND c.ra_of_asc_node = s.ra_of_asc_node
    AND c.eccentricity = s.eccentricity AND c.arg_of_pericenter = s.arg_of_pericenter
    AND c.mean_anomaly = s.mean_anomaly AND c.mean_motion = s.mean_motion
    AND c.mean_motion_dot IS NOT DISTINCT FROM s.mean_motion_dot
    AND c.mean_motion_ddot IS NOT DISTINCT FROM s.mean_motion_ddot AND c.bstar = s.bstar
), detected AS (
  SELECT r.*, chunk, coalesce(ma.solution_id = mb.solution_id, false) AS shared
  FROM raw r JOIN range(0, {HORIZON // 900}) c(chunk) ON sample_index BETWEEN chunk * 15 AND chunk * 15 + 15
  LEFT JOIN members ma ON ma.object_id = a_id LEFT JOIN members mb ON mb.object_id = b_id
), best AS (
  SELECT * FROM (SELECT *, count(*) OVER w AS detections,
      row_number() OVER (w ORDER BY separation_km, sample_us) AS n
    FROM detected WINDOW w AS (PARTITION BY chunk, a_id, b_id)) WHERE n = 1
), kept AS (
  SELECT chunk, a_id, b_id, sample_us, greatest({NOW_US}, sample_us - {STEP}000000) AS from_us,
    least({NOW_US + HORIZON * 1_000_000}, sample_us + {STEP}000000) AS to_us
  FROM best WHERE NOT shared AND slack <= {DISTANCE}
)"""
PAIR_KEYS = "chunk, a_id, b_id, sample_us, from_us, to_us"


def pair_states_sql(name: str, source: str) -> str:
    """Relative states of both sides of ``source`` rows at ``at_us``."""
    sides = []
    for side in "ab":
        joined = f"(SELECT s.*, p.* FROM {source} s JOIN prepared p ON p.object_id = s.{side}_id)"
        sides.append(states_sql(f"{name}_{side}", joined, PAIR_KEYS))
    return ",\n".join(sides) + f""",
{name} AS (
  SELECT {', '.join('a.' + k.strip() for k in PAIR_KEYS.split(','))}, a.at_us,
    b.x - a.x AS rx, b.y - a.y AS ry, b.z - a.z AS rz, b.vx - a.vx AS ux, b.vy - a.vy AS uy, b.vz - a.vz AS uz,
    rx * rx + ry * ry + rz * rz AS d2, ux * ux + uy * uy + uz * uz AS u2,
    a.error IS NOT NULL OR b.error IS NOT NULL AS bad
  FROM {name}_a a JOIN {name}_b b USING (chunk, a_id, b_id, at_us)
)"""


REFINED = f"""coarse_times AS (
  SELECT {PAIR_KEYS}, unnest(list_distinct(list_append(range(from_us, to_us + 1, 10000000), to_us))) AS at_us FROM kept
),
{pair_states_sql("coarse", "coarse_times")},
coarse_best AS (SELECT {PAIR_KEYS}, arg_min(at_us, d2) AS best_us, bool_or(bad) AS bad1 FROM coarse GROUP BY {PAIR_KEYS}),
fine_times AS (
  SELECT DISTINCT {PAIR_KEYS}, least(to_us, greatest(from_us, best_us + k * 1000000)) AS at_us
  FROM coarse_best, range(-10, 11) r(k)
),
{pair_states_sql("fine", "fine_times")},
fine_best AS (SELECT {PAIR_KEYS}, arg_min(at_us, d2) AS at_us, bool_or(bad) AS bad2 FROM fine GROUP BY {PAIR_KEYS}),
{pair_states_sql("near", "fine_best")},
last_times AS (
  SELECT {PAIR_KEYS}, least(to_us, greatest(from_us, at_us + round_even(1000000.0::DOUBLE * CASE WHEN u2 = 0 THEN 0
    ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, -(rx * ux + ry * uy + rz * uz) / u2)) END, 0)::BIGINT)) AS at_us
  FROM near
),
{pair_states_sql("final", "last_times")},
refined AS (
  SELECT f.*, sqrt(f.d2) AS miss, sqrt(f.u2) AS speed, f.bad OR c.bad1 OR n.bad2 AS failed
  FROM final f JOIN coarse_best c USING (chunk, a_id, b_id) JOIN fine_best n USING (chunk, a_id, b_id)
)"""
RUN_VIEWS = with_views(
    OBJECTS, ELEMENTS, CANONICAL, JUDGED, CHOSEN, prepared_sql("chosen"), GRID, GRID_STATES, SCREENED, REFINED
)
EPISODES = f""", hits AS (SELECT *, at_us - lag(at_us) OVER (PARTITION BY a_id, b_id ORDER BY at_us, miss) AS gap
  FROM refined WHERE NOT failed AND miss <= {DISTANCE}),
numbered AS (SELECT *, sum(CASE WHEN gap <= 1000000 THEN 0 ELSE 1 END)
  OVER (PARTITION BY a_id, b_id ORDER BY at_us, miss ROWS UNBOUNDED PRECEDING) AS episode FROM hits),
episodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id, episode ORDER BY miss, at_us) AS n,
  count(*) OVER (PARTITION BY a_id, b_id, episode) AS merged FROM numbered) WHERE n = 1)"""

BOUND = f"{acceleration_bound_km_s2()!r}::DOUBLE"


def distance_sql(source: str, columns: str) -> str:
    """``columns`` of ``source`` (``a_id``, ``b_id``, ``at_us``) and the distance ``km`` then."""
    one = moved_sql(f"(SELECT s.*, p.* FROM {source} s JOIN prepared p ON p.object_id = s.a_id)")
    one = f"(SELECT {columns}, a_id, b_id, at_us, x AS ax, y AS ay, z AS az FROM {one})"
    two = moved_sql(f"(SELECT s.*, p.* FROM {one} s JOIN prepared p ON p.object_id = s.b_id)")
    return f"(SELECT {columns}, a_id, b_id, at_us, sqrt((x - ax) ** 2 + (y - ay) ** 2 + (z - az) ** 2) AS km FROM {two})"


JUDGED_INTERVAL = f"""CASE WHEN greatest(dl, dr) > {DISTANCE} THEN 'exit'
    WHEN greatest(dl, dr) + {BOUND} * ((r - l) / 1e6) ** 2 / 8e0 + 1e-9 <= {DISTANCE} THEN 'inside' ELSE 'open' END"""
# Open intervals are halved. After each third halving, gaps that were seen outside leave.
FRONTIER = f""", gaps AS (SELECT a_id, b_id, at_us - gap AS from_us, at_us AS to_us FROM hits WHERE gap > 0),
ends AS (SELECT a_id, b_id, from_us, to_us, unnest([from_us, to_us]) AS at_us FROM gaps),
frontier(level, a_id, b_id, from_us, to_us, l, r, dl, dr, verdict, fresh) AS (
  SELECT *, {JUDGED_INTERVAL}, false FROM (
    SELECT 0, a_id, b_id, from_us, to_us, from_us AS l, to_us AS r,
      max(km) FILTER (at_us = from_us) AS dl, max(km) FILTER (at_us = to_us) AS dr
    FROM {distance_sql("ends", "from_us, to_us")} GROUP BY ALL)
  UNION ALL
  SELECT * EXCLUDE (fresh), CASE WHEN fresh THEN {JUDGED_INTERVAL} ELSE 'exit' END, fresh FROM (
    SELECT level + 1, a_id, b_id, from_us, to_us, CASE side WHEN 1 THEN at_us ELSE l END AS l,
      CASE side WHEN 0 THEN at_us ELSE r END AS r, CASE side WHEN 1 THEN km ELSE dl END AS dl,
      CASE side WHEN 0 THEN km ELSE dr END AS dr, verdict = 'open' AS fresh
    FROM (SELECT *, unnest(CASE verdict WHEN 'open' THEN [0, 1] ELSE [2] END) AS side FROM {distance_sql(
      """(SELECT *, l + (r - l) // 2 AS at_us FROM (SELECT *, bool_or(verdict = 'exit') OVER (PARTITION BY a_id, b_id, from_us) AS gone
        FROM frontier) WHERE verdict = 'open' AND NOT (gone AND level % 3 = 0) OR verdict = 'exit' AND level % 3 <> 0)""",
      "level, from_us, to_us, l, r, dl, dr, verdict")}))
)"""


@query(
    RUN_VIEWS
    + """SELECT chunk::INTEGER AS chunk, a_id AS a_object_id, b_id AS b_object_id, detections, shared,
      round(separation_km, 6) AS separation_km, sample_us, round(slack, 6) AS slack_km FROM best"""
)
def screening_candidates(spark, folder):
    return _candidates(spark, folder).withColumns({c: F.round(c, 6) for c in ("separation_km", "slack_km")})


def _candidates(spark, folder):
    return screen(V.elements(spark, folder), V.objects(spark, folder), OPTIONS, MODEL).candidates


def _screening(spark, folder):
    return run_screening(V.elements(spark, folder), V.objects(spark, folder), OPTIONS, MODEL)


@query(
    RUN_VIEWS
    + """SELECT chunk::INTEGER AS chunk, a_id AS a_object_id, b_id AS b_object_id, true AS attempted, failed,
      at_us AS tca_us, round(miss, 6) AS miss_distance_km, round(speed, 6) AS relative_velocity_km_s FROM refined"""
)
def refine_candidates(spark, folder):
    refined = refined_pairs(V.elements(spark, folder), V.objects(spark, folder), OPTIONS, MODEL)
    return refined.select(
        "chunk", "a_object_id", "b_object_id", "attempted", "failed", "tca_us",
        F.round("miss_distance_km", 6).alias("miss_distance_km"),
        F.round("relative_velocity_km_s", 6).alias("relative_velocity_km_s"),
    )


@query(
    RUN_VIEWS
    + EPISODES
    + """SELECT a_id AS primary_object_id, b_id AS secondary_object_id, p.element_id AS primary_element_id,
      s.element_id AS secondary_element_id, at_us AS tca_us, round(miss, 6) AS miss_distance_km, merged
    FROM episodes JOIN chosen p ON p.object_id = a_id JOIN chosen s ON s.object_id = b_id"""
)
def screening_events(spark, folder):
    events = _screening(spark, folder).events
    return S.final_order(events).select(
        "primary_object_id", "secondary_object_id", "primary_element_id", "secondary_element_id",
        "tca_us", F.round("miss_distance_km", 6).alias("miss_distance_km"), "merged",
    )


@query(
    "WITH RECURSIVE " + RUN_VIEWS.removeprefix("WITH ")
    + EPISODES
    + FRONTIER
    + f""", chunks AS (SELECT chunk, sum(detections) AS raw, count(*) FILTER (NOT shared) AS kept,
        count(*) FILTER (shared) AS suppressed FROM best GROUP BY chunk),
    tries AS (SELECT chunk, count(*) AS attempts, count(*) FILTER (failed) AS failures FROM refined GROUP BY chunk)
    SELECT (SELECT count(*) FROM chosen) AS objects, {HORIZON // STEP + 1}::BIGINT AS samples,
      {HORIZON // 900}::BIGINT AS chunk_count, 900::BIGINT AS chunk_seconds,
      (SELECT count(*) FROM grid_states) AS propagation_attempts,
      (SELECT count(*) FROM grid_states WHERE error IS NOT NULL) AS propagation_failures,
      (SELECT count(*) FROM gridded) - (SELECT count(*) FROM live)
        + (SELECT count(*) FROM judged WHERE NOT eligible) * {HORIZON // STEP + 1} AS expired_skips,
      sum(raw)::BIGINT AS raw_candidates, sum(kept)::BIGINT AS unique_candidates,
      sum(suppressed)::BIGINT AS suppressed_shared_pairs, max(raw)::BIGINT AS max_chunk_raw_candidates,
      max(kept)::BIGINT AS max_chunk_unique_candidates,
      (SELECT coalesce(sum(attempts), 0)::BIGINT FROM tries) AS refinement_attempts,
      (SELECT coalesce(sum(failures), 0)::BIGINT FROM tries) AS refinement_failures,
      (SELECT coalesce(max(attempts), 0)::BIGINT FROM tries) AS max_chunk_refinement_attempts,
      (SELECT count(DISTINCT solution_id) FROM members) AS shared_solution_groups,
      (SELECT count(*) FROM members) AS shared_solution_objects,
      (SELECT count(*) FROM episodes) AS event_count,
      (SELECT coalesce(sum(merged) - count(*), 0)::BIGINT FROM episodes) AS duplicate_events_suppressed,
      (SELECT count(*) FILTER (gap > 0) FROM hits) AS episode_checks,
      (SELECT 4 * (SELECT count(*) FROM gaps) + count(*) FILTER (fresh) FROM frontier) AS episode_propagations
    FROM chunks"""
)
def screening_run(spark, folder):
    return _screening(spark, folder).counters


CHUNK_LIMIT = 40


@query(
    RUN_VIEWS
    + f"""SELECT chunk::INTEGER AS chunk, first_sample::INTEGER AS first_sample, last_sample::INTEGER AS last_sample,
      {NOW_US} + first_sample * {STEP}000000 AS start_us, {NOW_US} + last_sample * {STEP}000000 AS end_us, unique_candidates,
      CASE WHEN unique_candidates > {CHUNK_LIMIT} THEN printf('chunk %d (samples %d to %d) has %d unique candidates; the limit is {CHUNK_LIMIT}',
        chunk + 1, first_sample, last_sample, unique_candidates) END AS error
    FROM (SELECT chunk, chunk * 15 AS first_sample, least(chunk * 15 + 15, {HORIZON // STEP}) AS last_sample,
      count(*) FILTER (NOT shared) AS unique_candidates FROM best GROUP BY chunk)"""
)
def chunk_limits(spark, folder):
    """Unique candidates by chunk against a limit, with the chunk's samples and bounds."""
    return chunk_report(_candidates(spark, folder), OPTIONS, CHUNK_LIMIT)


@query(
    with_views(OBJECTS, ELEMENTS, CANONICAL, JUDGED, CHOSEN)
    + f"""SELECT objects, objects * {HORIZON // STEP + 1} AS propagations, CASE WHEN objects > 40000
        THEN printf('object count %d exceeds the limit of 40000', objects)
      WHEN objects * {HORIZON // STEP + 1} > 1000 THEN printf('propagation workload %d exceeds the limit of 1000', objects * {HORIZON // STEP + 1}) END AS error
    FROM (SELECT count(*) AS objects FROM chosen)"""
)
def run_budget(spark, folder):
    """The work of a run against budgets, before anything is propagated."""
    judged = Sel.judge_canonical(V.elements(spark, folder), V.objects(spark, folder), V.now(), OPTIONS.limits)
    return budget_report(Sel.eligible_elements(judged), HORIZON // STEP + 1, 40_000, 1000)


DETECTIONS = f"""detections AS (
  SELECT least(l_suppkey, other) AS primary_object_id, greatest(l_suppkey, other) AS secondary_object_id,
    {EPOCH_BASE_US} + date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 300000000
      + l_quantity::BIGINT * 1000000 AS tca_us,
    l_extendedprice / 1000.0::DOUBLE AS miss_distance_km, l_discount AS relative_velocity_km_s,
    l_tax AS delta_t_seconds, 'numerical-propagation' AS method
  FROM (SELECT *, 20 * l_linenumber AS other FROM lineitem) WHERE l_suppkey <> other
)"""


def detections(spark, folder):
    """Detections of supplier pairs; which one comes first varies."""
    lines = V.table(spark, folder, "lineitem").withColumn("other", (F.col("l_linenumber") * 20).cast("bigint"))
    first = F.col("l_quantity") > 25
    return lines.filter(F.col("l_suppkey") != F.col("other")).select(
        F.when(first, F.col("l_suppkey")).otherwise(F.col("other")).alias("primary_object_id"),
        F.when(first, F.col("other")).otherwise(F.col("l_suppkey")).alias("secondary_object_id"),
        (V.epoch_us("l_shipdate") + F.col("l_quantity").cast("bigint") * 1_000_000).alias("tca_us"),
        (F.col("l_extendedprice") / 1000.0).alias("miss_distance_km"),
        F.col("l_discount").alias("relative_velocity_km_s"),
        F.col("l_tax").alias("delta_t_seconds"),
        F.lit("numerical-propagation").alias("method"),
    )


@query(
    with_views(DETECTIONS)
    + """, numbered AS (SELECT *, sum(CASE WHEN gap <= 600000000 THEN 0 ELSE 1 END) OVER (
        PARTITION BY primary_object_id, secondary_object_id
        ORDER BY tca_us, miss_distance_km, relative_velocity_km_s, delta_t_seconds ROWS UNBOUNDED PRECEDING) AS episode
      FROM (SELECT *, tca_us - lag(tca_us) OVER (PARTITION BY primary_object_id, secondary_object_id
        ORDER BY tca_us, miss_distance_km, relative_velocity_km_s, delta_t_seconds) AS gap FROM detections))
    SELECT * EXCLUDE (episode, gap, n) FROM (SELECT *, count(*) OVER w AS merged, row_number() OVER (w ORDER BY
        miss_distance_km, tca_us, relative_velocity_km_s, delta_t_seconds) AS n
      FROM numbered WINDOW w AS (PARTITION BY primary_object_id, secondary_object_id, episode)) WHERE n = 1"""
)
def episodes(spark, folder):
    return E.merge_episodes(detections(spark, folder), E.within_gap(600))


STRAIGHT_GAPS = f"""gaps AS (
  SELECT o_orderkey AS primary_object_id, o_orderkey + 1 AS secondary_object_id,
    {EPOCH_BASE_US} AS from_us,
    {EPOCH_BASE_US} + (1 + round(o_totalprice * 100)::BIGINT % 120) * 1000000 AS to_us FROM orders
), lines AS (
  SELECT o_orderkey AS object_id, 7000.123::DOUBLE + (o_orderkey * 31 % 101) * 0.37::DOUBLE AS x0,
    (o_orderkey * 17 % 97) * 0.41::DOUBLE AS y0, (o_orderkey * 13 % 89) * 0.29::DOUBLE AS z0,
    (o_orderkey * 7 % 23 - 11) * 0.0131::DOUBLE AS vx, (o_orderkey * 5 % 19 - 9) * 0.0173::DOUBLE AS vy,
    (o_orderkey * 3 % 17 - 8) * 0.0151::DOUBLE AS vz FROM orders
)"""


@query(
    with_views(STRAIGHT_GAPS)
    + """SELECT primary_object_id, secondary_object_id, greatest(d0, d1) <= 25 AS linked FROM (
      SELECT g.*, (to_us - from_us) / 1000000.0::DOUBLE AS t,
        sqrt((b.x0 - a.x0) ** 2 + (b.y0 - a.y0) ** 2 + (b.z0 - a.z0) ** 2) AS d0,
        sqrt((b.x0 - a.x0 + (b.vx - a.vx) * t) ** 2 + (b.y0 - a.y0 + (b.vy - a.vy) * t) ** 2
          + (b.z0 - a.z0 + (b.vz - a.vz) * t) ** 2) AS d1
      FROM gaps g JOIN lines a ON a.object_id = primary_object_id JOIN lines b ON b.object_id = secondary_object_id)"""
)
def continuity(spark, folder):
    """Straight paths: the distance is convex, so the ends alone tell the truth."""
    check, gaps = _straight_check(spark, folder)
    return check(gaps).select("primary_object_id", "secondary_object_id", "linked")


def _straight_check(spark, folder, work=None):
    orders, k = V.table(spark, folder, "orders"), F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    model = StraightLine()
    lines = model.prepare(
        orders.select(
            k.alias("object_id"),
            F.timestamp_micros(F.lit(EPOCH_BASE_US)).alias("epoch"),
            (7000.123 + (k * 31 % 101) * 0.37).alias("x0"),
            ((k * 17 % 97) * 0.41).alias("y0"),
            ((k * 13 % 89) * 0.29).alias("z0"),
            ((k * 7 % 23 - 11) * 0.0131).alias("vx0"),
            ((k * 5 % 19 - 9) * 0.0173).alias("vy0"),
            ((k * 3 % 17 - 8) * 0.0151).alias("vz0"),
        )
    )
    gaps = orders.select(
        k.alias("primary_object_id"),
        (k + 1).alias("secondary_object_id"),
        F.lit(EPOCH_BASE_US).alias("from_us"),
        (EPOCH_BASE_US + (1 + cents % 120) * 1_000_000).alias("to_us"),
    )

    def elements_of(rows):
        for side, key in (("a", "primary_object_id"), ("b", "secondary_object_id")):
            named = lines.select(
                F.col("object_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in model.columns]
            )
            rows = rows.join(named, key)
        return rows

    return E.certified_continuity(elements_of, model, threshold_km=25.0, work=work), gaps


@query(
    "WITH RECURSIVE " + with_views(STRAIGHT_GAPS).removeprefix("WITH ")
    + f""", paths AS (
      SELECT primary_object_id AS k, to_us - from_us AS w, b.x0 - a.x0 AS x, b.y0 - a.y0 AS y, b.z0 - a.z0 AS z,
        (b.vx - a.vx) / 1e6 AS vx, (b.vy - a.vy) / 1e6 AS vy, (b.vz - a.vz) / 1e6 AS vz
      FROM gaps g JOIN lines a ON a.object_id = primary_object_id JOIN lines b ON b.object_id = secondary_object_id),
    frontier(k, l, r) AS (
      SELECT k, 0::BIGINT, w FROM paths
      UNION ALL
      SELECT k, CASE side WHEN 0 THEN l ELSE m END, CASE side WHEN 0 THEN m ELSE r END FROM (
        SELECT f.*, l + (r - l) // 2 AS m, (x + vx * l) ** 2 + (y + vy * l) ** 2 + (z + vz * l) ** 2 AS dl,
          (x + vx * r) ** 2 + (y + vy * r) ** 2 + (z + vz * r) ** 2 AS dr
        FROM frontier f JOIN paths USING (k)), (SELECT unnest([0, 1]) AS side)
      WHERE sqrt(greatest(dl, dr)) <= 25 AND r - l > 10000
        AND sqrt(greatest(dl, dr)) + {BOUND} * ((r - l) / 1e6) ** 2 / 8e0 + 1e-9 > 25)
    SELECT (SELECT count(*) FROM paths) AS episode_checks,
      4 * (SELECT count(*) FROM paths) + (count(*) - (SELECT count(*) FROM paths)) AS episode_propagations FROM frontier"""
)
def continuity_counts(spark, folder):
    """Gaps judged and propagations spent: both ends, and one time per halving."""
    work = []
    check, gaps = _straight_check(spark, folder, work)
    check(gaps)
    return E.continuity_work(spark, work)
