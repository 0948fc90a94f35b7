"""Queries: propagation with the general perturbation model.

The oracle writes the model's formulas out as nested SELECTs, without structs, arrays or
lambda functions; that the formulas are right is a matter of published states, which the
tests compare with.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from skyframe.functions import sgp4 as G
from skyframe.functions.orbit import STATE
from skyframe.operators import propagation as P
from skyframe.operators import selection as Sel
from skyframe.session import spread
from skyframe.workload import views as V
from skyframe.workload.registry import query
from skyframe.workload.screening import HORIZON, LATEST, STATE_NAMES, STEP, nested
from skyframe.workload.selection import STATUS
from skyframe.workload.views import ELEMENTS, NOW_US, with_views

MODEL = G.Sgp4()
#: Whole steps of the resonance integration that an element of 72 hours needs.
MOST_STEPS = 6


def wide_elements(spark, folder):
    """The elements with orbits of all kinds: a fifth each synchronous (some nearly equatorial),
    half a day long and eccentric, and of other long periods."""
    c = F.floor((F.col("object_id") - 10000) / 2)
    kind = c % 5
    return V.elements(spark, folder).withColumns(
        {
            "mean_motion": F.when(kind == 0, 1.0027 + (c % 13) / 10000.0)
            .when(kind == 1, 2.0056 + (c % 17) / 10000.0)
            .when(kind == 2, 4.0 + (c % 29) / 10.0)
            .otherwise(F.col("mean_motion")),
            "eccentricity": F.when(kind == 1, 0.5 + (c % 23) / 100.0)
            .when(kind == 2, (c % 9) * 0.05)
            .otherwise(F.col("eccentricity")),
            "inclination": F.when(kind == 0, (c % 20) + 0.5).otherwise(F.col("inclination")),
        }
    )


WIDE = """wide AS (
  SELECT * EXCLUDE (c, mean_motion, eccentricity, inclination),
    CASE c % 5 WHEN 0 THEN 1.0027e0 + (c % 13) / 10000.0e0 WHEN 1 THEN 2.0056e0 + (c % 17) / 10000.0e0
      WHEN 2 THEN 4.0e0 + (c % 29) / 10.0e0 ELSE mean_motion END AS mean_motion,
    CASE c % 5 WHEN 1 THEN 0.5e0 + (c % 23) / 100.0e0 WHEN 2 THEN (c % 9) * 0.05e0 ELSE eccentricity END AS eccentricity,
    CASE c % 5 WHEN 0 THEN (c % 20) + 0.5e0 ELSE inclination END AS inclination
  FROM (SELECT *, (object_id - 10000) // 2 AS c FROM elements)
)"""


GIVEN = {"e", "n_mean", "inc", "nodeo", "argpo", "mo", "bstar", "days_1950", "t", "xli", "xni", "whole_steps"}


def _levels(steps, mark, before=()):
    """SELECT lists of the levels of ``steps``, which may read the steps ``before``."""
    names = GIVEN | {name for name, _ in [*before, *steps]}
    return [", ".join(f"{G.written(x, names, mark, 'i_', 'd_')} AS {mark}{name}" for name, x in level) for level in G.levels(steps)]


def constants_sql(name: str, source: str, kept: str) -> str:
    """The model's constants of the rows of ``source``."""
    fine = "eccentricity >= 0 AND eccentricity < 1 AND mean_motion > 0"
    body = nested(
        source,
        f"""CASE WHEN {fine} THEN eccentricity END AS i_e, CASE WHEN {fine} THEN mean_motion * {2 * pi / 1440!r}::DOUBLE END AS i_n_mean,
    radians(inclination) AS i_inc, radians(ra_of_asc_node) AS i_nodeo, radians(arg_of_pericenter) AS i_argpo,
    radians(mean_anomaly) AS i_mo, coalesce(bstar, 0::DOUBLE) AS i_bstar, epoch_us(epoch) / 8.64e10 + 7306e0 AS i_days_1950""",
        *_levels(G.steps_of(G.NEAR_CONSTANTS) + G.steps_of(G.DEEP_CONSTANTS), "i_"),
    )
    deep = ", ".join(f"CASE WHEN i_deep = 1 THEN i_{c} END AS d_{c}" for c in G.DEEP)
    near = ", ".join(f"i_{c}" for c in G.NEAR)
    return f"{name} AS MATERIALIZED (SELECT {kept}, {near}, {deep} FROM {body})"


def model_states_sql(name: str, source: str, kept: str) -> str:
    """States of the rows of ``source`` (constants, ``epoch`` and ``at_us``)."""
    first = G.steps_of(G.SECULAR)
    last = G.steps_of(G.RESONANCE + G.LONG_PERIOD + G.KEPLER + G.SHORT_PERIOD)
    walk = ["CASE WHEN d_irez > 0 THEN floor(abs(t_t) / 720e0) END AS t_whole_steps, d_xlamo AS w0, i_no AS v0"]
    for i in range(MOST_STEPS):
        longitude, motion = (
            G.written(x.replace("width", "t_width"), set(), "", "i_", "d_") for x in G.next_longitude(f"w{i}", f"v{i}", f"({i} * width)")
        )
        inside = f"CASE WHEN t_whole_steps > {i} THEN"
        walk.append(f"{inside} {longitude} ELSE w{i} END AS w{i + 1}, {inside} {motion} ELSE v{i} END AS v{i + 1}")
    body = nested(
        source,
        "(at_us - epoch_us(epoch)) / 6e7 AS t_t",
        *_levels(first, "t_"),
        *walk,
        f"w{MOST_STEPS} AS t_xli, CASE WHEN d_irez > 0 THEN v{MOST_STEPS} END AS t_xni",
        *_levels(last, "t_", first),
    )
    names = {n for n, _ in first + last}
    fields = ", ".join(f"{G.written(x, names, 't_', 'i_', 'd_')} AS {f}" for f, x in G.FIELDS.items())
    return f"{name} AS MATERIALIZED (SELECT {kept}, at_us, {fields}, {G.error_text('t_code')} AS error FROM {body})"


def rounded(name: str):
    """To four places, without a negative zero."""
    return F.round(name, 4) + F.lit(0.0)


def rounded_sql(name: str) -> str:
    return f"CASE WHEN round({name}, 4) = 0 THEN 0e0 ELSE round({name}, 4) END"


def latest(spark, folder):
    return Sel.latest_by_source(wide_elements(spark, folder), "celestrak")


LATEST_WIDE = LATEST.replace("FROM elements", "FROM wide")
CONSTANTS = constants_sql("constants", "latest", "object_id, element_id, epoch")
ONCE = f"at_now AS (SELECT *, {NOW_US} AS at_us FROM constants)"
ONCE_STATES = model_states_sql("now_states", "at_now", "object_id, element_id, epoch")


@query(
    with_views(ELEMENTS, WIDE, LATEST_WIDE, CONSTANTS, ONCE, ONCE_STATES)
    + "SELECT object_id, element_id, 'TEME' AS frame, live AND error IS NULL AS success, "
    + f"({NOW_US} - epoch_us(epoch)) / 1000000.0::DOUBLE AS ephemeris_age_seconds, {STATUS} AS ephemeris_status, "
    + ", ".join(f"CASE WHEN success THEN {rounded_sql(c)} END AS {n}" for c, n in STATE_NAMES.items())
    + f""", CASE WHEN NOT live THEN 'ExpiredEphemeris' WHEN error IS NOT NULL THEN 'PropagationError' END AS error_type,
      CASE WHEN NOT live THEN printf('Orbital element age %.2fh exceeds maximum %.2fh',
        ({NOW_US} - epoch_us(epoch)) / 3600000000.0::DOUBLE, 72.0::DOUBLE) ELSE error END AS error_message
    FROM (SELECT *, {NOW_US} - epoch_us(epoch) <= 72 * 3600000000 AS live FROM now_states)"""
)
def perturbed_states(spark, folder):
    """H3 with the full model, deep space and resonance included."""
    states = P.propagate_once(latest(spark, folder), V.now(), MODEL).drop("target_time")
    return states.withColumns({n: rounded(n) for n in STATE_NAMES.values()})


GRID = f"""on_grid AS (
  SELECT *, unnest(range(0, {HORIZON // STEP + 1})) AS sample_index, {NOW_US} + sample_index * {STEP}000000 AS at_us FROM constants
), live_grid AS (SELECT * FROM on_grid WHERE at_us - epoch_us(epoch) <= 72 * 3600000000)"""
GRID_STATES = model_states_sql("model_states", "live_grid", "object_id, sample_index")


@query(
    with_views(ELEMENTS, WIDE, LATEST_WIDE, CONSTANTS, GRID, GRID_STATES)
    + "SELECT object_id, sample_index::INTEGER AS sample_index, at_us AS sample_us, "
    + ", ".join(f"CASE WHEN error IS NULL THEN {rounded_sql(c)} END AS {c}" for c in STATE)
    + ", error FROM model_states"
)
def perturbed_grid(spark, folder):
    """H4 with the full model over the screening grid."""
    # Not by the key of the latest elements: that exchange would do, and its parts are merged.
    elements = spread(latest(spark, folder), "object_id", "element_id")
    gridded = P.on_grid(MODEL.prepare(elements), V.NOW, HORIZON, STEP)
    states = P.propagate_grid(gridded, MODEL)
    return states.withColumns({c: F.when(F.col("error").isNull(), rounded(c)) for c in STATE})


@query(
    with_views(ELEMENTS, WIDE, LATEST_WIDE, CONSTANTS, ONCE, ONCE_STATES)
    + """SELECT CASE WHEN d_irez IS NULL THEN 'near' WHEN d_irez = 0 THEN 'deep' WHEN d_irez = 1 THEN 'synchronous' ELSE 'half day' END AS regime,
      error, count(*) AS objects, round(avg(r), 4) AS mean_radius_km
    FROM (SELECT object_id, CASE WHEN error IS NULL THEN sqrt(x * x + y * y + z * z) END AS r, error FROM now_states
      WHERE at_us - epoch_us(epoch) <= 72 * 3600000000)
    JOIN (SELECT object_id, d_irez FROM constants) USING (object_id) GROUP BY ALL"""
)
def perturbed_regimes(spark, folder):
    """Live objects and their mean distance by the kind of orbit, refusals apart."""
    rows = MODEL.prepare(latest(spark, folder)).withColumn("at_us", F.lit(V.NOW_US))
    live = rows.filter(F.col("at_us") - F.unix_micros("epoch") <= 72 * 3_600_000_000)
    states = MODEL.state_at(live, "at_us")
    irez = F.col("k_deep.irez")
    regime = F.when(irez.isNull(), "near").when(irez == 0, "deep").when(irez == 1, "synchronous").otherwise("half day")
    radius = F.when(F.col("error").isNull(), F.sqrt(F.expr("x * x + y * y + z * z")))
    return states.groupBy(regime.alias("regime"), "error").agg(
        F.count("*").alias("objects"), F.round(F.avg(radius), 4).alias("mean_radius_km")
    )
