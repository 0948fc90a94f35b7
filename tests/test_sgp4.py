"""The perturbation model against published states of its reference runs."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skyframe.functions.sgp4 import Sgp4
from skyframe.operators.propagation import propagate_once
from skyframe.plans.screening_run import ScreeningOptions, run_screening

# Published test cases: epoch (year, day), inclination, node, eccentricity, perigee, anomaly,
# revolutions a day, drag; and states by minutes after the epoch.
CASES = {
    5: (2000, 179.78495062, 34.2682, 348.7242, 0.1859667, 331.7664, 19.3264, 10.82419157, 0.28098e-4),
    88888: (1980, 275.98708465, 72.8435, 115.9689, 0.0086731, 52.6988, 110.5714, 16.05824518, 0.66816e-4),
    11801: (1980, 230.29629788, 46.7916, 230.4354, 0.7318036, 47.4722, 10.4117, 2.28537848, 0.14311e-1),
    8195: (2006, 176.33215444, 64.1586, 279.0717, 0.6877146, 264.7651, 20.2257, 2.00491383, 0.11873e-3),
    24208: (2006, 177.04061740, 3.8536, 80.0121, 0.0026640, 311.0977, 48.3000, 1.00778054, 0.10000e-3),
}
STATES = {
    (5, 0): (7022.46529266, -1400.08296755, 0.03995155, 1.893841015, 6.405893759, 4.534807250),
    (5, 360): (-7154.03120202, -3783.17682504, -3536.19412294, 4.741887409, -4.151817765, -2.093935425),
    (5, 1440): (-938.55923943, -6268.18748831, -4294.02924751, 7.536105209, -0.427127707, 0.989878080),
    (5, 4320): (-9060.47373569, 4658.70952502, 813.68673153, -2.232832783, -4.110453490, -3.157345433),
    (88888, 0): (2328.96975262, -5995.22051338, 1719.97297192, 2.912073281, -0.983417956, -7.090816210),
    (88888, 120): (1020.69234558, 2286.56260634, -6191.55565927, -3.746543902, 6.467532721, 1.827985678),
    (11801, 0): (7473.37102491, 428.94748312, 5828.74846783, 5.107155391, 6.444680305, -0.186133297),
    (11801, 360): (-3305.22148694, 32410.84323331, -24697.16974954, -1.301137319, -1.151315600, -0.283335823),
    (11801, 720): (14271.29083858, 24110.44309009, -4725.76320143, -0.320504528, 2.679841539, -2.084054355),
    (11801, 1080): (-9990.05800009, 22717.34212448, -23616.88515553, -1.016674392, -2.290267981, 0.728923337),
    (11801, 1440): (9787.87836256, 33753.32249667, -15030.79874625, -1.094251553, 0.923589906, -1.522311008),
    (8195, 120): (15223.91713658, -17852.95881713, 25280.39558224, 1.079041732, 0.875187372, 2.485682813),
    (8195, 360): (19089.29762968, 3107.89495018, 39958.14661370, -0.410308034, 1.640332277, -0.306873818),
    (8195, 720): (2622.13222207, -15125.15464924, 474.51048398, 2.688287199, -3.078426664, 4.494979530),
    (8195, 1440): (2890.80638268, -15446.43952300, 948.77010176, 2.654407490, -2.909344895, 4.486437362),
    (24208, 0): (7534.10987189, 41266.39266843, -0.10801028, -3.027168008, 0.558848996, 0.207982755),
    (24208, 720): (-6874.77975542, -41530.38329422, -46.60245459, 3.027415087, -0.494671177, -0.207337260),
    (24208, 1080): (41365.67576837, -6298.09965811, -2828.05254033, 0.459741276, 3.051680214, 0.006431872),
    (24208, 1440): (5501.08137100, 41590.27784405, 138.32522930, -3.050691874, 0.409203052, 0.207958133),
}
SCHEMA = (
    "object_id long, epoch timestamp, inclination double, ra_of_asc_node double, eccentricity double, "
    "arg_of_pericenter double, mean_anomaly double, mean_motion double, bstar double"
)


def element(number, year, day, *rest):
    epoch = datetime(year, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=round((day - 1) * 86_400e6))
    return (number, epoch, *rest)


@pytest.fixture(scope="module")
def published(spark):
    elements = spark.createDataFrame([element(k, *v) for k, v in CASES.items()], SCHEMA)
    rows = Sgp4().prepare(elements)
    minutes = sorted({m for _, m in STATES})
    return rows.withColumn("minute", F.explode(F.array(*map(F.lit, minutes)))).withColumn("at", F.col("k_epoch_us") + F.col("minute").cast("long") * 60_000_000)


def test_published_states(published):
    found = {(r["object_id"], r["minute"]): r for r in Sgp4().state_at(published, "at").collect()}
    for key, want in STATES.items():
        row = found[key]
        assert row["error"] is None
        assert [row[c] for c in "xyz"] == pytest.approx(want[:3], abs=1e-6, rel=0)
        assert [row["v" + c] for c in "xyz"] == pytest.approx(want[3:], abs=1e-8, rel=0)


def test_names_and_plan(published):
    renamed = published.select("minute", "at", *[F.col(c).alias(f"a_{c}") for c in Sgp4.columns])
    states = Sgp4().state_at(renamed, "at", prefix="a_", out="p_")
    assert states.columns == [*renamed.columns, *[f"p_{c}" for c in ("x", "y", "z", "vx", "vy", "vz", "error")]]
    near = states.filter("p_z > 0 AND minute = 0")
    assert near.count() == 4
    assert "Python" not in near._jdf.queryExecution().toString()


def test_velocity_is_the_change_of_position(published):
    """Central differences over 2 ms, after the published minutes and before the epoch. The
    model's velocity leaves out slow changes, so it is near the derivative, not equal."""
    model = Sgp4()
    for shift in (0, -5_000 * 60_000_000):
        rows = published.withColumn("mid", F.col("at") + shift)
        rows = model.state_at(rows, "mid")
        for name, step in (("l", -1000), ("r", 1000)):
            rows = model.state_at(rows.withColumn(f"at_{name}", F.col("mid") + step), f"at_{name}", out=f"{name}_")
        for r in rows.filter("error IS NULL AND l_error IS NULL AND r_error IS NULL").collect():
            for axis in "xyz":
                change = (r[f"r_{axis}"] - r[f"l_{axis}"]) / 0.002
                assert change == pytest.approx(r[f"v{axis}"], abs=2e-2)


def test_refusals_are_rows(spark):
    year, day, *rest = CASES[5]
    inc, node, ecc, peri, anomaly, motion, drag = rest
    cases = [
        (1, inc, node, 1.5, peri, anomaly, motion, drag),
        (2, inc, node, None, peri, anomaly, motion, drag),
        (3, inc, node, ecc, peri, anomaly, 0.0, drag),
        (4, inc, node, 0.0, peri, anomaly, 17.6, drag),
        (6, inc, node, ecc, peri, anomaly, motion, None),
        (7, inc, node, 0.05, peri, anomaly, 15.9, 5.0),
    ]
    elements = spark.createDataFrame([element(c[0], year, day, *c[1:]) for c in cases], SCHEMA).withColumn("element_id", F.col("object_id"))
    at = F.timestamp_micros(F.unix_micros("epoch") + 3_600_000_000)
    rows = {r["object_id"]: r for r in propagate_once(elements, at, Sgp4()).collect()}
    codes = {k: r["error_message"] and int(r["error_message"].split("(")[1][0]) for k, r in rows.items()}
    assert codes == {1: 1, 2: 1, 3: 1, 4: 6, 6: None, 7: codes[7]}
    assert codes[7] in (1, 4, 6)
    assert all((r["position_x_km"] is None) == (r["error_message"] is not None) for r in rows.values())
    assert all(r["success"] == (r["error_type"] is None) for r in rows.values())


def test_screening_with_the_model(spark):
    """Two objects half a kilometre apart in one orbit are one encounter; a third is alone."""
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    orbit = (51.6, 10.0, 0.001, 20.0)
    rows = [(i, i, "celestrak", start, *orbit, anomaly, 15.5, None, None, 1e-5) for i, anomaly in ((1, 30.0), (2, 30.004), (3, 200.0))]
    elements = spark.createDataFrame(
        rows,
        "element_id long, object_id long, source string, epoch timestamp, inclination double, ra_of_asc_node double, eccentricity double, "
        "arg_of_pericenter double, mean_anomaly double, mean_motion double, mean_motion_dot double, mean_motion_ddot double, bstar double",
    )
    objects = spark.createDataFrame([(i, "PAYLOAD", True) for i in (1, 2, 3)], "id long, object_type string, is_earth_orbit boolean")
    options = ScreeningOptions(start=start, horizon_seconds=600, step_seconds=60, distance_km=10.0, source="celestrak")
    result = run_screening(elements, objects, options, Sgp4())
    events = result.events.collect()
    assert [(e["primary_object_id"], e["secondary_object_id"]) for e in events] == [(1, 2)]
    assert 0.3 < events[0]["miss_distance_km"] < 0.7
    counters = result.counters.first()
    assert counters["propagation_attempts"] == 33 and counters["propagation_failures"] == 0


def test_the_grid_is_worked_out_in_more_parts_than_cores(spark):
    from skyframe.workload import perturbed

    rows = perturbed.perturbed_grid(spark, "/root/testdata/sf0.001")
    parts = rows.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) > 2 * spark.sparkContext.defaultParallelism
