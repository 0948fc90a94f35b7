"""Pair search, refinement, episodes and whole runs on small scenes."""

import random
from datetime import datetime, timedelta, timezone
from math import dist

import pytest
from pyspark.sql import functions as F

from skyframe.functions.motion import inflated_radius_km
from skyframe.functions.orbit import KeplerJ2, StraightLine
from skyframe.operators import episodes as E
from skyframe.operators import propagation as P
from skyframe.operators import screening as S
from skyframe.operators.spatial import fixed_radius_pairs
from skyframe.plans.screening_run import ScreeningOptions, run_screening, run_tables
from skyframe.sources.tables import check_unique, read_run_rows, write_run

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
US = P.utc_micros(START)
STATES = "sample_us long, object_id long, x double, y double, z double, vx double, vy double, vz double"


def states(spark, rows):
    return spark.createDataFrame([(US, *r, *([0.0] * (7 - len(r)))) for r in rows], STATES)


def pair_list(df):
    return sorted((r.a_object_id, r.b_object_id, r.separation_km) for r in df.collect())


def test_radius_is_inclusive_and_pairs_are_ordered(spark):
    scene = states(spark, [(3, 100.0, 0.0, 0.0), (2, 3.0, 4.0, 0.0), (1, 0.0, 0.0, 0.0)])
    assert pair_list(fixed_radius_pairs(scene, 10.0)) == [(1, 2, 5.0)]
    assert pair_list(fixed_radius_pairs(scene, 5.0)) == [(1, 2, 5.0)]
    line = states(spark, [(i, float(i - 1), 0.0, 0.0) for i in (1, 2, 3)])
    assert [p[:2] for p in pair_list(fixed_radius_pairs(line, 5.0))] == [(1, 2), (1, 3), (2, 3)]
    with pytest.raises(ValueError):
        fixed_radius_pairs(line, 0.0)


@pytest.mark.parametrize("hot", [None, 5, 10_000])
def test_pairs_equal_brute_force_with_a_crowded_cube(spark, hot):
    rng = random.Random(7)
    crowd = [tuple(rng.uniform(0, 9) for _ in range(3)) for _ in range(60)]
    rest = [tuple(rng.uniform(-60, 60) for _ in range(3)) for _ in range(120)]
    points = list(enumerate(crowd + rest))
    scene = states(spark, [(i, *p) for i, p in points])
    expected = sorted((i, j) for i, p in points for j, q in points if i < j and dist(p, q) <= 10.0)
    found = fixed_radius_pairs(scene, 10.0, hot_cell_rows=hot)
    assert sorted((r.a_object_id, r.b_object_id) for r in found.collect()) == expected


def test_few_copies_of_a_row_are_sent_to_neighbours(spark):
    from skyframe.operators import spatial

    rows = spark.range(20_000).select(*[(F.rand(i) * 1000).alias(c) for i, c in enumerate("xyz")])
    edge = spatial.EDGE_RADII * 10.0
    copies = spatial._half_neighbourhood(spatial._cells(rows, edge), edge, 10.0).count() / 20_000
    assert 1 <= copies < 4.5


def test_pairs_never_plan_a_nested_loop(spark):
    scene = states(spark, [(i, float(i), 0.0, 0.0) for i in range(10)])
    plan = fixed_radius_pairs(scene, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_linear_approach(spark):
    rows = [(0.0,) * 6 + (10.0, 1.0, 0.0, -1.0, 0.0, 0.0), (0.0,) * 6 + (5.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    names = [f"{s}_{k}{a}" for s in "ab" for k in ("", "v") for a in "xyz"]
    pairs = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = [
        (r.delta_t_seconds, r.miss_distance_km, r.relative_velocity_km_s)
        for r in S.linear_approach(pairs, 60.0).collect()
    ]
    assert got == [(10.0, 1.0, 1.0), (0.0, 5.0, 0.0)]
    with pytest.raises(ValueError):
        S.linear_approach(pairs, 0.0)


def test_best_sample_is_the_earliest_of_equals(spark):
    rows = [(1, 2, 5.0, 30), (1, 2, 5.0, 10), (1, 2, 6.0, 5)]
    df = spark.createDataFrame(rows, "a_object_id long, b_object_id long, separation_km double, sample_us long")
    best = S.best_per_pair(df, ("a_object_id", "b_object_id"), ()).first()
    assert (best.sample_us, best.detections) == (10, 3)


def test_inflated_radius():
    assert inflated_radius_km(10, 60, 16) == 490.0
    for bad in ((0, 60, 16), (10, 0, 16), (10, 60, 0)):
        with pytest.raises(ValueError):
            inflated_radius_km(*bad)


@pytest.mark.parametrize(
    "horizon, slices",
    [
        (60, [(0, 1)]), (899, [(0, 15)]), (900, [(0, 15)]), (901, [(0, 15), (15, 16)]),
        (1800, [(0, 15), (15, 30)]), (3600, [(0, 15), (15, 30), (30, 45), (45, 60)]),
    ],
)
def test_chunks_share_one_sample(spark, horizon, slices):
    last = P.sample_count(horizon, 60) - 1
    chunk = F.explode(P.chunks_of_sample(F.col("id"), P.chunk_intervals(60, 900), last)).alias("chunk")
    rows = spark.range(last + 1).select("id", chunk).groupBy("chunk").agg(F.min("id"), F.max("id"))
    assert [tuple(r)[1:] for r in rows.orderBy("chunk").collect()] == slices


def test_chunk_and_sample_arguments():
    for bad in ((60, 30), (60, 100), (0, 60)):
        with pytest.raises(ValueError):
            P.chunk_intervals(*bad)
    for bad in ((0, 60), (60, 0), (30, 60)):
        with pytest.raises(ValueError):
            P.sample_count(*bad)
    with pytest.raises(ValueError):
        P.utc_micros(datetime(2026, 1, 1))


LINES = (
    "element_id long, object_id long, source string, epoch timestamp, x0 double, y0 double, z0 double, "
    "vx0 double, vy0 double, vz0 double"
)


class Scene(StraightLine):
    """Straight lines that carry the fields a fingerprint reads."""

    def prepare(self, elements):
        for name in S.FINGERPRINT[2:]:
            elements = elements.withColumn(name, F.col("object_id").cast("double"))
        return super().prepare(elements)


def scene_elements(spark, rows):
    return spark.createDataFrame([(100 + r[0], r[0], "celestrak", START, *r[1:]) for r in rows], LINES)


def objects(spark, ids):
    return spark.createDataFrame([(i, True, "PAYLOAD") for i in ids], "id long, is_earth_orbit boolean, object_type string")


CROSSING = [(1, 7000.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 7075.0, 1.0, 0.0, -1.0, 0.0, 0.0)]


def options(**changes):
    base = dict(start=START, horizon_seconds=120, step_seconds=60, chunk_seconds=60, distance_km=2.0)
    return ScreeningOptions(**(base | changes))


@pytest.mark.parametrize("chunk", [60, 120])
def test_boundary_encounter_is_one_event_in_any_chunking(spark, chunk):
    result = run_screening(
        scene_elements(spark, CROSSING), objects(spark, [1, 2]), options(chunk_seconds=chunk), Scene(6378.0)
    )
    (event,) = result.events.collect()
    assert (event.primary_object_id, event.secondary_object_id) == (1, 2)
    assert (event.primary_element_id, event.secondary_element_id) == (101, 102)
    assert abs((event.tca_us - US) / 1e6 - 75) < 0.01 and abs(event.miss_distance_km - 1.0) < 1e-6
    counters = result.counters.first()
    assert counters.event_count == 1 and counters.duplicate_events_suppressed == (1 if chunk == 60 else 0)
    assert (counters.samples, counters.objects, counters.propagation_attempts) == (3, 2, 6)
    assert counters.raw_candidates == (4 if chunk == 60 else 3)


def test_shared_solutions_are_suppressed_and_budgets_hold(spark):
    class Shared(Scene):
        def prepare(self, elements):
            elements = super().prepare(elements)
            for name in S.FINGERPRINT[2:]:
                elements = elements.withColumn(name, F.lit(1.0))
            return elements

    args = scene_elements(spark, CROSSING), objects(spark, [1, 2])
    result = run_screening(*args, options(), Shared(6378.0))
    counters = result.counters.first()
    assert result.events.count() == 0
    assert (counters.suppressed_shared_pairs, counters.shared_solution_groups) == (2, 1)
    for limit in ({"max_objects": 1}, {"max_propagations": 5}, {"max_chunk_unique_candidates": 0}):
        with pytest.raises(ValueError):
            run_screening(*args, options(**limit), Scene(6378.0))


def test_run_is_written_once_however_often(spark, work):
    result = run_screening(scene_elements(spark, CROSSING), objects(spark, [1, 2]), options(), Scene(6378.0))
    events, header = run_tables(result, options(), 7, START, START + timedelta(seconds=5), 5000.0)
    for _ in range(2):
        write_run(check_unique(events, ["run_id", "event_id"]), header, work, "events", "runs")
    stored = read_run_rows(spark, work, "events", "runs").collect()
    assert len(stored) == 1 and stored[0].run_id == 7
    with pytest.raises(ValueError):
        check_unique(events.unionByName(events), ["event_id"])


def gaps(spark, seconds):
    return spark.createDataFrame(
        [(1, 2, US, US + int(seconds * 1e6))],
        "primary_object_id long, secondary_object_id long, from_us long, to_us long",
    )


class Bowed(StraightLine):
    """Side b at distance ``x0 + bow * t * (60 - t)`` from side a."""

    def state_at(self, df, at_us, prefix="", out=""):
        df = super().state_at(df, at_us, prefix, out)
        t = (F.col(at_us) - US) / 1e6
        bow = F.col(prefix + "vy0")
        return df.withColumn(f"{out}x", F.col(f"{out}x") + bow * t * (60 - t)).withColumn(
            f"{out}vx", bow * (60 - 2 * t)
        ).withColumn(f"{out}vy", F.lit(0.0))


def continuity(spark, distance, threshold, bow=0.0, bound=0.03, work=None):
    model = Bowed()
    rows = scene_elements(spark, [(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, distance, 0.0, 0.0, 0.0, bow, 0.0)])
    prepared = model.prepare(rows)

    def elements_of(df):
        for side, key in (("a", "primary_object_id"), ("b", "secondary_object_id")):
            df = df.join(
                prepared.select(F.col("object_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in model.columns]),
                key,
            )
        return df

    check = E.certified_continuity(elements_of, model, threshold_km=threshold, bound_km_s2=bound, work=work)
    return check(gaps(spark, 60)).first().linked


def test_continuity_sees_an_exit_between_inside_ends(spark):
    assert continuity(spark, 1.0, 2.0, bow=0.01) is False


def test_continuity_proves_a_bounded_path(spark):
    assert continuity(spark, 1.0, 20.0, bow=0.01) is True


def test_continuity_halves_only_open_intervals(spark):
    """An exit at the first middle ends the work of a gap; a proof needs as many halvings as
    the bound asks for: 60 s in four parts of 15 s, as 0.03 * 15 ** 2 / 8 is below 1."""
    work = []
    assert continuity(spark, 1.0, 2.0, bow=0.01, work=work) is False
    assert work == [{"checks": 1, "propagations": 4 + 2}]
    work = []
    assert continuity(spark, 1.0, 2.0, work=work) is True
    assert work == [{"checks": 1, "propagations": 4 + 2 * 3}]
    work = []
    assert continuity(spark, 30.0, 2.0, work=work) is False
    assert work == [{"checks": 1, "propagations": 4}]


def test_an_exit_ends_all_intervals_of_its_gap(spark, monkeypatch):
    """The pair leaves for a moment near 3/4 of the gap; a round later nothing is open."""
    monkeypatch.setattr(E, "HALVINGS_A_ROUND", 1)
    work = []
    assert continuity(spark, 9.98, 10.0, bow=0.00003, work=work) is False
    assert work[0]["propagations"] < 200


def test_unresolved_continuity_fails(spark):
    with pytest.raises(Exception, match="continuity"):
        continuity(spark, 10.0, 10.0)


def test_states_beyond_the_acceleration_bound_fail(spark):
    with pytest.raises(Exception, match="continuity"):
        continuity(spark, 1.0, 50.0, bow=0.01, bound=0.001)


EVENTS = (
    "primary_object_id long, secondary_object_id long, tca_us long, miss_distance_km double, "
    "relative_velocity_km_s double, delta_t_seconds double, method string"
)


def event_rows(spark, rows):
    return spark.createDataFrame([(a, b, US + int(t * 1e6), m, 1.0, 0.0, "m") for a, b, t, m in rows], EVENTS)


@pytest.mark.parametrize("gap", [0.0, 0.5, 1.0, 120.0])
def test_connected_detections_are_one_episode(spark, gap):
    rows = event_rows(spark, [(1, 2, 10.0, 2.0), (2, 1, 10.0 + gap, 1.0)])
    always = lambda g: g.withColumn("linked", F.lit(True))
    (best,) = E.merge_episodes(rows, always).collect()
    assert (best.miss_distance_km, best.merged, best.primary_object_id) == (1.0, 2, 1)


def test_detections_are_dealt_out_once(spark):
    from skyframe.workload.screening import detections

    rows = detections(spark, "/root/testdata/sf0.001")
    twice = rows.unionByName(rows)
    whole, sliced = E.merge_episodes(twice, E.within_gap(600)), E.merge_episodes(twice, E.within_gap(600), 86_400)
    assert whole.exceptAll(sliced).isEmpty() and sliced.exceptAll(whole).isEmpty()
    plan = whole._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 0  # required exchanges come later
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("slice_seconds", [1, 86_400])
def test_a_busy_pair_is_the_same_in_any_slices(spark, slice_seconds):
    times = [0, 5, 5, 14, 30, 31, 60, 75, 90, 200]
    rows = event_rows(spark, [(1, 2, float(t), 1.0 + i) for i, t in enumerate(times)])
    got = E.merge_episodes(rows, E.within_gap(10), slice_seconds).orderBy("tca_us").collect()
    assert [((r.tca_us - US) // 10**6, r.merged) for r in got] == [(0, 4), (30, 2), (60, 1), (75, 1), (90, 1), (200, 1)]


def test_exits_and_other_pairs_stay_apart(spark):
    rows = event_rows(spark, [(1, 2, 10.0, 2.0), (1, 2, 20.0, 1.0), (1, 3, 10.0, 1.0)])
    never = lambda g: g.withColumn("linked", F.lit(False))
    assert E.merge_episodes(rows, never).count() == 3
    assert E.merge_episodes(rows, E.within_gap(10)).count() == 2


def test_kepler_model_keeps_a_circular_orbit(spark):
    row = (1, 1, "s", START, 51.6, 10.0, 0.0, 0.0, 0.0, 15.5)
    names = "element_id long, object_id long, source string, epoch timestamp, inclination double, ra_of_asc_node double, eccentricity double, arg_of_pericenter double, mean_anomaly double, mean_motion double"
    model = KeplerJ2()
    df = model.prepare(spark.createDataFrame([row], names)).withColumn(
        "at_us", F.explode(F.sequence(F.lit(US), F.lit(US + 3_600_000_000), F.lit(600_000_000)))
    )
    got = model.state_at(df, "at_us").selectExpr(
        "sqrt(x*x+y*y+z*z) r", "sqrt(vx*vx+vy*vy+vz*vz) v", "x*vx+y*vy+z*vz d", "error"
    ).collect()
    mu = 398600.8
    for r in got:
        assert r.error is None and abs(r.v**2 * r.r / mu - 1) < 1e-9 and abs(r.d) < 1e-6
    bad = spark.createDataFrame([row[:6] + (1.5,) + row[7:]], names)
    df = model.prepare(bad).withColumn("at_us", F.lit(US))
    assert model.state_at(df, "at_us").first().error is not None


def test_tied_detections_give_one_event_each(spark):
    """Rows equal in every column must not part an encounter, whatever a shuffle does."""
    pairs = spark.range(3000).select(
        F.col("id").alias("primary_object_id"), (F.col("id") + 10_000).alias("secondary_object_id"),
        (F.lit(1_767_225_600_000_000) + F.col("id") * 1_000_000).alias("tca_us"), F.lit(1.5).alias("miss_distance_km"),
        F.lit(7.0).alias("relative_velocity_km_s"), F.lit(0.0).alias("delta_t_seconds"), F.lit("m").alias("method"),
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = E.merge_episodes(pairs.unionByName(pairs).repartition(7), E.within_gap(600)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(events) == 3000 and {e.merged for e in events} == {2}


def test_run_counters_keep_the_propagations_of_episodes(spark):
    import duckdb

    from skyframe.workload.registry import load

    folder, counter = "/root/testdata/sf0.001", "episode_propagations"
    run = load()["screening_run"]
    engine = duckdb.connect()
    engine.execute("SET TimeZone = 'UTC'")
    for name in ("nation", "customer", "orders"):
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    expected = engine.execute(f"SELECT {counter} FROM ({run.sql})").fetchone()[0]
    assert run.run(spark, folder).first()[counter] == expected


def test_candidates_are_not_refined_for_their_own_queries(spark, monkeypatch):
    from skyframe.plans import screening_run
    from skyframe.workload import screening

    def refused(*args, **options):
        raise AssertionError("refined")

    monkeypatch.setattr(screening_run, "refine", refused)
    assert screening.chunk_limits(spark, "/root/testdata/sf0.001").count() >= 0
    assert screening.screening_candidates(spark, "/root/testdata/sf0.001").columns[0] == "chunk"


def test_a_close_sample_counts_only_if_no_other_is_nearer(spark):
    """Of two samples 40 and 30 km apart only the second may be refined, if it is close too."""
    from skyframe.operators.refinement import at_nearest_sample

    model = Scene(6378.0)
    prepared = model.prepare(scene_elements(spark, [(1, 7000.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 7040.0, 0.0, 0.0, -0.1, 0.0, 0.0)]))
    step = 100 * P.MICROS
    rows = [(0, 1, 2, US, 40.0), (1, 1, 2, US + step, 30.0)]
    close = spark.createDataFrame(rows, "chunk int, a_object_id long, b_object_id long, sample_us long, separation_km double")
    kept = at_nearest_sample(close, prepared, model, F.array(F.lit(US), F.lit(US + step)))
    assert [r.chunk for r in kept.collect()] == [1]


def test_pairs_that_never_come_close_are_not_written(spark, monkeypatch):
    from skyframe.plans import screening_run
    from skyframe.workload import screening

    written = []

    def noted(df, name="stage"):
        written.append(set(df.columns))
        return materialize(df, name)

    materialize = screening_run.materialize
    monkeypatch.setattr(screening_run, "materialize", noted)
    screening.refine_candidates(spark, "/root/testdata/sf0.001")
    assert not [columns for columns in written if "detections" in columns]


def test_slack_is_judged_after_the_distance(spark):
    near = spark.range(60).selectExpr(
        "id AS object_id", "0L AS sample_us", "7000.0D + id % 7 AS x", "id * 2.0D AS y", "id % 5 * 3.0D AS z",
        "id % 3 - 1.0D AS vx", "id % 4 - 1.5D AS vy", "id % 5 - 2.0D AS vz", "id DIV 4 AS solution_id",
    )
    pairs = fixed_radius_pairs(near, 30.0, payload=(*S.VELOCITY, "solution_id"), hot_cell_rows=None)
    plain = S.prefilter_slack_km(pairs, 5.0).withColumn("shared", S.same_solution())
    expected = sorted(tuple(r) for r in plain.collect() if r.slack_km <= 10.0)
    kept = S.within_slack(pairs, 5.0, 10.0, shared=True).filter("NOT shared").select(plain.columns)
    assert sorted(tuple(r) for r in kept.collect()) == [r for r in expected if not r[-1]] != []
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "SQRT" not in join and "solution_id" not in join


def test_refined_pairs_meet_their_elements_once_and_no_episodes(spark, monkeypatch):
    from skyframe.plans import screening_run
    from skyframe.workload import screening

    joined, both = [], screening_run.with_both_elements

    def counted(*args):
        joined.append(args)
        return both(*args)

    def refused(*args, **options):
        raise AssertionError("episodes")

    monkeypatch.setattr(screening_run, "with_both_elements", counted)
    monkeypatch.setattr(screening_run, "merge_episodes", refused)
    assert screening.refine_candidates(spark, "/root/testdata/sf0.001").count() >= 0
    assert len(joined) == 1
