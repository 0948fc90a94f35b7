"""Alerts, due work, briefs, trajectories and streams on small fixtures."""

import json
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skyframe.functions.orbit import StraightLine
from skyframe.operators import alerts as A
from skyframe.operators import briefs as B
from skyframe.operators import lookup as L
from skyframe.operators import operations as O
from skyframe.operators import trajectory as T
from skyframe.streaming import jobs as J

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("slice_seconds", [60, 3600])
def test_alert_holds_and_clears(spark, slice_seconds):
    rows = [("i", at(m), up == 0) for m, up in enumerate([0, 0, 0, 1, 1, 1])]
    samples = spark.createDataFrame(rows, "instance string, ts timestamp, active boolean")
    held = A.hold_for(samples, ["instance"], 120, slice_seconds).orderBy("ts")
    assert [r.state for r in held.collect()] == ["pending", "pending", "firing", "inactive", "inactive", "inactive"]


@pytest.mark.parametrize("slice_seconds", [60, 86400])
def test_counter_increase_and_reset(spark, slice_seconds):
    series = spark.createDataFrame([("a", at(m), float(v)) for m, v in enumerate([0, 0, 0, 1, 1, 5, 2])], "k string, ts timestamp, value double")
    deltas = [r.delta for r in A.counter_deltas(series, ["k"], slice_seconds).orderBy("ts").collect()]
    assert deltas == [None, 0.0, 0.0, 1.0, 0.0, 4.0, 2.0]
    total = A.counter_increase(series, ["k"]).agg(F.max("increase")).first()[0]
    assert total == 7.0


@pytest.mark.parametrize("slice_seconds", [60, 86400])
def test_failure_streaks_cross_slices(spark, slice_seconds):
    outcomes = [False, False, True, False, False, False, True, False]
    rows = [(i, "a", at(m), ok) for i, (m, ok) in enumerate(zip([0, 0.2, 1, 3, 3.5, 9, 20, 21], outcomes))]
    runs = spark.createDataFrame(rows, "execution_id long, label string, finished_at timestamp, success boolean")
    streaks = O.failure_streaks(runs, slice_seconds=slice_seconds).orderBy("execution_id").collect()
    assert [r.consecutive_failures for r in streaks] == [1, 2, 0, 1, 2, 3, 0, 1]
    assert streaks[5].next_retry_at == streaks[5].finished_at + timedelta(seconds=240)
    assert streaks[2].next_retry_at is None
    assert O.current_failure_streaks(runs).first().consecutive_failures == 1


def test_inhibition_needs_equal_labels(spark):
    rows = [("a", "critical", "c", "p", None), ("a", "warning", "c", "p", None), ("a", "warning", "c", "q", None)]
    alerts = spark.createDataFrame(rows, "alertname string, severity string, component string, provider string, source string")
    assert sorted((r.severity, r.provider) for r in A.inhibited(alerts).collect()) == [("critical", "p"), ("warning", "q")]


def test_screening_due_reasons(spark):
    runs = spark.createDataFrame([(1, 10, at(0)), (2, 11, at(-300)), (3, 12, at(500))], "key int, run_id long, completed_at timestamp")
    states = spark.createDataFrame(
        [(1, "error", at(1), 1, None), (2, "error", at(-301), 3, None), (4, "success", None, 0, None), (5, "error", None, 2, None)],
        "key int, last_status string, last_completed_at timestamp, consecutive_failures long, next_retry_at timestamp",
    )
    got = {r.key: (r.reason, r.due, r.future_completion) for r in O.screening_due(runs, states, F.lit(at(16))).collect()}
    assert got == {
        1: ("retry_due", True, False), 2: ("cadence_due", True, False), 3: ("cadence_pending", False, True),
        4: ("no_successful_run", True, False), 5: ("retry_pending", False, False),
    }


GOOD = {
    "executive_summary": "The primary object and the secondary object pass close.",
    "key_observations": [{"text": "The pass is close by.", "evidence_fields": ["tca", "tca"]}],
    "recommended_checks": ["monitor_next_screening", "monitor_next_screening"],
    "limitations": ["human_review_required"],
}


def changed(**parts):
    return json.dumps(GOOD | parts)


def observation(text="The pass is close by.", fields=("tca",), **more):
    return [{"text": text, "evidence_fields": list(fields)} | more]


BRIEFS = [
    (json.dumps(GOOD), "stop", None, None),
    (json.dumps(GOOD), "stop", "why", "reasoning_present"),
    (json.dumps(GOOD), "length", None, "output_truncated"),
    (json.dumps(GOOD), None, None, "finish_reason_invalid"),
    (" \n", "stop", None, "empty_content"),
    ("<Think>x", "stop", None, "thinking_tag_present"),
    ("{", "stop", None, "invalid_json"),
    ("[]", "stop", None, "schema_invalid"),
    (changed(extra=1), "stop", None, "schema_invalid"),
    (changed(executive_summary="short"), "stop", None, "schema_invalid"),
    (changed(limitations=["other"]), "stop", None, "schema_invalid"),
    (changed(key_observations=observation(more=1)), "stop", None, "schema_invalid"),
    (changed(key_observations=observation(fields=())), "stop", None, "schema_invalid"),
    (changed(recommended_checks="monitor_next_screening"), "stop", None, "schema_invalid"),
    (changed(executive_summary="The primary object and the secondary object pass at 3 km."), "stop", None, "narrative_digit"),
    (changed(executive_summary="Operators should perform a burn for the primary object."), "stop", None, "maneuver_instruction"),
    (changed(executive_summary="We do not recommend a burn. The primary object and secondary object pass."), "stop", None, None),
    (changed(executive_summary="The collision probability is small for the primary object."), "stop", None, "invented_probability"),
    (changed(executive_summary="High risk for the primary object and the secondary object."), "stop", None, "invented_risk_classification"),
    (changed(executive_summary="The primary object passes by at some distance."), "stop", None, "schema_invalid"),
    (changed(key_observations=observation() * 2), "stop", None, "duplicate_item"),
    (changed(key_observations=observation(fields=["method"])), "stop", None, "unavailable_evidence"),
]


def test_briefs_get_their_first_reason(spark):
    rows = [(i, c, f, r, 1, 2, ["tca"]) for i, (c, f, r, _) in enumerate(BRIEFS)]
    briefs = spark.createDataFrame(
        rows,
        "brief_id int, content string, finish_reason string, reasoning_content string, prompt_tokens int, completion_tokens int, available array<string>",
    )
    checked = B.check_briefs(briefs)
    got = [r.reason for r in checked.orderBy("brief_id").collect()]
    assert got == [b[3] for b in BRIEFS]
    record = B.rejections(checked).filter("brief_id = 3").first()
    assert record.finish_reason == "unknown" and len(record.output_sha256) == 64


def test_json_with_text_behind_it_is_none(spark):
    broken = ["4763 Of thn", '"a" b', '{"a":1}}', "[1] ]", "1,2", '1,"w":2', "", "x", "1 {"]
    good = ["4763", ' {"a":[1]}\n', "[1]", '"]}"', "null"]
    df = spark.createDataFrame([(c,) for c in broken + good], "c string")
    assert {r.c for r in df.filter(B.parsed_json(F.col("c")).isNotNull()).collect()} == set(good)
    brief = ("7 of all", "stop", None, ["tca"])
    briefs = spark.createDataFrame([brief], "content string, finish_reason string, reasoning_content string, available array<string>")
    assert B.check_briefs(briefs).first().reason == "invalid_json"


def test_replies(spark):
    replies = ['{"status":"ok","summary":"fine"}', '{"status":"ok"}', '{"status":"no","summary":"x"}', '{"status":"ok","summary":""}', "x", '{"status":"ok","summary":"<think>"}', '{"status":"ok","summary":5}']
    df = spark.createDataFrame(list(enumerate(replies)), "i int, c string").select("i", B.reply_valid(F.col("c")).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == [True] + [False] * 6


def test_search_many_matches_search(spark):
    names = ["ISS (ZARYA)", "ISS DEB", "STARLINK-15", "MISS", "IS"]
    objects = spark.createDataFrame([(i, 15 + i, n, i) for i, n in enumerate(names)], "id long, norad_cat_id long, object_name string, ordinal long")
    queries = ["iss", "15", "x", "nothing", "s d", "RLINK"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    many = {}
    for r in L.search_many(objects, asked).orderBy("query_id", "place").collect():
        many.setdefault(r.query_id, []).append((r.rank, r.id))
    for i, text in enumerate(queries):
        assert many.get(i, []) == [(r["rank"], r["id"]) for r in L.search(objects, text).collect()]


LINES = "element_id long, object_id long, source string, epoch timestamp, x0 double, y0 double, z0 double, vx0 double, vy0 double, vz0 double"


def test_trajectory_and_playback_rules(spark):
    rows = [
        (1, 1, "celestrak", at(0), 7000.0, 0.0, 0.0, 1.0, 0.0, 0.0),
        (2, 2, "celestrak", at(-72 * 60 + 1), 7000.0, 0.0, 0.0, 1.0, 0.0, 0.0),
    ]
    elements = spark.createDataFrame(rows, LINES)
    objects = spark.createDataFrame([(i, i, "n", "t", "o", None, "s", "+") for i in (1, 2)], "id long, norad_cat_id long, object_name string, object_type string, owner string, launch_date date, launch_site string, ops_status_code string")
    window = (elements, objects, at(0), at(2.5), 60)
    paths = {r.object_id: r for r in T.trajectories(*window, model=StraightLine()).collect()}
    assert len(paths[1].points) == 4 and paths[1].points[-1].at_us - paths[1].points[0].at_us == 150_000_000
    assert paths[2].points is None and paths[2].expired_at_us is not None
    shown = {r.object_id: r.outcome for r in T.playback(*window, model=StraightLine()).collect()}
    assert shown == {1: "rendered", 2: "expired"}
    exact = T.playback(*window, object_ids=[2], element_ids=[2], model=StraightLine()).first()
    assert exact.outcome == "rendered" and exact.ephemeris_status == "stale"
    with pytest.raises(ValueError, match="unknown element ids: 7"):
        T.exact_elements(elements, [1, 7], None)
    with pytest.raises(ValueError, match="match"):
        T.exact_elements(elements, [1], [2])
    with pytest.raises(ValueError, match="16"):
        T.exact_elements(elements, list(range(17)), None)
    for end, step in ((0, 60), (10, 5), (1441, 60), (1000, 10)):
        with pytest.raises(ValueError):
            T.check_window(at(0), at(end), step)
    ids = elements.select("object_id")
    assert T.same_ids(ids, ids.unionByName(ids), "object_id") and not T.same_ids(ids, ids.limit(1), "object_id")


def feed(spark, folder, batches, schema):
    """Write batches one after another, so that the stream reads them in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_stream_alert_fires_without_a_further_sample(spark, work):
    batches = [
        [("a", at(0), True), ("b", at(0), True)],
        [("a", at(1), True), ("b", at(1), False)],
        [("c", at(30), False)],
        [("c", at(60), False)],
    ]
    stream = feed(spark, work, batches, "instance string, ts timestamp, active boolean")
    J.hold_alerts(stream, 300, f"{work}/out", f"{work}/state")
    got = sorted((r.instance, r.ts.minute, r.state) for r in spark.read.parquet(f"{work}/out").collect())
    assert got == [("a", 0, "pending"), ("a", 5, "firing"), ("b", 0, "pending"), ("b", 1, "inactive")]


def test_stream_ingest_ignores_repeats_of_any_age(spark, work):
    schema = "object_id long, source string, epoch timestamp, element_id long"
    batches = [[(1, "s", at(0), 1)], [(1, "s", at(90000), 2)], [(1, "s", at(0), 3), (2, "s", at(0), 4)]]
    stream = feed(spark, work, batches, schema)
    J.append_new_elements(stream, f"{work}/table", f"{work}/state").awaitTermination()
    rows = spark.read.parquet(f"{work}/table").collect()
    assert sorted(r.element_id for r in rows) == [1, 2, 4]


def test_batches_of_a_stream_do_not_grow_with_its_files(spark):
    from pathlib import Path

    from skyframe.workload.streams import BATCHES, streamed

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    try:
        stream, folder = streamed(spark.range(1000), "many", batches=BATCHES)
        J.run_to_table(stream, f"{folder}/table", f"{folder}/state")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len([p for p in Path(f"{folder}/state/commits").iterdir() if p.name.isdigit()]) == BATCHES
    assert spark.read.parquet(f"{folder}/table").distinct().count() == 1000
