"""Replay requests as rows, and the limits of feeds, chunks and runs."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skyframe.operators.catalogue import raw_field, with_raw_variant
from skyframe.operators.trajectory import exact_elements, replay_requests
from skyframe.plans.screening_run import ScreeningOptions, budget_report, chunk_report
from skyframe.sources.feeds import group_record_report, within_group_limit

REQUESTS = [
    (1, [10, 11], [1, 2]),
    (2, [10, 10, None], None),
    (3, [10, 99, 98], [1]),
    (4, [10, 11], [1]),
    (5, list(range(10, 27)), None),
    (6, [], None),
    (7, None, []),
    (8, list(range(10, 26)), list(range(1, 17))),
]


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame([(i, i - 9, "s") for i in range(10, 40)], "element_id long, object_id long, source string")


def test_requests_are_judged_as_single_ones(spark, elements):
    requests = spark.createDataFrame(REQUESTS, "request_id long, element_ids array<long>, object_ids array<long>")
    rows = replay_requests(requests, elements).collect()
    found = {r[0]: sorted(x["element_id"] for x in rows if x["request_id"] == r[0] and x["error"] is None) for r in REQUESTS}
    errors = {x["request_id"]: x["error"] for x in rows if x["error"] is not None}
    assert found == {1: [10, 11], 2: [10], 3: [], 4: [], 5: [], 6: [], 7: [], 8: list(range(10, 26))}
    assert errors == {
        3: "unknown element ids: 98, 99",
        4: "element ids do not match the requested objects",
        5: "playback supports at most 16 targeted elements",
    }
    for number, ids, objects in REQUESTS:
        if not ids or None in ids:
            continue
        if number in errors:
            with pytest.raises(ValueError, match=errors[number].split(":")[0]):
                exact_elements(elements, ids, objects)
        else:
            assert sorted(r["element_id"] for r in exact_elements(elements, ids, objects).collect()) == found[number]


def test_groups_above_a_limit_are_reported_and_left_out(spark):
    records = spark.range(10).select(F.when(F.col("id") < 6, "big").otherwise("small").alias("group"), "id")
    report = {r["group"]: r["error"] for r in group_record_report(records, 5).collect()}
    assert report == {"big": "group big holds 6 records; the limit is 5", "small": None}
    assert within_group_limit(records, 5).count() == 4 and within_group_limit(records, 6).count() == 10


def test_chunks_and_budgets(spark):
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    options = ScreeningOptions(start=start, horizon_seconds=1000, step_seconds=60, chunk_seconds=600)
    rows = [(0, False)] * 3 + [(0, True), (1, False)]
    report = chunk_report(spark.createDataFrame(rows, "chunk int, shared boolean"), options, 2)
    first, second = report.orderBy("chunk").collect()
    assert first["error"] == "chunk 1 (samples 0 to 10) has 3 unique candidates; the limit is 2"
    assert (second["first_sample"], second["last_sample"], second["error"]) == (10, 17, None)
    begin = int(start.timestamp()) * 1_000_000
    assert (second["start_us"], second["end_us"]) == (begin + 600_000_000, begin + 1_000_000_000)
    objects = spark.range(7)
    errors = [budget_report(objects, 10, *limits).first()["error"] for limits in ((7, 70), (6, 1), (7, 69))]
    assert errors == [None, "object count 7 exceeds the limit of 6", "propagation workload 70 exceeds the limit of 69"]


def test_raw_records_keep_unparsed_fields(spark):
    rows = spark.createDataFrame([(1, "x", "12"), (2, None, "no number")], "ordinal long, `A_NAME` string, `A_NUMBER` string")
    found = with_raw_variant(rows).select(raw_field("A_NAME"), raw_field("A_NUMBER", "int"), raw_field("ABSENT")).collect()
    assert [tuple(r) for r in found] == [("x", 12, None), (None, None, None)]


def test_landed_groups_have_as_many_files_as_they_fill(spark, work):
    from pathlib import Path

    from skyframe.workload.reports import ARRAY_ROWS, land_arrays

    rows = [(str(i), "ab"[i % 40 == 0]) for i in range(8 * ARRAY_ROWS)]
    land_arrays(spark.createDataFrame(rows, "NORAD_CAT_ID string, group string"), f"{work}/groups", ("group",))
    files = {g: len(list(Path(f"{work}/groups/group={g}").glob("*.txt"))) for g in "ab"}
    assert files["a"] <= 8 and files["b"] == 1


def joined_plan(spark, name):
    """The plan of a query over tables too large to broadcast."""
    from skyframe.workload.registry import load

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return load()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_events_stay_with_their_primary_element(spark):
    # 15 when objects were looked up before elements.
    assert joined_plan(spark, "grounding").count("Exchange hashpartitioning") <= 13


def test_replay_requests_look_elements_up_once(spark):
    assert joined_plan(spark, "exact_replay_elements").count("Join") == 1
