"""Feed mapping, upserts, quality and selection at their edges."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skyframe.functions import quality as Q
from skyframe.functions import text as T
from skyframe.operators import catalogue as C
from skyframe.operators import coverage as V
from skyframe.operators import selection as S
from skyframe.sources import feeds

NOW = datetime(2026, 1, 10, tzinfo=timezone.utc)


def values(spark, expression, inputs, type_name="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {type_name}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_object_types(spark):
    got = values(spark, T.object_type, ["PAY", " r/b ", "Rocket Body", "deb", "UNK", "", None, "tba thing"])
    assert got == ["PAYLOAD", "ROCKET_BODY", "ROCKET_BODY", "DEBRIS", "UNKNOWN", "UNKNOWN", "UNKNOWN", "TBA_THING"]
    assert values(spark, T.display_kind, ["rocket-body", "PAYLOAD", None, "TBA"]) == [
        "ROCKET_BODY", "PAYLOAD", "UNKNOWN", "UNKNOWN",
    ]
    assert values(spark, T.operational_status, ["+", None, "", "Z", "?"]) == [
        "Operational (+)", "Unknown", "Unknown", "Z", "Unknown (?)",
    ]


def test_lenient_and_strict_values(spark):
    assert values(spark, T.lenient_double, [" 1.5 ", "x", "", None, "1e3", "2d"]) == [1.5, None, None, None, 1000.0, None]
    got = values(spark, T.lenient_date, ["2024-02-29T10:00", "2024-2-9", "soon", "", None])
    assert [str(g) if g else None for g in got] == ["2024-02-29", None, None, None, None]
    assert values(spark, T.strict_int, ["7", "", None]) == [7, None, None]
    for strict, bad in ((T.strict_double, "x"), (T.strict_int, "1.5x"), (T.strict_date, "soon"), (T.strict_epoch, "")):
        with pytest.raises(Exception):
            values(spark, strict, [bad])
    with pytest.raises(Exception, match="group"):
        values(spark, T.group_name, ["bad name!"])
    assert values(spark, T.group_name, [" gps-ops "]) == ["GPS-OPS"]


def test_epochs_are_utc(spark):
    text = ["2026-01-01T00:00:00", "2026-01-01T00:00:00Z", "2026-01-01T02:00:00.500000+02:00"]
    got = values(spark, lambda c: F.unix_micros(T.strict_epoch(c)), text)
    assert got == [1767225600000000, 1767225600000000, 1767225600500000]


def test_bounded_text(spark):
    whole = "ﬁne\u0000 ​\t  wide　space " + "x" * 400
    (got,) = values(spark, lambda c: T.bounded_text(c, 20), [whole])
    assert got == "fine wide space xxxx"
    assert values(spark, lambda c: T.bounded_text(c, 5), [" \n ", None]) == [None, None]


@pytest.mark.parametrize("hours, status", [(2, "fresh"), (12, "fresh"), (18, "aging"), (24, "aging"), (48, "stale"), (72, "stale"), (72.001, "expired"), (96, "expired"), (-5, "fresh")])
def test_quality(spark, hours, status):
    df = spark.createDataFrame([(NOW - timedelta(hours=hours),)], "epoch timestamp")
    row = S.with_quality(df, F.lit(NOW)).first()
    assert row.status == status and row.allowed == (status != "expired") and abs(row.age_hours - hours) < 1e-6


def test_quality_limits_and_retry(spark):
    with pytest.raises(ValueError):
        Q.QualityLimits(24, 12, 72)
    delay = lambda c: Q.retry_delay_seconds(c, {"initial": 60, "multiplier": 2, "maximum": 1800})
    assert values(spark, delay, [1, 2, 3, 10, 5000], "int") == [60, 120, 240, 1800, 1800]
    with pytest.raises(Exception):
        values(spark, delay, [0], "int")


def test_sync_freshness(spark):
    ages = [60, 5400, 5401, 7200, 7201, -60]
    stamps = [NOW - timedelta(seconds=a) for a in ages] + [None]
    got = values(spark, lambda c: Q.sync_freshness(c, F.lit(NOW), F.lit(3600)), stamps, "timestamp")
    assert got == ["fresh", "fresh", "warning", "warning", "stale", "fresh", "unknown"]


OBJECT = ", ".join(["id long", "norad_cat_id long", *[f"{n} {t}" for n, t in C.OBJECT_TYPES.items()]])


def stored(spark):
    row = dict.fromkeys(C.OBJECT_TYPES)
    row |= {"object_name": "OLD", "object_type": "PAYLOAD", "owner": "US", "country_code": "US", "is_on_orbit": False,
            "is_earth_orbit": True, "has_current_elements": False, "source": "x"}
    return spark.createDataFrame([(9, 25544, *row.values())], OBJECT)


def gp(spark, *records):
    fields = [f for f in feeds.K.OMM_FIELDS]
    rows = [(*[r.get(f) for f in fields], i) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, ", ".join([*[f"{f} string" for f in fields], "ordinal int"]))


FULL = {f: "1.0" for f in feeds.K.OMM_REQUIRED_FIELDS} | {"EPOCH": "2026-01-01T00:00:00"}


def test_gp_keeps_what_a_record_does_not_state(spark):
    batch = C.gp_objects(gp(spark, {"NORAD_CAT_ID": "25544", "OBJECT_NAME": "NEW", "OBJECT_TYPE": ""}, {"NORAD_CAT_ID": "7"}))
    rows = {r.norad_cat_id: r for r in C.upsert_gp(stored(spark), batch).collect()}
    kept = rows[25544]
    assert (kept.id, kept.object_name, kept.object_type, kept.country_code) == (9, "NEW", "PAYLOAD", "US")
    assert kept.has_current_elements and kept.is_on_orbit and kept.is_earth_orbit
    assert rows[7].object_name == "NORAD 7" and rows[7].id == 7 and not rows[7].is_earth_orbit


def test_gp_fields_come_from_the_last_record_that_states_them(spark):
    batch = C.gp_objects(gp(spark, {"NORAD_CAT_ID": "1", "OBJECT_ID": "A"}, {"NORAD_CAT_ID": "1", "COUNTRY_CODE": "FR"}))
    (row,) = [r for r in C.upsert_gp(stored(spark), batch).collect() if r.norad_cat_id == 1]
    assert (row.object_id, row.country_code) == ("A", "FR")
    assert C.gp_report(stored(spark), batch).first().asDict() == {"records": 2, "objects_created": 1, "objects_updated": 1}


def test_satcat_overwrites_with_nulls(spark):
    fields = feeds.K.SATCAT_FIELDS
    record = {"NORAD_CAT_ID": "25544", "OBJECT_NAME": "", "OBJECT_TYPE": "DEB", "ORBIT_CENTER": "EA", "ORBIT_TYPE": "ORB"}
    rows = [(*[record.get(f) for f in fields], 0), (*[(record | {"OBJECT_NAME": "B"}).get(f) for f in fields], 1)]
    batch = C.satcat_objects(spark.createDataFrame(rows, ", ".join([*[f"{f} string" for f in fields], "ordinal int"])))
    (row,) = C.upsert_satcat(stored(spark), batch).collect()
    assert (row.object_name, row.owner, row.object_type, row.id) == ("B", None, "DEBRIS", 9)
    assert row.is_earth_orbit and row.is_on_orbit and row.country_code == "US"


def test_incomplete_elements(spark):
    records = gp(spark, FULL | {"NORAD_CAT_ID": "1"}, FULL | {"NORAD_CAT_ID": "2", "INCLINATION": "", "MEAN_MOTION": None})
    good, bad = C.split_complete(records)
    assert good.count() == 1 and bad.first().missing == ["INCLINATION", "MEAN_MOTION"]
    with pytest.raises(Exception, match="INCLINATION, MEAN_MOTION"):
        C.gp_elements(records).collect()
    raw = json.loads(C.gp_elements(good).first().raw_omm)
    assert raw["NORAD_CAT_ID"] == "1" and "MEAN_MOTION" in raw


def test_provider_batch_never_creates_objects(spark):
    batch = gp(spark, FULL | {"NORAD_CAT_ID": "25544"}, FULL | {"NORAD_CAT_ID": "99999"}, FULL | {"NORAD_CAT_ID": ""})
    none = spark.createDataFrame([], "object_id long, source string, epoch timestamp")
    fresh, after, report = C.provider_sync(batch, stored(spark), none)
    assert report.first().asDict() == {
        "records": 2, "matched_objects": 1, "unmatched_objects": 1, "elements_created": 1, "elements_existing": 0,
    }
    assert fresh.first().object_id == 9 and after.first().has_current_elements and after.count() == 1
    again, _, report = C.provider_sync(batch, stored(spark), fresh)
    assert again.count() == 0 and report.first().elements_existing == 1


def test_tags_are_inserted_once(spark):
    records = gp(spark, {"NORAD_CAT_ID": "25544"}, {"NORAD_CAT_ID": "25544"}).withColumn("group", F.lit("SBAS"))
    tags = C.new_tags(C.group_tags(records, stored(spark)), spark.createDataFrame([], "orbital_object_id long, namespace string, tag string"))
    assert sorted((r.namespace, r.tag) for r in tags.collect()) == [
        ("celestrak_group", "sbas"), ("mission", "augmentation"), ("mission", "navigation"),
    ]
    assert C.new_tags(C.group_tags(records, stored(spark)), tags).count() == 0


def test_feed_files(spark, work):
    with open(f"{work}/a.csv", "w", encoding="utf-8-sig") as f:
        f.write('OBJECT_NAME,NORAD_CAT_ID,OBJECT_TYPE\n"ISS, ZARYA",25544,PAY\nnone,,DEB\nlast,25544,DEB\n')
    rows = feeds.read_satcat_csv(spark, f"{work}/a.csv")
    assert rows.count() == 2
    (row,) = C.last_per_key(C.satcat_objects(rows)).collect()
    assert (row.object_name, row.object_type) == ("last", "DEBRIS")
    with open(f"{work}/b.csv", "w") as f:
        f.write("OBJECT_NAME,NORAD_CAT_ID\na,1\n")
    with pytest.raises(ValueError, match="OBJECT_TYPE"):
        feeds.read_satcat_csv(spark, f"{work}/b.csv")
    with open(f"{work}/c.json", "w") as f:
        json.dump([{"NORAD_CAT_ID": 25544, "MEAN_MOTION": 15.49107075, "EPOCH": "2026-01-05T03:26:13.932384", "DECAY_DATE": None},
                   {"NORAD_CAT_ID": 5, "MEAN_MOTION": 1, "EPOCH": "2025-01-01T00:00:00"}], f)
    rows = feeds.read_gp_json(spark, f"{work}/c.json")
    assert [r.MEAN_MOTION for r in feeds.current_gp(rows, F.lit(NOW)).collect()] == ["15.49107075"]
    with open(f"{work}/d.json", "w") as f:
        f.write("[]")
    with pytest.raises(ValueError):
        feeds.read_gp_json(spark, f"{work}/d.json")
    with pytest.raises(ValueError):
        feeds.guard_record_count(rows, 1)
    assert feeds.guard_record_count(rows, 2).count() == 2


ELEMENT = "element_id long, object_id long, source string, epoch timestamp"


def test_canonical_order_and_coverage(spark):
    at = lambda h: NOW - timedelta(hours=h)
    rows = [
        (1, 1, "celestrak", at(12)), (2, 1, "space-track", at(12)), (3, 1, "other", at(11)),
        (4, 2, "celestrak", at(24)), (5, 2, "space-track", at(24)), (6, 2, "space-track", at(24)),
        (7, 3, "celestrak", at(72)), (8, 4, "celestrak", at(72) - timedelta(seconds=1)), (9, 5, "x", at(-1)),
    ]
    elements = spark.createDataFrame(rows, ELEMENT)
    best = {r.object_id: r.element_id for r in S.canonical_latest(elements).collect()}
    assert best == {1: 3, 2: 6, 3: 7, 4: 8, 5: 9}
    objects = spark.createDataFrame([(i, i != 5, i % 2 == 0) for i in range(1, 9)], "id long, is_earth_orbit boolean, has_current_elements boolean")
    got = {r.metric: r.value for r in V.coverage_metrics(elements, objects, F.lit(NOW)).collect()}
    assert got["catalog_total_objects"] == 8 and got["earth_orbit_objects"] == 7
    assert got["canonical_elements_total"] == 5 and got["screening_eligible_objects"] == 3
    assert [got[f"ephemeris_objects_{s}"] for s in ("fresh", "aging", "stale", "expired")] == [1, 1, 1, 1]
    histogram = {r.status: r.objects for r in V.status_histogram(elements, objects, F.lit(NOW)).collect()}
    assert histogram == {"fresh": 1, "aging": 1, "stale": 1, "expired": 1}
