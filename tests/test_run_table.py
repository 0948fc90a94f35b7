"""Tables of runs: composition of changes, replayed batches, plans, and upserts on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from skyframe.operators.catalogue import gp_objects, satcat_objects, upsert_gp, upsert_satcat
from skyframe.sources import run_table
from skyframe.sources.run_table import RunTable
from skyframe.streaming import upserts as U
from skyframe.workload import views as V
from skyframe.workload.catalogue import gp_records, satcat_records

FIELDS = {"a": "int", "b": "string", "c": "double"}
SCHEMA = "key long, replaces boolean, a int, b string, c double"


def brute(batches):
    rows = {}
    for batch in batches:
        for key, replaces, a, b, c in batch:
            old = rows.get(key, (None, None, None))
            kept = [n if n is not None else o for n, o in zip((a, b, c), old)]
            rows[key] = (a, b, kept[2]) if replaces else tuple(kept)
    return sorted((k, *v) for k, v in rows.items())


def batches_of(seed, count=7):
    dice = random.Random(seed)
    maybe = lambda x: x if dice.random() < 0.6 else None
    return [
        [(k, dice.random() < 0.4, maybe(k * n), maybe(f"{k}-{n}"), maybe(k / (n + 1))) for k in dice.sample(range(60), dice.randrange(0, 12) or 1)]
        for n in range(count)
    ]


@pytest.mark.parametrize("share", [0.25, 100.0, 0.0])
def test_batches_compose(spark, work, monkeypatch, share):
    monkeypatch.setattr(run_table, "DELTA_SHARE", share)
    table = RunTable(spark, f"{work}/t{share}", "key", FIELDS, ("a", "b"))
    assert table.read().collect() == []
    batches = batches_of(3, 5)
    for number, batch in enumerate(batches):
        table.write(spark.createDataFrame(batch, SCHEMA), number)
        assert sorted(tuple(r) for r in table.read().collect()) == brute(batches[: number + 1])


def test_a_replayed_batch_has_no_effect(spark, work):
    table = RunTable(spark, f"{work}/t", "key", FIELDS, ("a", "b"))
    batches = batches_of(5, 4)
    for number, batch in enumerate(batches):
        changes = spark.createDataFrame(batch, SCHEMA)
        table.write(changes, number)
        table.write(changes, number)
    # Lost after its runs were written, before the manifest: the table is as before.
    system = table._files()[1]
    system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work}/t/manifests/3"), True)
    assert sorted(tuple(r) for r in table.read().collect()) == brute(batches[:3])
    table.write(spark.createDataFrame(batches[3], SCHEMA), 3)
    assert sorted(tuple(r) for r in table.read().collect()) == brute(batches)
    # A session that does not know the tables reads the same from the files.
    for name in table._names(""):
        spark.sql(f"DROP TABLE IF EXISTS run_{table.digest}_{name}")
    again = RunTable(spark, f"{work}/t", "key", FIELDS, ("a", "b"))
    assert sorted(tuple(r) for r in again.read().collect()) == brute(batches)
    assert len(again._names("")) <= 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_are_not_exchanged(spark, work):
    table = RunTable(spark, f"{work}/t", "key", FIELDS, ("a", "b"))
    table.write(spark.range(1000).select(F.col("id").alias("key"), F.lit(True).alias("replaces"), F.lit(1).alias("a")), 0)
    table.write(spark.range(50).select(F.col("id").alias("key"), F.lit(False).alias("replaces"), F.lit("x").alias("b")), 1)
    assert table.manifest()["delta"] is not None
    assert plan_of(table.read()).count("Exchange") == 0
    changes = spark.range(20).select((F.col("id") % 7).alias("key")).groupBy("key").agg(F.lit(False).alias("replaces"), F.lit(2.0).alias("c"), F.lit(1).alias("a"), F.lit("y").alias("b"))
    merged = table.composed(table._run(table.manifest()["delta"], table.manifest()["buckets"]), changes)
    assert plan_of(merged).count("Exchange hashpartitioning") == 1
    assert table.known(changes.select("key")).filter("stored").count() == 7


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("records_of,to_objects,upsert,changes", [
    (satcat_records, satcat_objects, upsert_satcat, U.satcat_changes),
    (gp_records, gp_objects, upsert_gp, U.gp_changes),
])
def test_parts_on_a_stream_equal_one_batch(spark, work, records_of, to_objects, upsert, changes):
    objects, records = V.objects(spark, FOLDER), records_of(spark, FOLDER)
    table = U.object_table(spark, f"{work}/objects")
    U.load_objects(table, objects)
    low, high = records.agg(F.min("ordinal"), F.max("ordinal")).first()
    for part in range(2):
        some = records.filter(F.floor((F.col("ordinal") - low) * 2 / (high - low + 1)) == part)
        some.write.mode("append").parquet(f"{work}/input")
        stream = spark.readStream.schema(records.schema).parquet(f"{work}/input")
        U.upsert_stream(stream, changes, table, f"{work}/state").awaitTermination()
    table.write(changes(some), 1)  # the last batch once more
    want = upsert(objects, to_objects(records))
    got = U.read_objects(table).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_parts_arrive_in_order_and_can_be_dealt_out_again(spark, work):
    """A part is a stretch of the records, but its files hold row groups for several tasks."""
    from skyframe.workload.upsert_streams import PARTS, arrivals

    records = spark.range(0, 300_000, 1, 1).select(F.col("id").alias("ordinal"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    landed, groups = [], []
    for stream in arrivals(records, work):
        assert stream.isStreaming and stream.columns == records.columns
        found = spark.read.parquet(f"{work}/input/*")
        landed.append(found.agg(F.max("ordinal")).first()[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
        groups.append(found.groupBy(F.spark_partition_id()).count().count())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert landed == [100_000 * (i + 1) - 1 for i in range(PARTS)]
    assert min(groups) > 1 and found.distinct().count() == 300_000
