"""Queries: streaming jobs run to completion over the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from skyframe.session import checkpoint_dir
from skyframe.streaming import jobs as J
from skyframe.streaming.timers import held_changes
from skyframe.workload import views as V
from skyframe.workload.operations import LEVEL, LOGS, log_lines
from skyframe.workload.registry import query
from skyframe.workload.screening import DETECTIONS, detections
from skyframe.workload.views import ELEMENTS, EXECUTIONS, with_views


#: Batches of the streams whose jobs do not mind the order of files.
BATCHES = 4


def streamed(df, name: str, batches: int | None = None):
    """The frame as a stream of Parquet files. Returns (stream, work folder).

    Files written in parallel arrive in no set order, so a job with a watermark
    takes them as one batch, as anything else could drop rows as late. Jobs that
    do not mind the order take them in ``batches`` of equal size, however many files
    the session's settings make of the rows: each batch has a fixed cost.
    """
    spark = df.sparkSession
    work = f"{checkpoint_dir(spark)}/streams_{spark.sparkContext.applicationId}/{name}_{uuid4().hex[:8]}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts).write.parquet(f"{work}/input")
    reader = spark.readStream.schema(spark.read.parquet(f"{work}/input").schema)
    if batches:
        reader = reader.option("maxFilesPerTrigger", -(-parts // batches))
    return reader.parquet(f"{work}/input"), work


def closed(df, time: str, marks: dict[str, str]):
    """``df`` and one row a year after its last: that row moves the watermark past all
    others, so every window of theirs closes. Its own window stays open. ``marks`` are
    SQL values of the row's other columns; the rest is null."""
    last = df.agg((F.max(time) + F.expr("INTERVAL 1 YEAR")).alias(time)).filter(F.col(time).isNotNull())
    marker = last.withColumns({c: F.expr(v) for c, v in marks.items()})
    return df.unionByName(marker, allowMissingColumns=True)


@query(
    with_views(ELEMENTS)
    + """SELECT object_id, source, epoch_us(epoch) AS epoch_us, count(*) AS copies FROM (
      SELECT DISTINCT object_id, source, epoch FROM elements) GROUP BY ALL"""
)
def stream_ingest(spark, folder):
    """Elements arrive twice; each (object, source, epoch) is stored once."""
    elements = V.elements(spark, folder)
    twice = elements.unionByName(elements)
    stream, work = streamed(twice, "ingest", batches=BATCHES)
    J.append_new_elements(stream, f"{work}/table", f"{work}/state").awaitTermination()
    stored = spark.read.parquet(f"{work}/table")
    return stored.groupBy("object_id", "source", F.unix_micros("epoch").alias("epoch_us")).agg(
        F.count("*").alias("copies")
    )


@query(
    with_views(ELEMENTS)
    + "SELECT DISTINCT object_id, source, epoch_us(epoch) AS epoch_us FROM elements"
)
def stream_dedupe(spark, folder):
    elements = V.elements(spark, folder)
    stream, work = streamed(elements.unionByName(elements), "dedupe", batches=BATCHES)
    J.run_to_table(J.fresh_elements(stream), f"{work}/table", f"{work}/state")
    stored = spark.read.parquet(f"{work}/table")
    return stored.select("object_id", "source", F.unix_micros("epoch").alias("epoch_us"))


@query(
    with_views(ELEMENTS)
    + """SELECT object_id, element_id, source, epoch_us(epoch) AS epoch_us FROM (
      SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY epoch DESC,
        CASE source WHEN 'space-track' THEN 0 WHEN 'celestrak' THEN 1 ELSE 9 END, element_id DESC) AS n
      FROM elements) WHERE n = 1"""
)
def stream_canonical(spark, folder):
    """Epochs arrive late and early, over several batches."""
    stream, work = streamed(V.elements(spark, folder), "canonical", batches=BATCHES)
    J.run_latest(J.canonical_elements(stream), f"{work}/current", f"{work}/state", "object_id")
    rows = J.current_rows(spark, f"{work}/current")
    return rows.select("object_id", "element_id", "source", F.unix_micros("epoch").alias("epoch_us"))


@query(
    with_views(EXECUTIONS)
    + """SELECT label, window_us, count(*) AS failures FROM (
      SELECT label, epoch_us(date_trunc('minute', finished_at)) - unnest(range(0, 15)) * 60000000 AS window_us
      FROM executions WHERE finished_at IS NOT NULL AND NOT success) GROUP BY ALL"""
)
def stream_failures(spark, folder):
    rows = closed(V.executions(spark, folder), "finished_at", {"success": "false", "label": "'mark'"})
    stream, work = streamed(rows, "failures")
    J.run_to_table(J.failure_windows(stream), f"{work}/table", f"{work}/state")
    counted = spark.read.parquet(f"{work}/table")
    return counted.select("label", F.unix_micros("window_start").alias("window_us"), "failures")


@query(
    with_views(LOGS)
    + """SELECT service_name, epoch_us(date_trunc('minute', ts)) AS window_us, count(*) AS lines,
      count(*) FILTER (""" + LEVEL + """) AS alarming FROM labelled GROUP BY ALL"""
)
def stream_logs(spark, folder):
    stream, work = streamed(closed(log_lines(spark, folder), "ts", {"service_name": "'mark'"}), "logs")
    J.run_to_table(J.log_windows(stream), f"{work}/table", f"{work}/state")
    counted = spark.read.parquet(f"{work}/table")
    return counted.select("service_name", F.unix_micros("window_start").alias("window_us"), "lines", "alarming")


@query(
    with_views(DETECTIONS)
    + """, numbered AS (SELECT *, sum(CASE WHEN gap <= 600000000 THEN 0 ELSE 1 END) OVER (
        PARTITION BY primary_object_id, secondary_object_id ORDER BY tca_us ROWS UNBOUNDED PRECEDING) AS episode
      FROM (SELECT *, tca_us - lag(tca_us) OVER (PARTITION BY primary_object_id, secondary_object_id ORDER BY tca_us) AS gap
        FROM detections))
    SELECT primary_object_id, secondary_object_id, min(miss_distance_km) AS miss_distance_km, count(*) AS merged
    FROM numbered GROUP BY primary_object_id, secondary_object_id, episode"""
)
def stream_episodes(spark, folder):
    rows = detections(spark, folder).withColumn("tca", F.timestamp_micros("tca_us"))
    marks = {"primary_object_id": "-1L", "secondary_object_id": "-1L"}
    stream, work = streamed(closed(rows, "tca", marks), "episodes")
    J.run_to_table(J.session_episodes(stream), f"{work}/table", f"{work}/state")
    sessions = spark.read.parquet(f"{work}/table")
    return sessions.select("primary_object_id", "secondary_object_id", "miss_distance_km", "merged")


HELD = """samples AS (SELECT 'i-' || (user_id % 4)::VARCHAR AS instance, ts, event_id % 100 > 30 AS active FROM events),
runs AS (SELECT instance, min(ts) FILTER (active) AS since, run FROM (
  SELECT *, count(*) FILTER (NOT active) OVER (PARTITION BY instance ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
  FROM samples) GROUP BY instance, run HAVING bool_or(active)),
spans AS (SELECT *, (SELECT min(ts) FROM samples s WHERE s.instance = r.instance AND NOT s.active AND s.ts > r.since) AS ends
  FROM runs r)"""


HELD_CHANGES = (
    with_views(HELD)
    + """SELECT instance, ts_us, state FROM (
      SELECT instance, epoch_us(since) AS ts_us, 'pending' AS state FROM spans
      UNION ALL SELECT instance, epoch_us(since) + 600000000, 'firing' FROM spans
        WHERE ends IS NULL OR epoch_us(ends) > epoch_us(since) + 600000000
      UNION ALL SELECT instance, epoch_us(ends), 'inactive' FROM spans WHERE ends IS NOT NULL)"""
)


def alert_arrivals(spark, folder):
    """Samples of alerts in three parts in order of time, and a quiet instance's later sample,
    which moves the clock so that the last alerts fire."""
    samples = V.table(spark, folder, "events").select(
        F.concat(F.lit("i-"), (F.col("user_id") % 4).cast("string")).alias("instance"),
        F.timestamp_micros(V.micros("ts")).alias("ts"),
        (F.col("event_id") % 100 > 30).alias("active"),
    )
    day = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    first, last = samples.agg(F.min(day), F.max(day)).first()
    thirds = [first + (last - first + 1) * i // 3 for i in range(4)] if first is not None else []
    arrivals = [samples.filter(day.between(a, b - 1)) for a, b in zip(thirds[:-1], thirds[1:])]
    later = samples.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).filter("ts IS NOT NULL")
    arrivals.append(later.select(F.lit("quiet").alias("instance"), "ts", F.lit(False).alias("active")))
    return samples.schema, arrivals


@query(HELD_CHANGES)
def stream_alerts(spark, folder):
    """State changes of held alerts, over several batches in order of time."""
    work = f"{checkpoint_dir(spark)}/streams_{spark.sparkContext.applicationId}/alerts_{uuid4().hex[:8]}"
    schema, arrivals = alert_arrivals(spark, folder)
    for arrival in arrivals:  # what has come is taken up each time
        arrival.write.mode("append").parquet(f"{work}/input")
        stream = spark.readStream.schema(schema).parquet(f"{work}/input")
        J.hold_alerts(stream, 600, f"{work}/table", f"{work}/state")
    changes = spark.read.option("recursiveFileLookup", True).parquet(f"{work}/table")
    return changes.select("instance", F.unix_micros("ts").alias("ts_us"), "state")


@query(HELD_CHANGES)
def stream_alert_timers(spark, folder):
    """The same by state in the state store and timers on event time."""
    work = f"{checkpoint_dir(spark)}/streams_{spark.sparkContext.applicationId}/timers_{uuid4().hex[:8]}"
    schema, arrivals = alert_arrivals(spark, folder)
    for arrival in arrivals:
        arrival.write.mode("append").parquet(f"{work}/input")
        stream = spark.readStream.schema(schema).parquet(f"{work}/input")
        J.run_to_table(held_changes(stream, 600), f"{work}/table", f"{work}/state")
    changes = spark.read.parquet(f"{work}/table")
    return changes.select("instance", F.unix_micros("ts").alias("ts_us"), "state")
