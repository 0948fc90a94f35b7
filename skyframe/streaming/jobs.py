"""Streaming jobs: feed ingest, canonical elements, alert windows, log counts, episodes.

Every job takes a streaming frame and returns a streaming frame or a started
query. State is bounded by watermarks wherever the result allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.operators.catalogue import ELEMENT_KEY
from skyframe.operators.logs import level_counts
from skyframe.operators.selection import source_priority
from skyframe.operators.sliced import SLICE, with_previous, with_slice


#: Days of a batch that are listed in a partition filter.
MAX_LISTED_DAYS = 1000


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def fresh_elements(elements: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Each (object, source, epoch) once within the lateness. Repeats that come even
    later are stopped by the table itself, see ``append_new_elements``."""
    return elements.withWatermark("epoch", lateness).dropDuplicatesWithinWatermark(list(ELEMENT_KEY))


def append_new_elements(elements: DataFrame, table: str, checkpoint: str):
    """Started query that appends unseen elements to a Parquet table.

    A batch is written to its own partitions, replaced as a whole when the batch runs
    again, and compared with the other batches only: each batch takes effect exactly
    once. Unknown keys are found by an anti-join, whatever their age. The table is
    partitioned by the day of the epoch, and a batch reads only the days it holds.
    """

    return (
        elements.writeStream.foreachBatch(lambda batch, batch_id: write_new_elements(batch, batch_id, table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_new_elements(batch: DataFrame, batch_id: int, table: str) -> None:
    """One batch of ``append_new_elements``. Rows of a day are gathered before they are
    written, so a day and batch is a file or, if it is large, a few."""
    once = batch.dropDuplicates(list(ELEMENT_KEY)).withColumn("epoch_day", F.to_date("epoch"))
    if path_exists(batch.sparkSession, table):
        stored = batch.sparkSession.read.parquet(table).filter(F.col("batch_id") < batch_id)
        days = [r[0] for r in once.select("epoch_day").distinct().limit(MAX_LISTED_DAYS + 1).collect()]
        if len(days) <= MAX_LISTED_DAYS:  # the list prunes partitions; the join is the same without
            stored = stored.filter(F.col("epoch_day").isin(days))
        once = once.join(stored.select(*ELEMENT_KEY), list(ELEMENT_KEY), "left_anti")
    (
        once.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .hint("rebalance", "epoch_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("epoch_day", "batch_id")
        .parquet(table)
    )


def canonical_elements(elements: DataFrame) -> DataFrame:
    """Running canonical element per object, for update mode. A late epoch never
    displaces a newer one. The state is one row per object."""
    order = F.struct(
        F.col("epoch").alias("epoch"),
        (-source_priority(F.col("source"))).alias("preference"),
        F.col("element_id").alias("element_id"),
    )
    best = F.max_by(F.struct("element_id", "source", "epoch"), order).alias("best")
    return elements.groupBy("object_id").agg(best).select("object_id", "best.*")


def failure_windows(
    executions: DataFrame, lateness: str = "10 minutes", window: str = K.INCREASE_WINDOW, slide: str = "1 minute"
) -> DataFrame:
    """Failures per label in sliding windows; windows without one do not appear.

    Two stateful steps in one stream: rows are counted by tumbling slides, and only those
    counts are copied to the windows that hold them. ``window`` is a multiple of ``slide``.
    """
    failed = executions.filter(~F.col("success") & F.col("finished_at").isNotNull())
    slides = (
        failed.withWatermark("finished_at", lateness)
        .groupBy(F.window("finished_at", slide).alias("slide"), "label")
        .agg(F.count("*").alias("failures"))
    )
    counted = (
        slides.select(F.window_time("slide").alias("at"), "label", "failures")
        .groupBy(F.window("at", window, slide).alias("w"), "label")
        .agg(F.sum("failures").alias("failures"))
    )
    return counted.select("label", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures")


def log_windows(lines: DataFrame, lateness: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Lines and error-like lines per service and tumbling window."""
    return level_counts(lines.withWatermark("ts", lateness), width)


def session_episodes(detections: DataFrame, gap: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Episodes by quiet time only: a pair's detections at most ``gap`` apart form
    one. The exact rule needs the path between detections and stays a batch job."""
    ordered = detections.select(
        F.least("primary_object_id", "secondary_object_id").alias("primary_object_id"),
        F.greatest("primary_object_id", "secondary_object_id").alias("secondary_object_id"),
        "tca", "miss_distance_km",
    )
    sessions = (
        ordered.withWatermark("tca", lateness)
        .groupBy(F.session_window("tca", gap).alias("w"), "primary_object_id", "secondary_object_id")
        .agg(
            F.count("*").alias("merged"),
            F.min(F.struct("miss_distance_km", "tca")).alias("best"),
            F.max("tca").alias("last_tca"),
        )
    )
    return sessions.select(
        "primary_object_id", "secondary_object_id",
        F.col("best.tca").alias("tca"), F.col("best.miss_distance_km").alias("miss_distance_km"), "merged", "last_tca",
    )


HOLD_STATE = "instance string, ts timestamp, active boolean, since timestamp, fired boolean, clock timestamp"


def hold_changes(
    samples: DataFrame, state: DataFrame, hold_seconds: int, lateness_seconds: int = 60
) -> tuple[DataFrame, DataFrame]:
    """(changes, next state) of held alerts after some samples (instance, ts, active).

    Changes are pending, firing when the condition has held for ``hold_seconds``, and
    inactive. An alert fires once a sample of its instance, or the latest sample of all
    less the lateness, lies at the end of the hold, so it also fires when no further
    sample of its own comes. The state is one row per instance: its last sample, and
    the begin of its run. Samples are in time order per instance apart from what one
    call holds. Everything looks back by time slices, so an instance may have any
    number of samples.
    """
    key, order = ["instance"], ["ts", "fresh", "active"]
    rows = samples.select("instance", "ts", "active", F.lit(None).cast("timestamp").alias("since"), F.lit(False).alias("fired"), F.lit(1).alias("fresh"))
    known = state.select("instance", "ts", "active", "since", "fired", F.lit(0).alias("fresh"))
    placed = with_previous(with_slice(known.unionByName(rows), "ts"), key, order, "active", "was")
    turns = placed.filter((F.col("fresh") == 0) | (F.col("active") != F.coalesce("was", F.lit(False))))
    turns = turns.withColumn("since", F.when(F.col("fresh") == 0, F.col("since")).when(F.col("active"), F.col("ts")))
    run = F.struct("since", "fired").alias("run")
    turns = with_previous(turns.withColumn("run", run), key, order, "run", "before").drop(SLICE)
    hold = F.make_dt_interval(secs=F.lit(hold_seconds))
    new = turns.filter("fresh = 1")
    ended = new.filter(~F.col("active") & ~F.col("before.fired") & (F.col("before.since") + hold < F.col("ts")))
    fired_late = ended.select("instance", (F.col("before.since") + hold).alias("ts"), F.lit("firing").alias("state"))
    turned = new.select("instance", "ts", F.when(F.col("active"), "pending").otherwise("inactive").alias("state"))

    clock = F.greatest(samples.agg(F.max("ts")).scalar(), state.agg(F.max("clock")).scalar())
    newest = turns.groupBy("instance").agg(F.max_by(F.struct("active", "since", "fired"), F.struct(*order)).alias("run"))
    last = known.unionByName(rows).groupBy("instance").agg(F.max("ts").alias("ts"))
    # An instance that was never active has no turn.
    runs = last.join(newest, "instance", "left").withColumn("clock", clock)
    active, due = F.coalesce("run.active", F.lit(False)), F.col("run.since") + hold
    reached = (F.col("ts") >= due) | (F.col("clock") - F.make_dt_interval(secs=F.lit(lateness_seconds)) > due)
    fires = active & ~F.coalesce("run.fired", F.lit(False)) & F.coalesce(reached, F.lit(False))
    runs = runs.withColumns({"fires": fires, "due": due})
    fired = runs.filter("fires").select("instance", F.col("due").alias("ts"), F.lit("firing").alias("state"))
    after = runs.select(
        "instance", "ts", active.alias("active"), F.when(active, F.col("run.since")).alias("since"),
        (F.col("fires") | (active & F.coalesce("run.fired", F.lit(False)))).alias("fired"), "clock",
    )
    return turned.unionByName(fired_late).unionByName(fired), after


def hold_alerts(samples: DataFrame, hold_seconds: int, path: str, checkpoint: str) -> None:
    """Run a job that appends state changes of held alerts to a Parquet folder.

    Each batch reads the state that the batch before wrote (a table beside the
    checkpoint) and writes changes and state in its own partitions, replaced as a
    whole when the batch runs again. No instance is collected into one task.
    """
    states = f"{checkpoint}_alerts"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.createDataFrame([], HOLD_STATE)
        if batch_id and path_exists(spark, f"{states}/batch_id={batch_id - 1}"):
            state = spark.read.schema(HOLD_STATE).parquet(f"{states}/batch_id={batch_id - 1}")
        rows = batch.persist()
        changes, after = hold_changes(rows, state, hold_seconds)
        after.write.mode("overwrite").parquet(f"{states}/batch_id={batch_id}")
        changes.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        rows.unpersist()

    query = (
        samples.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_table(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append-mode job over what is available now into a Parquet folder."""
    query = (
        frame.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_latest(frame: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Run an update-mode job into a table of current rows: each batch writes the table
    of the batch before with its own changes merged in, so nothing but the newest row
    of a key is kept. Two versions stay, the newest and the one it was made from."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        before = f"{path}/version={batch_id - 1}"
        if path_exists(spark, before):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(before))
        merged(rows, key).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        drop_path(spark, f"{path}/version={batch_id - 2}")

    query = (
        frame.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drop_path(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def merged(changes: DataFrame, key: str) -> DataFrame:
    """The newest row of each key by batch."""
    columns = [c for c in changes.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_id").alias("r"))
    return newest.select(key, "r.*").select(*changes.columns)


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """The state that a job of ``run_latest`` has reached."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == newest).drop("version", "batch_id")
