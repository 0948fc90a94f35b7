"""Operational state: execution counters, sync status, freshness, due work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyframe import constants as K
from skyframe.functions.quality import (
    MICROS,
    freshness_thresholds,
    retry_delay_seconds,
    success_age_seconds,
    sync_freshness,
)
from skyframe.operators.sliced import (
    SLICE,
    earlier_slices,
    fitted_seconds,
    in_slice,
    up_to_here,
    with_slice,
)
from skyframe.session import broadcast_if_small

EXECUTION_KEY = ("kind", "label")


def distinct_executions(executions: DataFrame) -> DataFrame:
    """Executions without those nested in another one of the same provider
    (``parent_id`` of an execution with equal kind and label)."""
    outer = executions.select(F.col("execution_id").alias("parent_id"), *EXECUTION_KEY)
    return executions.join(outer, ["parent_id", *EXECUTION_KEY], "left_anti")


def operation_counters(executions: DataFrame) -> DataFrame:
    """Per kind and label: runs, failures, last attempt, last success, and outcome
    and duration of the execution finished last."""
    finished = F.struct("finished_at", "execution_id")
    return executions.groupBy(*EXECUTION_KEY).agg(
        F.count("finished_at").alias("runs"),
        F.count_if(F.col("finished_at").isNotNull() & ~F.col("success")).alias("failures"),
        F.max("started_at").alias("last_attempt"),
        F.max(F.when(F.col("success"), F.col("finished_at"))).alias("last_success"),
        F.max_by("success", F.when(F.col("finished_at").isNotNull(), finished)).alias("last_outcome"),
        F.max_by("duration", F.when(F.col("finished_at").isNotNull(), finished)).alias("last_duration"),
    )


def duration_histogram(executions: DataFrame) -> DataFrame:
    """Cumulative histogram of successful durations per key: (bound, runs) plus the
    sum of durations. All bounds are counted in one pass, side by side."""
    good = executions.filter("success")
    bounds = [f"le_{i}" for i in range(len(K.DURATION_BOUNDS))]
    counted = good.groupBy(*EXECUTION_KEY).agg(
        *[
            F.count_if(F.col("duration") <= bound).alias(name)
            for name, bound in zip(bounds, K.DURATION_BOUNDS)
        ],
        F.sum("duration").alias("duration_sum"),
    )
    entries = F.array(
        *[
            F.struct(F.lit(float(bound)).alias("bound"), F.col(name).alias("runs"))
            for name, bound in zip(bounds, K.DURATION_BOUNDS)
        ]
    )
    return counted.select(*EXECUTION_KEY, "duration_sum", F.inline(entries))


def request_metrics(requests: DataFrame) -> DataFrame:
    """Requests by task and outcome: count, duration and token sums."""
    return requests.groupBy("task", "outcome").agg(
        F.count("*").alias("requests"),
        F.sum("duration").alias("duration_sum"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("bigint").alias("completion_tokens"),
    )


def run_metrics(run: DataFrame, now: Column) -> DataFrame:
    """Run header rows as (run_id, metric, value): counters, duration and age."""
    completed = F.unix_micros("completed_at") / F.lit(float(MICROS))
    age = F.unix_micros(now) / F.lit(float(MICROS)) - completed
    wide = run.select(
        "run_id",
        *[F.col(c).cast("double").alias(c) for c in K.RUN_METRIC_FIELDS],
        F.col("event_count").cast("double").alias("events"),
        (F.col("duration_ms") / 1000.0).alias("duration_seconds"),
        completed.alias("completed_timestamp_seconds"),
        F.greatest(F.lit(0.0), age).alias("age_seconds"),
    )
    return wide.unpivot("run_id", wide.columns[1:], "metric", "value")


STATE_FIELDS = (
    "running", "last_status", "last_error", "last_started_at", "last_completed_at",
    "last_success_at", "last_duration_seconds", "last_records", "last_from_cache",
    "consecutive_failures", "next_retry_at",
)
_ISO_WITH_ZONE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)([+-]\d{2}:?\d{2}|Z)$"


def _json_kind(raw: Column) -> Column:
    """string / number / integer / boolean / null / object of a raw JSON value."""
    return (
        F.when(raw.isNull() | (raw == "null"), F.lit("null"))
        .when(raw.isin("true", "false"), F.lit("boolean"))
        .when(raw.rlike(r'^"'), F.lit("string"))
        .when(raw.rlike(r"^-?\d+$"), F.lit("integer"))
        .when(raw.rlike(r"^-?\d"), F.lit("number"))
        .otherwise(F.lit("object"))
    )


def state_time(raw: Column) -> Column:
    """Time with a zone from a raw JSON string; anything else is null."""
    text = F.when(_json_kind(raw) == "string", F.regexp_extract(raw, '^"(.*)"$', 1))
    return F.when(text.rlike(_ISO_WITH_ZONE), text.try_cast("timestamp"))


def state_number(raw: Column) -> Column:
    """Finite number that is not negative, else null."""
    value = F.when(_json_kind(raw).isin("integer", "number"), raw.try_cast("double"))
    return F.when((value >= 0) & (value < float("inf")), value)


def state_count(raw: Column) -> Column:
    """Whole number that is not negative, else null."""
    value = F.when(_json_kind(raw) == "integer", raw.try_cast("bigint"))
    return F.when(value >= 0, value)


def state_flag(raw: Column) -> Column:
    return F.when(raw.isin("true", "false"), raw == "true")


def normalize_sync_state(documents: DataFrame) -> DataFrame:
    """One row per document (``document_id``, ``state`` JSON) and source, every
    source present, each field normalised on its own.

    Fields are read as raw JSON, so one bad value never spoils its neighbours.
    """
    raw_object = "map<string,variant>"
    parsed = documents.select(
        "document_id", F.try_parse_json("state").alias("doc")
    ).select(
        "document_id",
        F.expr(f"try_variant_get(doc, '$.sources', '{raw_object}')").alias("sources"),
    )
    wanted = F.explode(F.array(*[F.lit(s) for s in K.PROVIDERS])).alias("source")
    rows = parsed.select("document_id", "sources", wanted)
    one = F.try_element_at("sources", F.col("source"))
    rows = rows.select("document_id", "source", one.alias("row")).select(
        "document_id",
        "source",
        F.expr(f"try_variant_get(row, '$', '{raw_object}')").alias("fields"),
    )
    rows = rows.select(
        "document_id",
        "source",
        *[F.to_json(F.try_element_at("fields", F.lit(f))).alias(f"raw_{f}") for f in STATE_FIELDS],
        F.coalesce(F.map_contains_key("fields", "last_status"), F.lit(False)).alias("has_status"),
    )
    running = F.coalesce(F.col("raw_running") == "true", F.lit(False))
    completed = _completed_status()
    return rows.select(
        "document_id",
        "source",
        running.alias("running"),
        F.when(running, F.lit("running")).otherwise(F.coalesce(completed, F.lit("never_run"))).alias("status"),
        completed.alias("completed_status"),
        *[
            state_time(F.col(f"raw_{f}")).alias(f)
            for f in ("last_started_at", "last_completed_at", "last_success_at", "next_retry_at")
        ],
        state_number(F.col("raw_last_duration_seconds")).alias("last_duration_seconds"),
        state_count(F.col("raw_last_records")).alias("last_records"),
        state_flag(F.col("raw_last_from_cache")).alias("last_from_cache"),
        F.coalesce(state_count(F.col("raw_consecutive_failures")), F.lit(0)).alias("consecutive_failures"),
    )


def _completed_status() -> Column:
    """success / error from the stated status; older records without one are judged
    by whether they hold an error."""
    status, error = F.col("raw_last_status"), F.col("raw_last_error")
    truthy = ~(error.isNull() | error.isin("null", '""', "0", "false", "[]", "{}"))
    done = F.col("raw_last_completed_at").isNotNull() & (F.col("raw_last_completed_at") != "null")
    return (
        F.when(status == '"success"', F.lit("success"))
        .when(status == '"error"', F.lit("error"))
        .when(~F.col("has_status") & done, F.when(truthy, F.lit("error")).otherwise(F.lit("success")))
    )


def sync_gauges(states: DataFrame) -> DataFrame:
    """Ten gauges per document and source; unobserved times are 0, the rest NaN."""
    def seconds(c: str) -> Column:
        return F.coalesce(F.unix_micros(c) / F.lit(float(MICROS)), F.lit(0.0))

    nan = F.lit(float("nan"))
    wide = states.select(
        "document_id",
        "source",
        F.col("running").cast("double").alias("running"),
        F.when(F.col("completed_status") == "success", 1.0)
        .when(F.col("completed_status") == "error", 0.0)
        .otherwise(nan)
        .alias("last_execution_success"),
        F.col("consecutive_failures").cast("double").alias("consecutive_failures"),
        seconds("next_retry_at").alias("next_retry_timestamp_seconds"),
        seconds("last_started_at").alias("last_started_timestamp_seconds"),
        seconds("last_completed_at").alias("last_completed_timestamp_seconds"),
        seconds("last_success_at").alias("last_success_timestamp_seconds"),
        F.coalesce("last_duration_seconds", nan).alias("last_duration_seconds"),
        F.coalesce(F.col("last_records").cast("double"), nan).alias("last_records"),
        F.coalesce(F.col("last_from_cache").cast("double"), nan).alias("last_from_cache"),
    )
    return wide.unpivot(["document_id", "source"], wide.columns[2:], "metric", "value")


def interval_of(source: Column) -> Column:
    intervals = F.create_map(*[F.lit(x) for pair in K.PROVIDER_INTERVAL_SECONDS.items() for x in pair])
    return F.try_element_at(intervals, source)


def with_freshness(states: DataFrame, now: Column) -> DataFrame:
    """Adds freshness, the age of the last success and both limits."""
    interval = interval_of(F.col("source"))
    warning, stale = freshness_thresholds(interval)
    last = F.col("last_success_at")
    return states.withColumns(
        {
            "freshness": sync_freshness(last, now, interval),
            "last_success_age_seconds": success_age_seconds(last, now),
            "freshness_warning_seconds": warning,
            "freshness_stale_seconds": stale,
        }
    )


def overall_freshness(states: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document: stale if any source is, then warning, fresh only if all are."""
    value = F.col("freshness")
    overall = (
        F.when(F.bool_or(value == "stale"), F.lit("stale"))
        .when(F.bool_or(value == "warning"), F.lit("warning"))
        .when(F.bool_and(value == "fresh"), F.lit("fresh"))
        .otherwise(F.lit("unknown"))
    )
    return states.groupBy(key).agg(overall.alias("overall_freshness"))


def latest_execution(executions: DataFrame, key: str = "label") -> DataFrame:
    """The execution that completed last per key."""
    columns = [c for c in executions.columns if c != key]
    done = executions.filter(F.col("finished_at").isNotNull())
    return done.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct("finished_at", "execution_id")).alias("r")
    ).select(key, "r.*")


#: Keys (about 50 bytes each) whose last success may be broadcast.
BROADCAST_KEYS = 100_000


def failure_streaks(
    executions: DataFrame,
    policy: dict[str, int] = K.FEED_RETRY,
    key: str = "label",
    slice_seconds: int | None = None,
) -> DataFrame:
    """Each finished execution with ``consecutive_failures`` after it and the retry
    time of a failure. A success resets the streak.

    Before the first success of a slice the streak goes on from earlier slices:
    their failures less those up to their last success.
    """
    done = executions.filter(F.col("finished_at").isNotNull())
    done = with_slice(done, "finished_at", slice_seconds or fitted_seconds(done, [key], "finished_at"))
    window = up_to_here(in_slice([key], "finished_at", "execution_id"))
    failed = F.when(F.col("success"), 0).otherwise(1)
    rows = done.withColumn("_failed", F.sum(failed).over(window))
    rows = rows.withColumn("_mark", F.when(F.col("success"), F.col("_failed")))
    before, through = earlier_slices([key]), up_to_here(W.partitionBy(key).orderBy(SLICE))
    per_slice = rows.groupBy(key, SLICE).agg(F.max("_failed").alias("_all"), F.max("_mark").alias("_at"))
    totals = per_slice.withColumn("_until", F.sum("_all").over(through))
    totals = totals.withColumn("_reset", F.col("_until") - F.col("_all") + F.col("_at"))
    carried = totals.select(
        key, SLICE,
        (F.col("_until") - F.col("_all") - F.coalesce(F.max("_reset").over(before), F.lit(0))).alias("_carried"),
    )
    rows = rows.join(carried, [key, SLICE])
    at_success = F.max("_mark").over(window)
    streak = F.when(at_success.isNull(), F.col("_carried") + F.col("_failed")).otherwise(
        F.col("_failed") - at_success
    )
    with_streak = rows.withColumn("consecutive_failures", streak).drop("_failed", "_mark", "_carried", SLICE)
    delay = retry_delay_seconds(F.greatest(F.col("consecutive_failures"), F.lit(1)), policy)
    retry = F.timestamp_micros(F.unix_micros("finished_at") + delay * MICROS)
    return with_streak.withColumn("next_retry_at", F.when(~F.col("success"), retry))


def current_failure_streaks(executions: DataFrame, key: str = "label") -> DataFrame:
    """Failures since the last success per key, by aggregation only: the running
    history of a key is not needed for its current streak."""
    at = F.struct("finished_at", "execution_id")
    done = executions.filter(F.col("finished_at").isNotNull())
    last_success = done.filter("success").groupBy(key).agg(F.max(at).alias("last_success"))
    # One row a key; a key may hold most executions, so a few keys are broadcast.
    joined = done.join(broadcast_if_small(last_success, BROADCAST_KEYS), key, "left")
    after = F.col("last_success").isNull() | (at > F.col("last_success"))
    return joined.groupBy(key).agg(F.count_if(after & ~F.col("success")).alias("consecutive_failures"))


def next_due(
    latest: DataFrame, now: Column, interval_seconds: Column, policy: dict[str, int] = K.FEED_RETRY
) -> DataFrame:
    """Adds next_due_at and due to the latest state per key. After a failure the
    retry time counts, else completion plus interval; without a usable time the
    key is due now."""
    completed = F.unix_micros("finished_at")
    retry = F.coalesce(
        F.unix_micros("next_retry_at"),
        completed + retry_delay_seconds(F.greatest(F.coalesce("consecutive_failures", F.lit(1)), F.lit(1)), policy) * MICROS,
    )
    due_us = F.when(completed.isNull(), F.lit(None).cast("bigint")).when(~F.col("success"), retry).otherwise(
        completed + interval_seconds.cast("bigint") * MICROS
    )
    return latest.withColumn("next_due_at", F.timestamp_micros(due_us)).withColumn(
        "due", F.col("next_due_at").isNull() | (now >= F.col("next_due_at"))
    )


def due_providers(executions: DataFrame, now: Column) -> DataFrame:
    """Providers that are due, in their fixed order; one never run is due."""
    streaks = current_failure_streaks(executions)
    newest = latest_execution(executions).join(streaks, "label").withColumn(
        "next_retry_at", F.lit(None).cast("timestamp")
    )
    spark = executions.sparkSession
    wanted = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(p) for p in K.PROVIDERS])).alias("priority", "label")
    )
    judged = next_due(wanted.join(newest, "label", "left"), now, interval_of(F.col("label")))
    return judged.filter("due").select("priority", "label", "next_due_at").orderBy("priority")


def screening_due(
    runs: DataFrame,
    states: DataFrame,
    now: Column,
    interval_seconds: int = K.SCREENING_INTERVAL_SECONDS,
    policy: dict[str, int] = K.SCREENING_RETRY,
) -> DataFrame:
    """Due decision with reason per key.

    ``runs``: key, run_id, completed_at of successful runs. ``states``: key,
    last_status, last_completed_at, consecutive_failures, next_retry_at. A failure
    counts while no run completed after it.
    """
    latest = runs.groupBy("key").agg(
        F.max_by(F.struct("run_id", "completed_at"), F.struct("completed_at", "run_id")).alias("run")
    ).select("key", F.col("run.run_id").alias("latest_run_id"), "run.completed_at")
    rows = states.join(latest, "key", "full_outer")
    none = F.col("completed_at").isNull()
    failed_at = F.col("last_completed_at")
    failing = F.coalesce(
        (F.col("last_status") == "error")
        & F.when(failed_at.isNull(), none).otherwise(none | (F.col("completed_at") <= failed_at)),
        F.lit(False),
    )
    failures = F.greatest(F.lit(1), F.coalesce(F.col("consecutive_failures"), F.lit(1)))
    since = F.unix_micros(F.coalesce(failed_at, now))
    retry = F.coalesce(
        F.col("next_retry_at"),
        F.timestamp_micros(since + retry_delay_seconds(failures, policy) * MICROS),
    )
    cadence = F.timestamp_micros(F.unix_micros("completed_at") + interval_seconds * MICROS)
    next_due_at = F.when(failing, retry).when(~none, cadence)
    due = F.coalesce(now >= F.col("next_due_at"), F.lit(True))
    reason = (
        F.when(F.col("failing"), F.when(F.col("due"), "retry_due").otherwise("retry_pending"))
        .when(none, F.lit("no_successful_run"))
        .otherwise(F.when(F.col("due"), "cadence_due").otherwise("cadence_pending"))
    )
    return (
        rows.withColumns({"failing": failing, "next_due_at": next_due_at})
        .withColumn("due", due)
        .select(
            "key", "latest_run_id", "next_due_at", "due",
            reason.alias("reason"),
            F.coalesce(~F.col("failing") & (F.col("completed_at") > now), F.lit(False)).alias("future_completion"),
        )
    )


def last_record_counts(syncs: DataFrame) -> DataFrame:
    """Record counts of the last successful sync per provider as (provider, result,
    records). ``syncs`` has provider, execution_id, finished_at, success and the
    four counts."""
    good = syncs.filter("success")
    newest = good.groupBy("provider").agg(
        F.max_by(F.struct(*K.RECORD_RESULTS), F.struct("finished_at", "execution_id")).alias("r")
    ).select("provider", "r.*")
    return newest.unpivot("provider", list(K.RECORD_RESULTS), "result", "records")
