"""Queries: operational counters, sync state, due work, alerts and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.functions.quality import retry_delay_seconds
from skyframe.operators import alerts as A
from skyframe.operators import logs as G
from skyframe.operators import operations as O
from skyframe.session import new_folder
from skyframe.sources.log_table import LogTable
from skyframe.workload import views as V
from skyframe.workload.registry import query
from skyframe.workload.views import CONJUNCTIONS, EVENTS_NOW_SQL, EVENTS_NOW_US, EXECUTIONS, RUNS, with_views


def events_now():
    return F.timestamp_micros(F.lit(EVENTS_NOW_US))


DISTINCT = """outer_most AS (SELECT e.* FROM executions e WHERE NOT EXISTS (
  SELECT 1 FROM executions p WHERE p.execution_id = e.parent_id AND p.kind = e.kind AND p.label = e.label))"""


@query(
    with_views(EXECUTIONS, DISTINCT)
    + """SELECT kind, label, count(finished_at) AS runs,
      count(*) FILTER (finished_at IS NOT NULL AND NOT success) AS failures,
      epoch_us(max(started_at)) AS last_attempt, epoch_us(max(finished_at) FILTER (success)) AS last_success,
      arg_max(success, (finished_at, execution_id)) FILTER (finished_at IS NOT NULL) AS last_outcome,
      arg_max(duration, (finished_at, execution_id)) FILTER (finished_at IS NOT NULL) AS last_duration
    FROM outer_most GROUP BY kind, label"""
)
def operation_counters(spark, folder):
    rows = O.operation_counters(O.distinct_executions(V.executions(spark, folder)))
    return rows.withColumns({c: F.unix_micros(c) for c in ("last_attempt", "last_success")})


@query(
    with_views(EXECUTIONS)
    + """SELECT kind, label, bound, count(*) FILTER (duration <= bound) AS runs, round(sum(duration), 4) AS duration_sum
    FROM executions, (SELECT unnest([1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600, 'inf'::DOUBLE]) AS bound)
    WHERE success GROUP BY kind, label, bound"""
)
def duration_histogram(spark, folder):
    return O.duration_histogram(V.executions(spark, folder)).withColumn("duration_sum", F.round("duration_sum", 4))


@query(
    """SELECT role AS task, CASE WHEN length(text) > 400 THEN 'success' ELSE 'error' END AS outcome,
      count(*) AS requests, round(sum(turn * 0.5::DOUBLE), 4) AS duration_sum,
      coalesce(sum(CASE WHEN turn % 3 <> 0 THEN length(text) END), 0)::BIGINT AS prompt_tokens,
      coalesce(sum(turn), 0)::BIGINT AS completion_tokens FROM conversations GROUP BY ALL"""
)
def request_metrics(spark, folder):
    size = F.length("text")
    requests = V.table(spark, folder, "conversations").select(
        F.col("role").alias("task"),
        F.when(size > 400, "success").otherwise("error").alias("outcome"),
        (F.col("turn") * 0.5).alias("duration"),
        F.when(F.col("turn") % 3 != 0, size).alias("prompt_tokens"),
        F.col("turn").alias("completion_tokens"),
    )
    return O.request_metrics(requests).withColumn("duration_sum", F.round("duration_sum", 4))


@query(
    with_views(CONJUNCTIONS, RUNS)
    + ", wide AS (SELECT run_id, "
    + ", ".join(f"{c}::DOUBLE AS {c}" for c in K.RUN_METRIC_FIELDS)
    + """, event_count::DOUBLE AS events, duration_ms / 1000.0::DOUBLE AS duration_seconds,
      epoch_us(completed_at) / 1000000.0::DOUBLE AS completed_timestamp_seconds,
      greatest(0.0::DOUBLE, """
    + f"""{V.NOW_US} / 1000000.0::DOUBLE - epoch_us(completed_at) / 1000000.0::DOUBLE) AS age_seconds FROM runs)
    SELECT run_id, metric, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (run_id)) INTO NAME metric VALUE value)"""
)
def run_metrics(spark, folder):
    return O.run_metrics(V.runs(spark, folder), V.now())


def state_documents(spark, folder):
    """One status document per stream event; some fields are broken on purpose."""
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    stamp = F.date_format(F.timestamp_micros(V.micros("ts")), "yyyy-MM-dd'T'HH:mm:ss")
    quoted = lambda c, zone: F.concat(F.lit('"'), c, F.lit(zone), F.lit('"'))
    satcat = F.concat(
        F.lit('{"running": '), F.when(user % 9 == 0, "true").otherwise("false"),
        F.lit(', "last_status": '), F.when(kind == "error", '"error"').when(kind == "view", "7").otherwise('"success"'),
        F.lit(', "last_success_at": '), F.when(user % 7 == 0, quoted(stamp, "")).otherwise(quoted(stamp, "+00:00")),
        F.lit(', "last_duration_seconds": '), F.when(key % 5 == 0, "-1").when(key % 5 == 1, "true").otherwise(F.lit("12.5")),
        F.lit(', "last_records": '), F.when(key % 4 == 0, "3.5").otherwise((key % 100).cast("string")),
        F.lit(', "last_from_cache": '), F.when(key % 3 == 0, "1").otherwise("true"),
        F.lit(', "consecutive_failures": '), (user % 6).cast("string"), F.lit("}"),
    )
    celestrak = F.concat(
        F.lit('{"last_completed_at": '), quoted(stamp, "Z"),
        F.lit(', "last_error": '), F.when(kind == "click", '"boom"').otherwise("null"), F.lit("}"),
    )
    document = F.concat(
        F.lit('{"updated_at": null, "sources": {"satcat": '), satcat,
        F.when(user % 4 != 0, F.concat(F.lit(', "celestrak": '), celestrak)).otherwise(', "celestrak": 5'),
        F.lit("}}"),
    )
    whole = F.when(key % 50 == 0, "not json").when(key % 50 == 1, '{"sources": []}').otherwise(document)
    return V.table(spark, folder, "events").select(key.alias("document_id"), whole.alias("state"))


SYNC = """sync AS (
  SELECT event_id AS document_id, source, user_id, event_type, ts, event_id % 50 IN (0, 1) AS broken,
    NOT broken AND source = 'satcat' AS s, NOT broken AND source = 'celestrak' AND user_id % 4 <> 0 AS c,
    s AND user_id % 9 = 0 AS running,
    CASE WHEN s AND event_type = 'error' THEN 'error' WHEN s AND event_type <> 'view' THEN 'success'
      WHEN c AND event_type = 'click' THEN 'error' WHEN c THEN 'success' END AS completed_status,
    CASE WHEN running THEN 'running' ELSE coalesce(completed_status, 'never_run') END AS status,
    CASE WHEN c THEN date_trunc('second', ts) END AS last_completed_at,
    CASE WHEN s AND user_id % 7 <> 0 THEN date_trunc('second', ts) END AS last_success_at,
    CASE WHEN s AND event_id % 5 > 1 THEN 12.5::DOUBLE END AS last_duration_seconds,
    CASE WHEN s AND event_id % 4 <> 0 THEN event_id % 100 END AS last_records,
    CASE WHEN s AND event_id % 3 <> 0 THEN true END AS last_from_cache,
    CASE WHEN s THEN user_id % 6 ELSE 0 END AS consecutive_failures
  FROM events, (VALUES ('satcat'), ('celestrak'), ('space-track')) p(source)
)"""


@query(
    with_views(SYNC)
    + """SELECT document_id, source, running, status, epoch_us(last_completed_at) AS last_completed_us,
      epoch_us(last_success_at) AS last_success_us, last_duration_seconds, last_records, last_from_cache,
      consecutive_failures FROM sync"""
)
def sync_state(spark, folder):
    states = O.normalize_sync_state(state_documents(spark, folder))
    return states.select(
        "document_id", "source", "running", "status",
        F.unix_micros("last_completed_at").alias("last_completed_us"),
        F.unix_micros("last_success_at").alias("last_success_us"),
        "last_duration_seconds", "last_records", "last_from_cache", "consecutive_failures",
    )


@query(
    with_views(SYNC)
    + """, wide AS (SELECT document_id, source, running::INTEGER::DOUBLE AS running,
      CASE completed_status WHEN 'success' THEN 1.0::DOUBLE WHEN 'error' THEN 0.0::DOUBLE ELSE 'nan'::DOUBLE END AS last_execution_success,
      consecutive_failures::DOUBLE AS consecutive_failures, 0.0::DOUBLE AS next_retry_timestamp_seconds,
      0.0::DOUBLE AS last_started_timestamp_seconds,
      coalesce(epoch_us(last_completed_at) / 1000000.0::DOUBLE, 0.0::DOUBLE) AS last_completed_timestamp_seconds,
      coalesce(epoch_us(last_success_at) / 1000000.0::DOUBLE, 0.0::DOUBLE) AS last_success_timestamp_seconds,
      coalesce(last_duration_seconds, 'nan'::DOUBLE) AS last_duration_seconds,
      coalesce(last_records::DOUBLE, 'nan'::DOUBLE) AS last_records,
      coalesce(last_from_cache::INTEGER::DOUBLE, 'nan'::DOUBLE) AS last_from_cache FROM sync),
    long AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (document_id, source)) INTO NAME metric VALUE value)
    SELECT metric, source, count(*) AS documents, count(*) FILTER (isnan(value)) AS unknown,
      round(coalesce(sum(value) FILTER (NOT isnan(value)), 0), 3) AS total FROM long GROUP BY metric, source"""
)
def sync_gauges(spark, folder):
    gauges = O.sync_gauges(O.normalize_sync_state(state_documents(spark, folder)))
    known = ~F.isnan("value")
    return gauges.groupBy("metric", "source").agg(
        F.count("*").alias("documents"),
        F.count_if(~known).alias("unknown"),
        F.round(F.coalesce(F.sum(F.when(known, F.col("value"))), F.lit(0.0)), 3).alias("total"),
    )


FRESH = f"""judged AS (
  SELECT document_id, source, CASE WHEN last_success_at IS NULL THEN 'unknown'
      WHEN age <= warning THEN 'fresh' WHEN age <= stale THEN 'warning' ELSE 'stale' END AS freshness,
    age AS last_success_age_seconds, warning AS freshness_warning_seconds, stale AS freshness_stale_seconds
  FROM (SELECT *, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(last_success_at)) / 1000000.0::DOUBLE) AS age,
      CASE source WHEN 'satcat' THEN 64800 WHEN 'celestrak' THEN 10800 ELSE 5400 END::BIGINT AS warning,
      CASE source WHEN 'satcat' THEN 86400 WHEN 'celestrak' THEN 14400 ELSE 7200 END::BIGINT AS stale FROM sync)
)"""
MID_JANUARY = 1_705_276_800_000_000


def _fresh(spark, folder):
    states = O.normalize_sync_state(state_documents(spark, folder))
    return O.with_freshness(states, F.timestamp_micros(F.lit(MID_JANUARY)))


FRESH_COLUMNS = (
    "document_id", "source", "freshness", "last_success_age_seconds", "freshness_warning_seconds",
    "freshness_stale_seconds",
)


@query(
    with_views(SYNC, FRESH)
    + """SELECT document_id, source, freshness,
      CASE WHEN freshness <> 'unknown' THEN last_success_age_seconds END AS last_success_age_seconds,
      freshness_warning_seconds, freshness_stale_seconds FROM judged"""
)
def sync_freshness(spark, folder):
    return _fresh(spark, folder).select(*FRESH_COLUMNS)


@query(
    with_views(SYNC, FRESH)
    + """SELECT document_id, CASE WHEN bool_or(freshness = 'stale') THEN 'stale'
      WHEN bool_or(freshness = 'warning') THEN 'warning' WHEN bool_and(freshness = 'fresh') THEN 'fresh'
      ELSE 'unknown' END AS overall_freshness FROM judged GROUP BY document_id"""
)
def overall_freshness(spark, folder):
    return O.overall_freshness(_fresh(spark, folder))


STREAKS = """finished AS (SELECT * FROM executions WHERE finished_at IS NOT NULL),
streaks AS (
  SELECT *, count(*) FILTER (NOT success) OVER (PARTITION BY label, resets ORDER BY finished_at, execution_id
    ROWS UNBOUNDED PRECEDING) AS consecutive_failures
  FROM (SELECT *, count(*) FILTER (success) OVER (PARTITION BY label ORDER BY finished_at, execution_id
    ROWS UNBOUNDED PRECEDING) AS resets FROM finished)
)"""
DELAY = "least(1800, 60 * pow(2, consecutive_failures - 1))::BIGINT"


@query(
    with_views(EXECUTIONS, STREAKS)
    + f"""SELECT execution_id, label, consecutive_failures,
      CASE WHEN NOT success THEN epoch_us(finished_at) + {DELAY} * 1000000 END AS next_retry_us FROM streaks"""
)
def failure_streak(spark, folder):
    rows = O.failure_streaks(V.executions(spark, folder))
    return rows.select(
        "execution_id", "label", F.col("consecutive_failures").cast("bigint").alias("consecutive_failures"),
        F.unix_micros("next_retry_at").alias("next_retry_us"),
    )


DUE_AT_US = EVENTS_NOW_US - 23 * 3_600_000_000


@query(
    with_views(EXECUTIONS, STREAKS)
    + f"""SELECT priority, label, next_due_us FROM (
      SELECT p.priority::INTEGER AS priority, p.label,
        CASE WHEN s.success THEN epoch_us(s.finished_at) + interval_s::BIGINT * 1000000
          ELSE epoch_us(s.finished_at) + {DELAY} * 1000000 END AS next_due_us
      FROM (VALUES (0, 'satcat', 43200), (1, 'celestrak', 7200), (2, 'space-track', 3600)) p(priority, label, interval_s)
      LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY finished_at DESC, execution_id DESC) AS n
        FROM streaks) WHERE n = 1) s ON s.label = p.label)
    WHERE next_due_us IS NULL OR next_due_us <= {DUE_AT_US} ORDER BY priority"""
)
def due_sources(spark, folder):
    due = O.due_providers(V.executions(spark, folder), F.timestamp_micros(F.lit(DUE_AT_US)))
    return due.select("priority", "label", F.unix_micros("next_due_at").alias("next_due_us"))


DUE = f"""due_runs AS (SELECT user_id AS key, max(ts) FILTER (event_type = 'purchase') AS completed_at,
    arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS run_id,
    max(ts) FILTER (event_type = 'error') AS failed_at,
    count(*) FILTER (event_type = 'error') % 7 AS failures FROM events GROUP BY user_id)"""


@query(
    with_views(DUE)
    + f"""SELECT key, latest_run_id, next_due_us, due, CASE
        WHEN failing THEN CASE WHEN due THEN 'retry_due' ELSE 'retry_pending' END
        WHEN latest_run_id IS NULL THEN 'no_successful_run'
        WHEN due THEN 'cadence_due' ELSE 'cadence_pending' END AS reason,
      coalesce(NOT failing AND completed_at > TIMESTAMP '2024-01-30 20:00:00', false) AS future_completion
    FROM (SELECT *, next_due_us IS NULL OR next_due_us <= epoch_us(TIMESTAMP '2024-01-30 20:00:00') AS due FROM (
      SELECT key, run_id AS latest_run_id, completed_at,
        failed_at IS NOT NULL AND (completed_at IS NULL OR completed_at <= failed_at) AS failing,
        CASE WHEN failing THEN epoch_us(failed_at) + least(3600, 900 * pow(2, greatest(failures, 1) - 1))::BIGINT * 1000000
          ELSE epoch_us(completed_at) + 14400000000 END AS next_due_us FROM due_runs))"""
)
def screening_due(spark, folder):
    events = V.table(spark, folder, "events").withColumn("at", F.timestamp_micros(V.micros("ts")))
    runs = events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("run_id"), F.col("at").alias("completed_at")
    )
    failed = F.col("event_type") == "error"
    states = events.groupBy(F.col("user_id").alias("key")).agg(
        F.max(F.when(failed, F.col("at"))).alias("last_completed_at"),
        (F.count_if(failed) % 7).alias("consecutive_failures"),
    ).select(
        "key",
        F.when(F.col("last_completed_at").isNotNull(), "error").alias("last_status"),
        "last_completed_at",
        "consecutive_failures",
        F.lit(None).cast("timestamp").alias("next_retry_at"),
    )
    now = F.timestamp_micros(F.lit(EVENTS_NOW_US - 28 * 3_600_000_000))
    rows = O.screening_due(runs, states, now)
    return rows.withColumn("next_due_us", F.unix_micros("next_due_at")).drop("next_due_at")


@query("SELECT event_id, least(1800, 60 * pow(2, (event_id % 12)))::BIGINT AS delay_seconds FROM events")
def retry_delays(spark, folder):
    events = V.table(spark, folder, "events")
    return events.select(
        "event_id", retry_delay_seconds(F.col("event_id") % 12 + 1, K.FEED_RETRY).alias("delay_seconds")
    )


SERIES = """series AS (SELECT 'api' AS job, 'i-' || (user_id % 4)::VARCHAR AS instance, user_id AS source,
  ts, (event_id % 100)::DOUBLE AS value FROM events)"""


def series(spark, folder):
    """A counter per user that resets now and then."""
    user = F.col("user_id")
    return V.table(spark, folder, "events").select(
        F.lit("api").alias("job"),
        F.concat(F.lit("i-"), (user % 4).cast("string")).alias("instance"),
        user.alias("source"),
        F.timestamp_micros(V.micros("ts")).alias("ts"),
        (F.col("event_id") % 100).cast("double").alias("value"),
    )


SERIES_LABELS = ["job", "instance", "source"]


@query(
    with_views(SERIES)
    + """, deltas AS (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN value >= before THEN value - before ELSE value END AS delta
      FROM (SELECT *, lag(value) OVER (PARTITION BY source ORDER BY ts) AS before FROM series)),
    placed AS (SELECT *, unnest(range(0, 15)) AS k FROM deltas WHERE delta > 0)
    SELECT job, instance, source, epoch_us(date_trunc('minute', ts)) - k * 60000000 AS window_start_us,
      sum(delta) AS increase FROM placed GROUP BY ALL"""
)
def failure_increase(spark, folder):
    grown = A.counter_increase(series(spark, folder), SERIES_LABELS)
    return grown.select(*SERIES_LABELS, F.unix_micros("window_start").alias("window_start_us"), "increase")


@query(
    with_views(SERIES)
    + """, flagged AS (SELECT *, value > 30 AS active FROM series),
    runs AS (SELECT *, count(*) FILTER (NOT active) OVER (PARTITION BY instance ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
      FROM flagged)
    SELECT instance, epoch_us(ts) AS ts_us, CASE WHEN NOT active THEN 'inactive'
      WHEN epoch_us(ts) - epoch_us(since) >= 600000000 THEN 'firing' ELSE 'pending' END AS state,
      CASE WHEN active THEN epoch_us(since) END AS active_since_us
    FROM (SELECT *, min(ts) FILTER (active) OVER (PARTITION BY instance, run) AS since FROM runs)"""
)
def alert_hold(spark, folder):
    samples = series(spark, folder).withColumn("active", F.col("value") > 30)
    held = A.hold_for(samples, ["instance"], 600)
    return held.select(
        "instance", F.unix_micros("ts").alias("ts_us"), "state", F.unix_micros("active_since").alias("active_since_us")
    )


AVAILABLE = "available AS (SELECT DISTINCT job, instance FROM executions WHERE instance <> 'i-2')"


def _available(executions):
    return executions.filter("instance <> 'i-2'").select("job", "instance").distinct()


@query(
    with_views(EXECUTIONS, AVAILABLE)
    + f"""SELECT job, instance, provider, epoch_us(last_success) AS last_success_us FROM (
      SELECT job, instance, provider, max(finished_at) AS last_success FROM executions WHERE success GROUP BY ALL)
    SEMI JOIN available USING (job, instance)
    WHERE epoch_us({EVENTS_NOW_SQL}) - epoch_us(last_success) >
      1000000::BIGINT * CASE provider WHEN 'satcat' THEN 86400 WHEN 'celestrak' THEN 14400 ELSE 7200 END"""
)
def staleness(spark, folder):
    rows = V.executions(spark, folder)
    old = A.stale_providers(rows, _available(rows), events_now())
    return old.select("job", "instance", "provider", F.unix_micros("last_success").alias("last_success_us"))


@query(
    """SELECT event_id, CASE WHEN earth_orbit > 0 THEN eligible / earth_orbit END AS ratio,
      earth_orbit > 0 AND eligible / earth_orbit < 0.75 AS active
    FROM (SELECT event_id, floor(value)::DOUBLE AS eligible, floor(user_id % 60)::DOUBLE AS earth_orbit FROM events)"""
)
def coverage_alert(spark, folder):
    samples = V.table(spark, folder, "events").select(
        "event_id", F.floor("value").alias("eligible"), (F.col("user_id") % 60).alias("earth_orbit")
    )
    return A.coverage_condition(samples).select("event_id", "ratio", "active")


RECENT_AT_US = V.EPOCH_BASE_US + 10 * 86_400_000_000


@query(
    with_views(CONJUNCTIONS, RUNS)
    + f"""SELECT job, instance, run_id, propagation_failures FROM (
      SELECT *, row_number() OVER (PARTITION BY job, instance ORDER BY run_id DESC) AS n FROM (
        SELECT *, 'api' AS job, 'i-' || (run_id % 4)::VARCHAR AS instance,
          {RECENT_AT_US} - epoch_us(completed_at) AS age FROM runs))
    WHERE n = 1 AND propagation_failures > 0 AND age >= 0 AND age < 1000000000000 AND instance <> 'i-2'"""
)
def recent_failures(spark, folder):
    runs = V.runs(spark, folder).select(
        F.lit("api").alias("job"),
        F.concat(F.lit("i-"), (F.col("run_id") % 4).cast("string")).alias("instance"),
        "run_id", "propagation_failures",
        # Ages in the mapped data are days; a thousandth of them keeps their order.
        F.timestamp_micros(
            F.lit(RECENT_AT_US) - ((F.lit(RECENT_AT_US) - F.unix_micros("completed_at")) * 9 / 10000).cast("bigint")
        ).alias("completed_at"),
    )
    hit = A.recent_run_failures(runs, _available(runs), "propagation_failures", F.timestamp_micros(F.lit(RECENT_AT_US)))
    return hit.select("job", "instance", "run_id", "propagation_failures")


ALERTS = """alerts AS (SELECT event_id, 'alert-' || (user_id % 5)::VARCHAR AS alertname,
  CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN user_id % 2 = 0 THEN 'ingestion' ELSE 'conjunction' END AS component,
  CASE WHEN event_id % 3 = 0 THEN 'p-' || (event_id % 200)::VARCHAR END AS provider,
  CASE WHEN event_id % 3 = 1 THEN 's-' || (event_id % 400)::VARCHAR
    WHEN event_id % 3 = 2 THEN 't-' || (event_id % 1000)::VARCHAR END AS source, ts FROM events)"""


def alerts(spark, folder):
    key, user = F.col("event_id"), F.col("user_id")
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    return V.table(spark, folder, "events").select(
        "event_id",
        text("alert-", user % 5).alias("alertname"),
        F.when(F.col("event_type") == "error", "critical").otherwise("warning").alias("severity"),
        F.when(user % 2 == 0, "ingestion").otherwise("conjunction").alias("component"),
        F.when(key % 3 == 0, text("p-", key % 200)).alias("provider"),
        F.when(key % 3 == 1, text("s-", key % 400)).when(key % 3 == 2, text("t-", key % 1000)).alias("source"),
        F.timestamp_micros(V.micros("ts")).alias("ts"),
    )


@query(
    with_views(ALERTS)
    + """SELECT alertname, severity, component, count(*) AS alerts, epoch_us(min(ts)) AS first_us,
      epoch_us(max(ts)) AS last_us FROM alerts GROUP BY ALL"""
)
def alert_groups(spark, folder):
    groups = A.alert_groups(alerts(spark, folder))
    return groups.select(
        "alertname", "severity", "component", "alerts",
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
    )


@query(
    with_views(ALERTS)
    + """SELECT event_id FROM alerts w WHERE NOT (severity = 'warning' AND EXISTS (
      SELECT 1 FROM alerts c WHERE c.severity = 'critical' AND c.alertname = w.alertname AND c.component = w.component
        AND c.provider IS NOT DISTINCT FROM w.provider AND c.source IS NOT DISTINCT FROM w.source))"""
)
def inhibition(spark, folder):
    return A.inhibited(alerts(spark, folder)).select("event_id")


LOGS = """lines AS (
  SELECT event_type AS service, CASE WHEN user_id % 10 = 0 THEN 'elsewhere' ELSE 'sky' END AS project, ts,
    event_type || ' of ' || user_id::VARCHAR || ' ' || props AS line FROM events
  UNION ALL
  SELECT role, CASE WHEN conv_id % 10 = 0 THEN 'elsewhere' ELSE 'sky' END,
    TIMESTAMP '2024-01-28 00:00:00' + to_minutes(conv_id) + to_seconds(turn), text FROM conversations
), labelled AS (SELECT 'sky' AS platform, service AS service_name, ts, line FROM lines WHERE project = 'sky')"""
LEVEL = "regexp_matches(line, '(?i)(error|exception|traceback|failed|warning|warn)')"


def log_lines(spark, folder):
    user = F.col("user_id")
    events = V.table(spark, folder, "events").select(
        F.col("event_type").alias("service"),
        F.when(user % 10 == 0, "elsewhere").otherwise("sky").alias("project"),
        F.timestamp_micros(V.micros("ts")).alias("ts"),
        F.concat(F.col("event_type"), F.lit(" of "), user.cast("string"), F.lit(" "), F.col("props")).alias("line"),
    )
    seconds = F.col("conv_id") * 60 + F.col("turn")
    talk = V.table(spark, folder, "conversations").select(
        F.col("role").alias("service"),
        F.when(F.col("conv_id") % 10 == 0, "elsewhere").otherwise("sky").alias("project"),
        F.timestamp_micros(F.lit(EVENTS_NOW_US - 4 * 86_400_000_000) + seconds * 1_000_000).alias("ts"),
        F.col("text").alias("line"),
    )
    return G.labelled(events.unionByName(talk), "sky", "sky")


@query(
    with_views(LOGS)
    + f"""SELECT service_name, epoch_us(date_trunc('minute', ts)) AS window_us, count(*) AS lines,
      count(*) FILTER ({LEVEL}) AS alarming FROM labelled GROUP BY ALL"""
)
def log_levels(spark, folder):
    counts = G.level_counts(log_lines(spark, folder))
    return counts.select("service_name", F.unix_micros("window_start").alias("window_us"), "lines", "alarming")


@query(
    with_views(LOGS)
    + """SELECT service_name, ts::DATE AS day, count(*) AS lines, min(epoch_us(ts)) AS first_us FROM labelled
      WHERE ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 150 HOUR GROUP BY ALL"""
)
def log_retention(spark, folder):
    """Lines stored by day in two batches; retention runs before the second batch and, later
    on, after it, in the middle of a day. What stays is read back."""
    lines = log_lines(spark, folder)
    stored = LogTable(spark, new_folder(spark, "logs"))
    alarming = F.col("line").rlike(K.LOG_LEVEL_PATTERN)
    stored.append(lines.filter(alarming), "alarming")
    stored.expire(EVENTS_NOW_US, 160)
    stored.append(lines.filter(~alarming), "quiet")
    stored.expire(EVENTS_NOW_US, 150)
    rows = stored.read().groupBy("service_name", F.to_date("ts").alias("day"))
    return rows.agg(F.count("*").alias("lines"), F.min(F.unix_micros("ts")).alias("first_us"))


@query(
    with_views(LOGS)
    + f"""SELECT service_name, epoch_us(ts) AS ts_us, line FROM labelled
      WHERE {LEVEL} AND service_name IN ('error', 'user', 'assistant')
        AND ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 168 HOUR"""
)
def log_search(spark, folder):
    rows = G.of_services(log_lines(spark, folder), "error", "user", "assistant")
    rows = G.errors_and_warnings(G.retained(rows, events_now()))
    return rows.select("service_name", F.unix_micros("ts").alias("ts_us"), "line")
