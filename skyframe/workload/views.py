"""The given tables seen as catalogue data, in Spark and in ANSI SQL.

Every view is plain arithmetic on whole tables, written once as a Spark frame and
once as a SQL common table expression, so that results can be compared.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe import constants as K
from skyframe.session import configure
from skyframe.sources.tables import read_table

# The instant at which the catalogue is judged, and the screening window's start.
NOW = datetime(2026, 1, 9, 8, 0, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '2026-01-09 08:00:00'"
EPOCH_BASE_US = 1_767_225_600_000_000  # 2026-01-01T00:00:00Z
NOW_US = EPOCH_BASE_US + 8 * 86_400_000_000 + 8 * 3_600_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(configure(spark), folder, name)


def now() -> Column:
    return F.timestamp_micros(F.lit(NOW_US))


def micros(column: str) -> Column:
    """A stored time without a zone as microseconds, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def objects(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    key = F.col("c_custkey")
    codes = F.array(*[F.lit(c) for c in ("+", "-", "P", "B", "S", "X", "D", "?", "Z")])
    kind = (
        F.when(F.col("c_mktsegment") == "BUILDING", "PAYLOAD")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "ROCKET_BODY")
        .when(F.col("c_mktsegment") == "MACHINERY", "DEBRIS")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "rocket-body")
    )
    decay = F.when(F.col("c_acctbal") < 0, F.date_add(F.lit("2020-01-01").cast("date"), (key % 1000).cast("int")))
    center = F.when(key % 10 == 0, "MO").otherwise("EA")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        (key + 10000).alias("id"),
        (key + 10000).alias("norad_cat_id"),
        F.col("c_name").alias("object_name"),
        F.when(key % 11 != 0, F.concat(F.lit("1998-"), (key % 1000).cast("string"), F.lit("A"))).alias("object_id"),
        kind.alias("object_type"),
        F.when(key % 10 != 9, F.element_at(codes, (key % 10 + 1).cast("int"))).alias("ops_status_code"),
        F.col("n_name").alias("owner"),
        F.col("n_name").alias("country_code"),
        F.date_add(F.lit("1990-01-01").cast("date"), (key % 9000).cast("int")).alias("launch_date"),
        F.concat(F.lit("SITE-"), F.col("c_nationkey").cast("string")).alias("launch_site"),
        decay.alias("decay_date"),
        (90.0 + key % 100).alias("period_minutes"),
        (key % 180).cast("double").alias("inclination_deg"),
        (500.0 + key % 1000).alias("apogee_km"),
        (400.0 + key % 100).alias("perigee_km"),
        F.col("c_acctbal").alias("rcs_m2"),
        F.lit(None).cast("string").alias("data_status_code"),
        center.alias("orbit_center"),
        F.lit("ORB").alias("orbit_type"),
        decay.isNull().alias("is_on_orbit"),
        (decay.isNull() & (center == "EA")).alias("is_earth_orbit"),
        (key % 4 != 0).alias("has_current_elements"),
        F.lit("celestrak").alias("source"),
    )


OBJECTS = """objects AS (
  SELECT o.*, decay_date IS NULL AS is_on_orbit,
         decay_date IS NULL AND orbit_center = 'EA' AS is_earth_orbit
  FROM (
    SELECT c_custkey + 10000 AS id, c_custkey + 10000 AS norad_cat_id, c_name AS object_name,
      CASE WHEN c_custkey % 11 <> 0 THEN '1998-' || (c_custkey % 1000)::VARCHAR || 'A' END AS object_id,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'PAYLOAD' WHEN 'AUTOMOBILE' THEN 'ROCKET_BODY'
        WHEN 'MACHINERY' THEN 'DEBRIS' WHEN 'HOUSEHOLD' THEN 'rocket-body' END AS object_type,
      CASE WHEN c_custkey % 10 <> 9
        THEN ['+', '-', 'P', 'B', 'S', 'X', 'D', '?', 'Z'][c_custkey % 10 + 1] END AS ops_status_code,
      n_name AS owner, n_name AS country_code,
      CAST(DATE '1990-01-01' + (c_custkey % 9000)::INTEGER AS DATE) AS launch_date,
      'SITE-' || c_nationkey::VARCHAR AS launch_site,
      CASE WHEN c_acctbal < 0 THEN CAST(DATE '2020-01-01' + (c_custkey % 1000)::INTEGER AS DATE) END AS decay_date,
      (90 + c_custkey % 100)::DOUBLE AS period_minutes, (c_custkey % 180)::DOUBLE AS inclination_deg,
      (500 + c_custkey % 1000)::DOUBLE AS apogee_km, (400 + c_custkey % 100)::DOUBLE AS perigee_km,
      c_acctbal AS rcs_m2, NULL::VARCHAR AS data_status_code,
      CASE WHEN c_custkey % 10 = 0 THEN 'MO' ELSE 'EA' END AS orbit_center, 'ORB' AS orbit_type,
      c_custkey % 4 <> 0 AS has_current_elements, 'celestrak' AS source
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  ) o
)"""


def epoch_us(column: str = "o_orderdate") -> Column:
    """Order days squeezed to five minutes each, from the base instant."""
    days = F.datediff(F.col(column).cast("date"), F.lit("1995-01-01").cast("date"))
    return F.lit(EPOCH_BASE_US) + days.cast("bigint") * 300_000_000


def _source() -> Column:
    rank = F.col("o_orderpriority")
    return (
        F.when(rank.isin("1-URGENT", "2-HIGH"), "space-track")
        .when(rank.isin("3-MEDIUM", "5-LOW"), "celestrak")
        .otherwise("other-source")
    )


def elements(spark: SparkSession, folder: str) -> DataFrame:
    """Twin objects share an orbit; few orbits are broken on purpose."""
    orbit = F.floor(F.col("o_custkey") / 2)
    orders = table(spark, folder, "orders").withColumn("c", orbit)
    c = F.col("c")
    return orders.select(
        F.col("o_orderkey").alias("element_id"),
        (F.col("o_custkey") + 10000).alias("object_id"),
        _source().alias("source"),
        F.timestamp_micros(epoch_us()).alias("epoch"),
        (30.0 + (c * 613 % 7000) / 100.0).alias("inclination"),
        ((c * 1327 % 3600) / 10.0).alias("ra_of_asc_node"),
        F.when(c % 211 == 7, 1.5).when(c % 97 == 5, 0.2).otherwise((c * 31 % 1000) / 100000.0).alias("eccentricity"),
        ((c * 2741 % 3600) / 10.0).alias("arg_of_pericenter"),
        ((c * 4271 % 3600) / 10.0).alias("mean_anomaly"),
        (11.25 + (c * 7919 % 45000) / 10000.0).alias("mean_motion"),
        F.when(c % 3 != 0, (c % 100) / 1000000.0).alias("mean_motion_dot"),
        F.lit(None).cast("double").alias("mean_motion_ddot"),
        ((c % 1000) / 10000000.0).alias("bstar"),
    )


ELEMENTS = """elements AS (
  SELECT o_orderkey AS element_id, o_custkey + 10000 AS object_id,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'space-track'
      WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'celestrak' ELSE 'other-source' END AS source,
    TIMESTAMP '2026-01-01 00:00:00'
      + to_minutes(5 * date_diff('day', DATE '1995-01-01', o_orderdate::DATE)) AS epoch,
    30.0::DOUBLE + (c * 613 % 7000) / 100.0::DOUBLE AS inclination,
    (c * 1327 % 3600) / 10.0::DOUBLE AS ra_of_asc_node,
    CASE WHEN c % 211 = 7 THEN 1.5::DOUBLE WHEN c % 97 = 5 THEN 0.2::DOUBLE
      ELSE (c * 31 % 1000) / 100000.0::DOUBLE END AS eccentricity,
    (c * 2741 % 3600) / 10.0::DOUBLE AS arg_of_pericenter,
    (c * 4271 % 3600) / 10.0::DOUBLE AS mean_anomaly,
    11.25::DOUBLE + (c * 7919 % 45000) / 10000.0::DOUBLE AS mean_motion,
    CASE WHEN c % 3 <> 0 THEN (c % 100) / 1000000.0::DOUBLE END AS mean_motion_dot,
    NULL::DOUBLE AS mean_motion_ddot,
    (c % 1000) / 10000000.0::DOUBLE AS bstar
  FROM (SELECT *, o_custkey // 2 AS c FROM orders)
)"""


def straight_states(spark: SparkSession, folder: str) -> DataFrame:
    """One state per order and line number: straight motion along a lattice that
    grows with the table, so its density does not. Ten seconds lie between samples."""
    lines = table(spark, folder, "lineitem")
    grouped = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    vx, vy, vz = (k * 31 % 1009 - 504) / 100.0, (k * 57 % 1013 - 506) / 100.0, (k * 83 % 1019 - 509) / 100.0
    t = (n - 1) * 10.0
    return grouped.select(
        k.alias("object_id"),
        (F.lit(EPOCH_BASE_US) + (n - 1).cast("bigint") * 10_000_000).alias("sample_us"),
        (7000.0 + k * 0.5 + vx * t + F.col("q") * 0.01).alias("x"),
        ((k * 7919 % 20011) / 10.0 + vy * t).alias("y"),
        ((k * 104729 % 19997) / 10.0 + vz * t).alias("z"),
        vx.alias("vx"), vy.alias("vy"), vz.alias("vz"),
    )


STRAIGHT_STATES = f"""states AS (
  SELECT l_orderkey AS object_id, {EPOCH_BASE_US} + (l_linenumber - 1)::BIGINT * 10000000 AS sample_us,
    7000.0::DOUBLE + l_orderkey * 0.5::DOUBLE + vx * t + q * 0.01::DOUBLE AS x,
    (l_orderkey * 7919 % 20011) / 10.0::DOUBLE + vy * t AS y,
    (l_orderkey * 104729 % 19997) / 10.0::DOUBLE + vz * t AS z, vx, vy, vz
  FROM (
    SELECT l_orderkey, l_linenumber, max(l_quantity) AS q,
      (l_orderkey * 31 % 1009 - 504) / 100.0::DOUBLE AS vx,
      (l_orderkey * 57 % 1013 - 506) / 100.0::DOUBLE AS vy,
      (l_orderkey * 83 % 1019 - 509) / 100.0::DOUBLE AS vz, (l_linenumber - 1) * 10.0::DOUBLE AS t
    FROM lineitem GROUP BY l_orderkey, l_linenumber
  )
)"""


def conjunctions(spark: SparkSession, folder: str) -> DataFrame:
    """Stored events: each order with the order after it, in monthly runs."""
    orders = table(spark, folder, "orders")
    after = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("next_cust"))
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    primary = F.col("o_custkey") + 10000
    return orders.join(after, "o_orderkey", "left").select(
        key.alias("event_id"),
        month.cast("bigint").alias("run_id"),
        primary.alias("primary_object_id"),
        F.when(key % 13 == 0, primary).otherwise(F.col("next_cust") + 10000).alias("secondary_object_id"),
        key.alias("primary_element_id"),
        (key + 1).alias("secondary_element_id"),
        F.timestamp_micros(epoch_us() + cents % 20000 * 1_000_000).alias("tca"),
        ((cents % 10000) / 1000.0).alias("miss_distance_km"),
        ((key % 1500) / 100.0).alias("relative_velocity_km_s"),
        F.lit("numerical-propagation").alias("method"),
    )


CONJUNCTIONS = """conjunctions AS (
  SELECT o.o_orderkey AS event_id,
    ((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate))::BIGINT AS run_id,
    o.o_custkey + 10000 AS primary_object_id,
    CASE WHEN o.o_orderkey % 13 = 0 THEN o.o_custkey + 10000 ELSE n.o_custkey + 10000 END AS secondary_object_id,
    o.o_orderkey AS primary_element_id, o.o_orderkey + 1 AS secondary_element_id,
    TIMESTAMP '2026-01-01 00:00:00'
      + to_minutes(5 * date_diff('day', DATE '1995-01-01', o.o_orderdate::DATE))
      + to_seconds(round(o.o_totalprice * 100)::BIGINT % 20000) AS tca,
    (round(o.o_totalprice * 100)::BIGINT % 10000) / 1000.0::DOUBLE AS miss_distance_km,
    (o.o_orderkey % 1500) / 100.0::DOUBLE AS relative_velocity_km_s,
    'numerical-propagation' AS method
  FROM orders o LEFT JOIN orders n ON n.o_orderkey = o.o_orderkey + 1
)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run headers summed up from the stored events."""
    events = conjunctions(spark, folder)
    return _runs(
        events.groupBy("run_id").agg(
            F.min("tca").alias("window_start"),
            F.max("tca").alias("last_tca"),
            F.count("*").alias("event_count"),
        )
    )


def _runs(grouped: DataFrame) -> DataFrame:
    run, n = F.col("run_id"), F.col("event_count")
    late = F.when(run % 5 == 0, 600_000_000).otherwise(0)
    return grouped.select(
        "run_id",
        F.when(run % 7 == 0, "celestrak").otherwise("canonical").alias("source"),
        "window_start",
        F.timestamp_micros(F.unix_micros("last_tca") - late).alias("window_end"),
        F.lit(60).cast("bigint").alias("step_seconds"),
        (n * 3).alias("objects"),
        (n + 1).alias("samples"),
        (run % 9 + 1).alias("chunk_count"),
        F.lit(900).cast("bigint").alias("chunk_seconds"),
        (n * 30).alias("propagation_attempts"),
        (run % 4).alias("propagation_failures"),
        (run % 6).alias("expired_skips"),
        (n * 50).alias("raw_candidates"),
        (n * 20).alias("unique_candidates"),
        (n * 5).alias("refinement_attempts"),
        (run % 3).alias("refinement_failures"),
        (run % 8).alias("duplicate_events_suppressed"),
        (run % 2).alias("suppressed_shared_pairs"),
        (n * 25).alias("max_chunk_raw_candidates"),
        (n * 10).alias("max_chunk_unique_candidates"),
        (n * 2).alias("max_chunk_refinement_attempts"),
        "event_count",
        (n * 1.5).alias("duration_ms"),
        F.timestamp_micros(F.unix_micros("window_start") + 1_000_000).alias("started_at"),
        F.timestamp_micros(F.unix_micros("last_tca") + 60_000_000).alias("completed_at"),
    )


RUNS = """runs AS (
  SELECT run_id, CASE WHEN run_id % 7 = 0 THEN 'celestrak' ELSE 'canonical' END AS source, window_start,
    last_tca - to_seconds(CASE WHEN run_id % 5 = 0 THEN 600 ELSE 0 END) AS window_end,
    60::BIGINT AS step_seconds, n * 3 AS objects, n + 1 AS samples, run_id % 9 + 1 AS chunk_count,
    900::BIGINT AS chunk_seconds, n * 30 AS propagation_attempts, run_id % 4 AS propagation_failures,
    run_id % 6 AS expired_skips, n * 50 AS raw_candidates, n * 20 AS unique_candidates,
    n * 5 AS refinement_attempts, run_id % 3 AS refinement_failures,
    run_id % 8 AS duplicate_events_suppressed, run_id % 2 AS suppressed_shared_pairs,
    n * 25 AS max_chunk_raw_candidates, n * 10 AS max_chunk_unique_candidates,
    n * 2 AS max_chunk_refinement_attempts, n AS event_count, n * 1.5::DOUBLE AS duration_ms,
    window_start + to_seconds(1) AS started_at, last_tca + to_seconds(60) AS completed_at
  FROM (SELECT run_id, min(tca) AS window_start, max(tca) AS last_tca, count(*) AS n
        FROM conjunctions GROUP BY run_id)
)"""


def executions(spark: SparkSession, folder: str) -> DataFrame:
    """Feed executions: one per stream event."""
    key, user = F.col("event_id"), F.col("user_id")
    unfinished = (F.col("event_type") == "signup") & (key % 5 == 0)
    millis = F.round(F.col("value") * 1000).cast("bigint")
    return table(spark, folder, "events").select(
        key.alias("execution_id"),
        F.when(key % 10 == 0, key - 3).alias("parent_id"),
        F.when(user % 5 == 4, "conjunction").otherwise("ingestion").alias("kind"),
        provider(user).alias("label"),
        provider(user).alias("provider"),
        F.lit("api").alias("job"),
        F.concat(F.lit("i-"), (user % 4).cast("string")).alias("instance"),
        F.timestamp_micros(micros("ts")).alias("started_at"),
        F.when(~unfinished, F.timestamp_micros(micros("ts") + millis * 1000)).alias("finished_at"),
        ((F.col("event_type") != "error") & ~unfinished).alias("success"),
        F.col("value").alias("duration"),
    )


def provider(user: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in K.PROVIDERS]), (user % 3 + 1).cast("int"))


EXECUTIONS = """executions AS (
  SELECT *, event_type <> 'error' AND finished_at IS NOT NULL AS success FROM (
    SELECT event_id AS execution_id, CASE WHEN event_id % 10 = 0 THEN event_id - 3 END AS parent_id,
      CASE WHEN user_id % 5 = 4 THEN 'conjunction' ELSE 'ingestion' END AS kind,
      ['satcat', 'celestrak', 'space-track'][user_id % 3 + 1] AS label,
      ['satcat', 'celestrak', 'space-track'][user_id % 3 + 1] AS provider,
      'api' AS job, 'i-' || (user_id % 4)::VARCHAR AS instance, ts AS started_at,
      CASE WHEN NOT (event_type = 'signup' AND event_id % 5 = 0)
        THEN ts + to_milliseconds(round(value * 1000)::BIGINT) END AS finished_at,
      value AS duration, event_type
    FROM events)
)"""
EVENTS_NOW_US = 1_706_745_600_000_000  # 2024-02-01T00:00:00Z
EVENTS_NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
