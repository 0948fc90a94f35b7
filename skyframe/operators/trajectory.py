"""Snapshots, trajectories, playback, replay windows and interpolation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyframe import constants as K
from skyframe.functions.orbit import KeplerJ2, OrbitModel, earth_fixed
from skyframe.functions.quality import MICROS, QualityLimits, ephemeris_status, propagation_allowed
from skyframe.operators.propagation import sample_times_us, utc_micros
from skyframe.operators.selection import judge_canonical, latest_by_source

OBJECT_FACTS = (
    "norad_cat_id", "object_name", "object_type", "owner", "launch_date", "launch_site",
    "ops_status_code",
)
OUTCOMES = ("rendered", "expired", "failed")


def window_problem(start: Column, end: Column, step_seconds: Column) -> Column:
    """Why a requested window is refused; null for an acceptable one."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS))
    return (
        F.when(seconds <= 0, F.lit("end must be after start"))
        .when(step_seconds < K.MIN_STEP_SECONDS, F.lit("step_seconds must be at least 10"))
        .when(seconds > K.MAX_WINDOW_HOURS * 3600, F.lit("window cannot exceed 24 hours"))
        .when(
            F.floor(seconds / step_seconds) + 1 > K.MAX_POINTS_PER_OBJECT,
            F.lit("window cannot exceed 1000 points per object"),
        )
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``problem``) window requests."""
    judged = requests.withColumn(
        "problem", window_problem(F.col("start"), F.col("end"), F.col("step_seconds"))
    )
    return judged.filter("problem IS NULL").drop("problem"), judged.filter("problem IS NOT NULL")


def check_window(start: datetime, end: datetime, step_seconds: int) -> None:
    """The same limits for one window given as arguments."""
    seconds = (utc_micros(end) - utc_micros(start)) / MICROS
    if seconds <= 0:
        raise ValueError("end must be after start")
    if step_seconds < K.MIN_STEP_SECONDS:
        raise ValueError("step_seconds must be at least 10")
    if seconds > K.MAX_WINDOW_HOURS * 3600:
        raise ValueError("window cannot exceed 24 hours")
    if int(seconds / step_seconds) + 1 > K.MAX_POINTS_PER_OBJECT:
        raise ValueError("window cannot exceed 1000 points per object")


def _with_facts(elements: DataFrame, objects: DataFrame) -> DataFrame:
    facts = objects.select(F.col("id").alias("object_id"), *OBJECT_FACTS)
    return elements.join(facts, "object_id", "left")


def _metres(kind: str = "") -> list[Column]:
    unit = "_m_s" if kind else "_m"
    return [(F.col(kind + axis) * 1000.0).alias(kind + axis + unit) for axis in "xyz"]


def snapshot(
    elements: DataFrame,
    objects: DataFrame,
    when: datetime,
    source: str = "canonical",
    model: OrbitModel = KeplerJ2(),
    limits: QualityLimits = QualityLimits(),
) -> DataFrame:
    """Every considered element at ``when`` with an ``outcome``: rendered rows hold
    attributes, status, earth-fixed position (m) and velocity (m/s)."""
    at_us = utc_micros(when)
    at = F.timestamp_micros(F.lit(at_us))
    if source == "canonical":
        chosen = judge_canonical(elements, objects, at, limits).drop(
            "object_type", "is_earth_orbit", "age_seconds", "age_hours", "status", "allowed"
        )
    else:
        chosen = latest_by_source(elements, source).withColumn(
            "eligible", propagation_allowed(F.col("epoch"), at, limits)
        )
    rows = _with_facts(model.prepare(chosen), objects).withColumn("at_us", F.lit(at_us))
    rows = earth_fixed(model.state_at(rows, "at_us"), "at_us")
    # Canonical selection drops an element before its object is looked up; a
    # source's latest element fails first when the object is unknown.
    unknown = F.col("norad_cat_id").isNull()
    expired = ~F.col("eligible") if source == "canonical" else ~F.col("eligible") & ~unknown
    outcome = (
        F.when(expired, F.lit("expired"))
        .when(unknown | F.col("error").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("rendered"))
    )
    return rows.select(
        "object_id", "element_id", *OBJECT_FACTS, "epoch",
        ephemeris_status(F.col("epoch"), at, limits).alias("ephemeris_status"),
        *_metres(), *_metres("v"),
        outcome.alias("outcome"),
    )


def outcome_counts(rows: DataFrame) -> DataFrame:
    """total_elements, rendered_objects, expired_skips, propagation_failures."""
    return rows.agg(
        F.count("*").alias("total_elements"),
        F.count_if(F.col("outcome") == "rendered").alias("rendered_objects"),
        F.count_if(F.col("outcome") == "expired").alias("expired_skips"),
        F.count_if(F.col("outcome") == "failed").alias("propagation_failures"),
    )


def sampled_points(
    prepared: DataFrame,
    start_us: Column,
    end_us: Column,
    step_seconds: int,
    model: OrbitModel,
    limits: QualityLimits,
) -> DataFrame:
    """Earth-fixed points (m) of prepared elements over their window, with
    ``allowed``, ``on_grid`` and ``error`` per point."""
    times = sample_times_us(start_us, end_us, step_seconds)
    step = step_seconds * MICROS
    points = prepared.select("*", F.posexplode(times).alias("point", "at_us")).withColumn(
        "on_grid", (F.col("at_us") - start_us) % step == 0
    )
    points = earth_fixed(model.state_at(points, "at_us"), "at_us")
    allowed = propagation_allowed(F.col("epoch"), F.timestamp_micros("at_us"), limits)
    return points.withColumn("allowed", allowed).withColumns(
        {f"{axis}_m": F.col(axis) * 1000.0 for axis in "xyz"}
    )


def point_list() -> Column:
    """Points of a group as one array in time order."""
    point = F.struct(
        F.col("at_us"), F.col("x_m"), F.col("y_m"), F.col("z_m")
    )
    return F.array_sort(F.collect_list(point))


def trajectories(
    elements: DataFrame,
    objects: DataFrame,
    start: datetime,
    end: datetime,
    step_seconds: int = K.SCREENING_STEP_SECONDS,
    source: str = "celestrak",
    model: OrbitModel = KeplerJ2(),
    limits: QualityLimits = QualityLimits(),
) -> DataFrame:
    """One row per object of a source: its points, or ``expired_at_us`` = the first
    grid sample at which its element is expired, or the ``error`` of a state. The
    end point off the grid is taken without a quality check. A group holds at most
    1,000 points by the window limits."""
    check_window(start, end, step_seconds)
    known = objects.select(F.col("id").alias("object_id"), "norad_cat_id", "object_name")
    chosen = latest_by_source(elements, source).join(known, "object_id")
    points = sampled_points(
        model.prepare(chosen), F.lit(utc_micros(start)), F.lit(utc_micros(end)), step_seconds, model, limits
    )
    expired = F.min(F.when(F.col("on_grid") & ~F.col("allowed"), F.col("at_us")))
    grouped = points.groupBy("object_id", "norad_cat_id", "object_name", "element_id").agg(
        expired.alias("expired_at_us"), F.min("error").alias("error"), point_list().alias("points")
    )
    good = F.col("expired_at_us").isNull() & F.col("error").isNull()
    return grouped.withColumn("points", F.when(good, F.col("points")))


def playback(
    elements: DataFrame,
    objects: DataFrame,
    start: datetime,
    end: datetime,
    step_seconds: int = K.SCREENING_STEP_SECONDS,
    source: str = "celestrak",
    object_ids: list[int] | None = None,
    element_ids: list[int] | None = None,
    model: OrbitModel = KeplerJ2(),
    limits: QualityLimits = QualityLimits(),
) -> DataFrame:
    """One row per element with ``outcome`` and, when rendered, its points.

    An object expired at any sample is dropped whole, unless exact elements are
    replayed; a failing sample drops it too. The status is that of the start.
    """
    check_window(start, end, step_seconds)
    exact = element_ids is not None
    if exact:
        chosen = exact_elements(elements, element_ids, object_ids)
    else:
        chosen = latest_by_source(elements, source)
        if object_ids is not None:
            chosen = chosen.filter(F.col("object_id").isin(_targets(object_ids, "objects")))
    rows = _with_facts(model.prepare(chosen), objects)
    begin = F.lit(utc_micros(start))
    points = sampled_points(rows, begin, F.lit(utc_micros(end)), step_seconds, model, limits)
    return summarize_playback(points, exact, F.timestamp_micros(begin), limits)


def summarize_playback(points: DataFrame, exact: bool, start: Column, limits: QualityLimits) -> DataFrame:
    first_bad = F.min(F.when(~F.col("allowed") if not exact else F.lit(False), F.col("point")))
    first_error = F.min(F.when(F.col("error").isNotNull(), F.col("point")))
    grouped = points.groupBy("object_id", "element_id", *OBJECT_FACTS, "epoch").agg(
        first_bad.alias("expired_point"), first_error.alias("error_point"), point_list().alias("points")
    )
    # Whichever comes first along the window decides; quality is looked at first.
    unknown = F.col("norad_cat_id").isNull()
    expired = F.col("expired_point").isNotNull() & (
        F.col("error_point").isNull() | (F.col("expired_point") <= F.col("error_point"))
    )
    outcome = (
        F.when(unknown, F.lit("failed"))
        .when(expired, F.lit("expired"))
        .when(F.col("error_point").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("rendered"))
    )
    return grouped.select(
        "object_id", "element_id", *OBJECT_FACTS, "epoch",
        ephemeris_status(F.col("epoch"), start, limits).alias("ephemeris_status"),
        outcome.alias("outcome"),
        F.when(outcome == "rendered", F.col("points")).alias("points"),
    )


def _targets(ids: list[int], what: str) -> list[int]:
    unique = sorted({int(i) for i in ids})
    if len(unique) > K.MAX_TARGET_OBJECTS:
        raise ValueError(f"playback supports at most {K.MAX_TARGET_OBJECTS} targeted {what}")
    return unique


def exact_elements(elements: DataFrame, element_ids: list[int], object_ids: list[int] | None) -> DataFrame:
    """At most 16 elements by id. Unknown ids are an error that lists them; with
    objects requested, the elements must belong to exactly these objects."""
    wanted = _targets(element_ids, "elements")
    chosen = elements.filter(F.col("element_id").isin(wanted))
    # At most 16 rows by the limit above.
    found = chosen.select("element_id", "object_id").collect()
    missing = sorted(set(wanted) - {row["element_id"] for row in found})
    if missing:
        raise ValueError("unknown element ids: " + ", ".join(map(str, missing)))
    if object_ids is not None and {row["object_id"] for row in found} != set(_targets(object_ids, "objects")):
        raise ValueError("element ids do not match the requested objects")
    return chosen


def replay_requests(requests: DataFrame, elements: DataFrame, max_targets: int = K.MAX_TARGET_OBJECTS) -> DataFrame:
    """``exact_elements`` for any number of requests (request_id, element_ids, object_ids).

    One row per element of an accepted request, and one with ``error`` for a refused one:
    too many distinct elements, unknown elements (listed in order), or elements of other
    objects than the requested ones. Null ``object_ids`` accept the elements' own objects.
    A request holds at most ``max_targets`` elements when it is taken apart and gathered.
    """
    wanted = F.array_distinct(F.array_compact(F.coalesce("element_ids", F.array().cast("array<bigint>"))))
    named = requests.select("request_id", wanted.alias("wanted"), F.array_sort(F.array_distinct("object_ids")).alias("objects"))
    crowded = F.size("wanted") > max_targets
    too_many = F.lit(f"playback supports at most {max_targets} targeted elements")
    refused = named.filter(crowded).select("request_id", too_many.alias("error"))
    taken = named.filter(~crowded).select("request_id", "objects", F.explode_outer("wanted").alias("element_id"))
    columns = [c for c in elements.columns if c != "element_id"]
    found = taken.join(elements.withColumn("known", F.lit(True)), "element_id", "left")
    rows = F.collect_list(F.when(F.col("known"), F.struct("element_id", *columns)))
    judged = found.groupBy("request_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("element_id")))).alias("missing"),
        F.array_sort(F.collect_set("object_id")).alias("found"),
        F.first("objects").alias("objects"),
        rows.alias("rows"),
    )
    unknown = F.concat(F.lit("unknown element ids: "), F.array_join("missing", ", "))
    error = F.when(F.size("missing") > 0, unknown).when(
        F.col("objects").isNotNull() & (F.col("objects") != F.col("found")), F.lit("element ids do not match the requested objects")
    )
    # One row stands for a refused request, so that accepted and refused come from one pass.
    nothing = F.array(F.struct(*[F.lit(None).cast(elements.schema[c].dataType).alias(c) for c in ["element_id", *columns]]))
    told = F.when(F.col("error").isNull(), F.col("rows")).otherwise(nothing)
    judged = judged.select("request_id", error.alias("error"), "rows").select("request_id", "error", F.inline(told))
    return judged.unionByName(refused, allowMissingColumns=True)


def missing_ids(requested: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Requested ids that are not stored."""
    return requested.select(key).distinct().join(stored.select(key), key, "left_anti")


def same_ids(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether two frames name the same set of ids."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def replay_windows(events: DataFrame) -> DataFrame:
    """One row per event side: object, exact element and TCA +/- one hour."""
    reach = K.TCA_REPLAY_SECONDS * MICROS
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                F.col(f"{side}_object_id").alias("object_id"),
                F.col(f"{side}_element_id").alias("element_id"),
            )
            for side in ("primary", "secondary")
        ]
    )
    return events.select(
        "event_id", "tca_us",
        (F.col("tca_us") - reach).alias("start_us"),
        (F.col("tca_us") + reach).alias("end_us"),
        F.inline(sides),
    )


def replay_points(
    events: DataFrame,
    elements: DataFrame,
    step_seconds: int = K.SCREENING_STEP_SECONDS,
    model: OrbitModel = KeplerJ2(),
) -> DataFrame:
    """Points of both objects of every event over its replay window, from the exact
    elements, whatever their age."""
    prepared = model.prepare(elements).select("element_id", "epoch", *model.columns)
    windows = replay_windows(events).join(prepared, "element_id")
    points = sampled_points(
        windows, F.col("start_us"), F.col("end_us"), step_seconds, model, QualityLimits()
    )
    return points.select("event_id", "side", "object_id", "element_id", "at_us", "x_m", "y_m", "z_m", "error")


def segments(points: DataFrame) -> DataFrame:
    """Neighbouring points of an object as segments ``at_us .. next_us``."""
    order = W.partitionBy("object_id").orderBy("at_us")
    ahead = {f"next_{c}": F.lead(c).over(order) for c in ("at_us", "x_m", "y_m", "z_m")}
    return points.withColumns(ahead).withColumnRenamed("next_at_us", "next_us")


def interpolate(points: DataFrame, targets: DataFrame, step_seconds: int) -> DataFrame:
    """Linear position of each target (``object_id``, ``target_us``) between the two
    points around it; targets outside an object's points are left out.

    Points are at most one step apart, so a target's segment starts in the target's
    step-wide bucket or the one before: an equi-join on (object, bucket).
    """
    width = step_seconds * MICROS
    lines = segments(points.select("object_id", "at_us", "x_m", "y_m", "z_m")).withColumn(
        "bucket", F.explode(F.array(F.floor(F.col("at_us") / width), F.floor(F.col("at_us") / width) + 1))
    )
    wanted = targets.withColumn("bucket", F.floor(F.col("target_us") / width))
    hit = wanted.join(lines, ["object_id", "bucket"]).filter(
        ((F.col("target_us") >= F.col("at_us")) & (F.col("target_us") < F.col("next_us")))
        | ((F.col("target_us") == F.col("at_us")) & F.col("next_us").isNull())
    )
    share = F.when(F.col("next_us").isNull(), F.lit(0.0)).otherwise(
        (F.col("target_us") - F.col("at_us")) / (F.col("next_us") - F.col("at_us"))
    )
    hit = hit.withColumn("share", share)
    return hit.select(
        *targets.columns,
        *[
            (F.col(c) + F.coalesce(F.col(f"next_{c}") - F.col(c), F.lit(0.0)) * F.col("share")).alias(c)
            for c in ("x_m", "y_m", "z_m")
        ],
    )


def events_in_window(
    events: DataFrame, points: DataFrame, start_us: int, end_us: int, step_seconds: int
) -> DataFrame:
    """Events with TCA inside the window: both positions at the TCA, their midpoint
    and the interval of display. Events without either side are left out."""
    inside = events.filter(F.col("tca_us").between(start_us, end_us))
    sides = {}
    for side in ("primary", "secondary"):
        targets = inside.select(
            "event_id", F.col(f"{side}_object_id").alias("object_id"), F.col("tca_us").alias("target_us")
        )
        found = interpolate(points, targets, step_seconds)
        sides[side] = found.select("event_id", *[F.col(f"{a}_m").alias(f"{side}_{a}_m") for a in "xyz"])
    shown = K.TCA_DISPLAY_SECONDS * MICROS
    return (
        inside.join(sides["primary"], "event_id")
        .join(sides["secondary"], "event_id")
        .withColumns(
            {f"midpoint_{a}_m": (F.col(f"primary_{a}_m") + F.col(f"secondary_{a}_m")) / 2 for a in "xyz"}
        )
        .withColumns({"shown_from_us": F.col("tca_us") - shown, "shown_to_us": F.col("tca_us") + shown})
    )
