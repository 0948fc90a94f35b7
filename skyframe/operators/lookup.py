"""Point lookups, latest runs, top events, grounding joins and catalogue search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyframe import constants as K
from skyframe.functions.motion import altitude_km, speed_km_s
from skyframe.functions.text import display_kind, operational_status, strip
from skyframe.session import broadcast_if_small, materialize


def by_key(df: DataFrame, key: str, value: int) -> DataFrame:
    """Rows of one key; the filter reaches the Parquet scan."""
    return df.filter(F.col(key) == value)


def objects_by_number(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Objects of a frame of catalogue numbers of any size."""
    return objects.join(wanted.select("norad_cat_id").distinct(), "norad_cat_id", "left_semi")


def labelled_events(events: DataFrame, objects: DataFrame) -> DataFrame:
    """Events with number and name of both objects; an unknown object leaves nulls.

    Labels are cut down to the objects that occur before they are joined.
    """
    sides = ("primary", "secondary")
    ids = events.select(F.explode(F.array(*[f"{s}_object_id" for s in sides])).alias("object_id"))
    labels = object_labels(objects, ids)
    for side in sides:
        named = labels.select(
            F.col("orbital_object_id").alias(f"{side}_object_id"),
            F.col("norad_cat_id").alias(f"{side}_norad_cat_id"),
            F.col("object_name").alias(f"{side}_name"),
        )
        events = events.join(named, f"{side}_object_id", "left")
    return events


def object_labels(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """Id, catalogue number and name of the objects in ``ids`` (column object_id)."""
    return objects.join(
        ids.select(F.col("object_id").alias("id")).distinct(), "id", "left_semi"
    ).select(F.col("id").alias("orbital_object_id"), "norad_cat_id", "object_name")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(1)


def latest_run_per_source(runs: DataFrame) -> DataFrame:
    """Per source the run completed last; the greater id among equals."""
    columns = [c for c in runs.columns if c != "source"]
    best = F.max_by(F.struct(*columns), F.struct("completed_at", "run_id")).alias("r")
    return runs.groupBy("source").agg(best).select("source", "r.*").select(runs.columns)


def events_with_objects(events: DataFrame, objects: DataFrame) -> DataFrame:
    """Events with the number and name of both objects."""
    facts = ("norad_cat_id", "object_name", "object_type")
    for side in ("primary", "secondary"):
        named = objects.select(
            F.col("id").alias(f"{side}_object_id"), *[F.col(c).alias(f"{side}_{c}") for c in facts]
        )
        events = events.join(named, f"{side}_object_id")
    return events


def closest_events(events: DataFrame, objects: DataFrame, run_id: int, limit: int = 100) -> DataFrame:
    """The ``limit`` closest events of a run (1 to 1000), by miss distance, then time.
    The limit comes before the object joins, which then touch few rows."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    order = ("miss_distance_km", "tca", "event_id")
    known = objects.select(F.col("id"))
    usable = by_key(events, "run_id", run_id)
    for side in ("primary", "secondary"):
        usable = usable.join(known.select(F.col("id").alias(f"{side}_object_id")), f"{side}_object_id", "left_semi")
    top = usable.orderBy(*order).limit(limit)
    return events_with_objects(top, objects).orderBy(*order)


def upcoming_events(events: DataFrame, now: Column) -> DataFrame:
    """Events at or after ``now`` by time."""
    return events.filter(F.col("tca") >= now).orderBy("tca", "event_id")


def priority_events(events: DataFrame, now: Column, count: int = K.PRIORITY_EVENTS) -> DataFrame:
    """The next events over all runs: a distributed top-k."""
    return upcoming_events(events, now).limit(count)


def priority_events_per_run(events: DataFrame, now: Column, count: int = K.PRIORITY_EVENTS) -> DataFrame:
    """The next events of each run with their ``rank``. Spark limits each run to
    ``count`` rows per task ahead of the shuffle."""
    order = W.partitionBy("run_id").orderBy("tca", "event_id")
    ranked = events.filter(F.col("tca") >= now).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= count)


def screening_is_stale(runs: DataFrame, now: Column) -> DataFrame:
    """One row: whether the latest run's window has ended. No run is not stale."""
    newest = F.max_by(F.struct("window_end"), "run_id").alias("newest")
    end = F.col("newest.window_end")
    return runs.agg(newest).select(
        F.when(F.col("newest").isNull(), F.lit(False))
        .otherwise(end.isNull() | (end < now))
        .alias("screening_is_stale")
    )


#: Run headers (about 80 bytes each) that may be broadcast.
BROADCAST_RUNS = 200_000

GROUNDING_PROBLEMS = (
    "incomplete", "run", "pair", "provenance", "outside_window", "number",
)


def grounded_events(events: DataFrame, runs: DataFrame, objects: DataFrame, elements: DataFrame) -> DataFrame:
    """Every event left-joined to its run, objects and exact elements, with the
    ``problem`` that makes it unfit for a brief, or null."""
    run_facts = runs.select(
        "run_id",
        F.lit(True).alias("run_found"),
        F.col("source").alias("run_source"),
        F.col("started_at").alias("run_started_at"),
        F.col("completed_at").alias("run_completed_at"),
        "window_start",
        "window_end",
    )
    # Few runs hold many events; a counted table of runs is broadcast, a larger one shuffles.
    # Runs may be summed up from events, so they are written before they are counted.
    rows = events.join(broadcast_if_small(materialize(run_facts, "runs"), BROADCAST_RUNS), "run_id", "left")
    # Exact elements first: events that are dealt out by their primary element stay so.
    for side in ("primary", "secondary"):
        exact = elements.select(
            F.col("element_id").alias(f"{side}_element_id"),
            F.col("object_id").alias(f"{side}_element_object_id"),
            F.col("source").alias(f"{side}_element_source"),
            F.col("epoch").alias(f"{side}_element_epoch"),
        )
        rows = rows.join(exact, f"{side}_element_id", "left")
    for side in ("primary", "secondary"):
        named = objects.select(
            F.col("id").alias(f"{side}_object_id"),
            F.col("norad_cat_id").alias(f"{side}_norad_cat_id"),
            F.col("object_name").alias(f"{side}_name"),
            F.col("object_id").alias(f"{side}_designator"),
            F.col("object_type").alias(f"{side}_object_type"),
        )
        rows = rows.join(named, f"{side}_object_id", "left")
    return rows.withColumn("problem", grounding_problem())


def grounding_problem() -> Column:
    incomplete, run, pair, provenance, outside, number = GROUNDING_PROBLEMS
    found = [F.col("run_found"), *[F.col(f"{s}_norad_cat_id") for s in ("primary", "secondary")]]
    found += [F.col(f"{s}_element_object_id") for s in ("primary", "secondary")]
    missing = found[0].isNull()
    for column in found[1:]:
        missing = missing | column.isNull()
    exact = [F.col(f"{s}_element_object_id") == F.col(f"{s}_object_id") for s in ("primary", "secondary")]

    def bad(name: str) -> Column:
        value = F.col(name)
        return value.isNull() | F.isnan(value) | (value == float("inf")) | (value < 0)

    return (
        F.when(missing, F.lit(incomplete))
        .when(~F.col("run_source").eqNullSafe(F.lit("canonical")), F.lit(run))
        .when(F.col("primary_object_id") == F.col("secondary_object_id"), F.lit(pair))
        .when(~exact[0] | ~exact[1], F.lit(provenance))
        .when(~F.col("tca").between(F.col("window_start"), F.col("window_end")), F.lit(outside))
        .when(bad("miss_distance_km") | bad("relative_velocity_km_s"), F.lit(number))
    )


def object_details(snapshot: DataFrame) -> DataFrame:
    """Derived speed, altitude, kind and status label of snapshot rows."""
    return snapshot.select(
        "object_id", "norad_cat_id", "object_name",
        display_kind(F.col("object_type")).alias("kind"),
        operational_status(F.col("ops_status_code")).alias("operational_status"),
        speed_km_s(tuple(F.col(f"v{a}_m_s") for a in "xyz")).alias("speed_km_s"),
        altitude_km(tuple(F.col(f"{a}_m") for a in "xyz")).alias("altitude_km"),
    )


def search_rank(name: Column, number: Column, query: Column) -> Column:
    """0 exact number, 1 prefix of name or number, 2 inside the name, else null."""
    upper = F.upper(name)
    return (
        F.when(number == query, F.lit(0))
        .when(F.startswith(upper, query) | F.startswith(number, query), F.lit(1))
        .when(F.contains(upper, query), F.lit(2))
    )


def search(objects: DataFrame, text: str, limit: int = K.SEARCH_MAX_RESULTS) -> DataFrame:
    """First matches by rank, then catalogue order (``ordinal``)."""
    query = text.strip().upper()
    if len(query) < K.SEARCH_MIN_CHARS:
        return objects.limit(0).withColumn("rank", F.lit(0))
    rank = search_rank(F.col("object_name"), F.col("norad_cat_id").cast("string"), F.lit(query))
    return objects.withColumn("rank", rank).filter("rank IS NOT NULL").orderBy("rank", "ordinal").limit(limit)


#: Pieces of names that are indexed; a query is looked up by its longest such piece.
GRAM_LENGTHS = (2, 3, 5)
#: Parts of a piece's matches that are ranked on their own before they meet.
RANK_SALTS = 64


def _pieces(text: Column, length: int) -> Column:
    """All substrings of one length."""
    whole = F.transform(F.sequence(F.lit(1), F.length(text) - (length - 1)), lambda i: F.substring(text, i, length))
    return F.when(F.length(text) >= length, whole).otherwise(F.array().cast("array<string>"))


def name_grams(objects: DataFrame, lengths: tuple[int, ...] = GRAM_LENGTHS) -> DataFrame:
    """Distinct pieces of each name and number, for equi-joins."""
    name, number = F.coalesce(F.upper("object_name"), F.lit("")), F.col("norad_cat_id").cast("string")
    pieces = F.concat(*[_pieces(t, n) for t in (name, number) for n in lengths])
    return objects.select("*", F.explode(F.array_distinct(pieces)).alias("gram"))


def _query_pieces(query: Column) -> Column:
    """The pieces by which a query may be looked up: those of the greatest length it has."""
    picked = None
    for length in sorted(GRAM_LENGTHS):
        long_enough = F.length(query) >= length
        picked = _pieces(query, length) if picked is None else F.when(long_enough, _pieces(query, length)).otherwise(picked)
    return picked


def search_many(objects: DataFrame, queries: DataFrame, limit: int = K.SEARCH_MAX_RESULTS) -> DataFrame:
    """First matches of each query (``query_id``, ``text``); queries under two
    characters have none.

    A match contains the query's rarest piece, so candidates come from an equi-join on
    pieces rather than from every query against every object. Equal queries are asked
    once. A short query is its own piece, of which there are few different ones; a long
    one is looked up by five characters, which few names share. What a piece finds is
    ranked in salted parts first, so a piece that nearly every name holds is not sorted
    in one task and leaves at most ``limit`` rows a part.
    """
    asked = queries.select("query_id", F.upper(strip(F.col("text"))).alias("query")).filter(
        F.length("query") >= K.SEARCH_MIN_CHARS
    )
    texts = asked.select("query").distinct()
    grams = name_grams(objects.select("id", "norad_cat_id", "object_name", "ordinal"))
    weight = grams.groupBy("gram").agg(F.count("*").alias("names"))
    # Pieces no name has keep weight zero and rightly select nothing.
    rarest = (
        texts.select("query", F.explode(F.array_distinct(_query_pieces(F.col("query")))).alias("gram"))
        .join(weight, "gram", "left")
        .groupBy("query")
        .agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    rank = search_rank(F.col("object_name"), F.col("norad_cat_id").cast("string"), F.col("query"))
    salt = F.pmod(F.xxhash64("id"), F.lit(RANK_SALTS))
    found = rarest.join(grams, "gram").withColumns({"rank": rank, "salt": salt}).filter("rank IS NOT NULL")
    in_part = W.partitionBy("query", "salt").orderBy("rank", "ordinal")
    found = found.withColumn("place", F.row_number().over(in_part)).filter(F.col("place") <= limit)
    order = W.partitionBy("query").orderBy("rank", "ordinal")
    first = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return asked.join(first, "query").select(
        "query_id", "query", "place", "rank", "id", "norad_cat_id", "object_name"
    )
