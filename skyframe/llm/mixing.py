"""A mix of sources to target weights, in the order of a time-varying curriculum.

Sizes are words. Every source gets a target: the sources share ``share`` times all words
by weight, a source stops at ``cap`` times its own size, and what is over is shared again
by weight among the rest. A source has a schedule, its relative weight over training time
from 0 to 1. The integral of a schedule, scaled to the target, is the source's cumulative
demand; inverting it at the place of a document in its source gives the time at which the
document is read. Documents then lie in ranges of time, sorted.

A source's documents are taken in the order of a digest of their id, pass after pass,
until the target is reached; the last one may be taken in part. Prefix sums run in two
levels, inside (source, digest prefix) and over one sum per prefix, so a source with a
third of all rows is spread over many tasks. Everything is DataFrame functions.

Defined results: a null text has size 0 and is never taken; null sources are one source,
the last. A source without words has the target 0. Rows of one id are ordered by a digest
of their text; rows repeated whole are taken one after the other. An empty table gives no
rows. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyframe.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Relative weight at even steps of training time, by a source's rank: some sources fade,
#: some stay, some come in late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE = 1.5
CAP = 2.0
#: Rows of one window; decides how long the digest prefixes are.
WINDOW_ROWS = 2000

OUTPUT = ("size", "source_size", "target", "taken", "takes", "first_position")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cycled(values: tuple, rank: Column) -> Column:
    """The value of ``values`` at ``rank`` (from 1), repeating."""
    table = F.array(*[F.lit(v) if not isinstance(v, tuple) else F.array(*map(F.lit, v)) for v in values])
    return F.element_at(table, (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) with rank, ``target`` and the schedule's rank.

    Sorted by the level at which they fill up, the first sources are full and the rest
    share what these leave: the first source that does not fill sets the level of all
    after it. The table has one row per source, which is why one task may sort it.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", cycled(weights, F.col("rank")))
    most = F.col("source_size") * F.lit(cap)
    filling = ranked.withColumn("most", most).withColumn("full_at", F.col("most") / F.col("weight"))
    ordered = W.orderBy("full_at", "rank")
    all_rows = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = filling.withColumn("level", left / rest)
    open_level = F.when(F.col("full_at") > F.col("level"), F.col("level"))
    levels = levels.withColumn("water", F.first(open_level, ignorenulls=True).over(all_rows))
    target = F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    return levels.select("source", "source_size", "rank", target.alias("target"))


def time_of(share: Column, schedule: Column, steps: int) -> Column:
    """The time at which a schedule's integral reaches ``share`` of its whole.

    The schedule is linear between ``steps`` even steps, so its integral is quadratic in
    each; ``share`` lies in the first step whose end reaches it.
    """
    width = 1.0 / steps
    ends, areas, found = [F.lit(0.0)], [], F.lit(1.0)
    for i in range(steps):
        a, b = F.element_at(schedule, i + 1), F.element_at(schedule, i + 2)
        areas.append((a, b))
        ends.append(ends[-1] + (a + b) * F.lit(width / 2))
    wanted = share * ends[-1]
    for i in reversed(range(steps)):
        (a, b), rest = areas[i], wanted - ends[i]
        slope = (b - a) / F.lit(width)
        steep = (F.sqrt(F.greatest(a * a + slope * rest * 2.0, F.lit(0.0))) - a) / slope
        inside = F.when(a == b, rest / a).otherwise(steep)
        here = F.lit(i * width) + F.least(F.greatest(inside, F.lit(0.0)), F.lit(width))
        found = here if i == steps - 1 else F.when(wanted <= ends[i + 1], here).otherwise(found)
    return found


def schedule_takes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    share: float = SHARE,
    cap: float = CAP,
    weights: tuple = WEIGHTS,
    schedules: tuple = SCHEDULES,
) -> DataFrame:
    """All columns of ``docs`` with ``size, source_size, target, taken`` and ``takes``:
    one (pass, words, position) for each time the document is read."""
    kept = [c for c in docs.columns if c.lower() not in OUTPUT]
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    rows = docs.select(*kept, word_count(text_column).alias("size")).withColumns({"_key": key, "_text": F.md5(text_column)})
    digits = max(1, math.ceil(math.log(max(docs.count() / WINDOW_ROWS, 1), 16)))
    # One string per source that sorts like it, nulls last; windows and the join share it,
    # so the documents are shuffled for both at once.
    named = F.when(F.col(source_column).isNull(), "2").otherwise(F.concat(F.lit("1"), F.col(source_column).cast("string")))
    rows = rows.withColumns({"_source": named, "_bucket": F.substring("_key", 1, digits)})
    sums = materialize(rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("words")), "words")
    sizes = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"))
    targets = materialize(source_targets(sizes, share, cap, weights), "targets")
    earlier = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = sums.withColumn("_begins", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    plan = begins.join(targets.withColumnRenamed("source", "_source"), "_source").select(
        "_source", "_bucket", "_begins", "source_size", "rank", "target"
    )
    inside = W.partitionBy("_source", "_bucket").orderBy("_key", F.col("_text").asc_nulls_first())
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_ahead", ahead)
    rows = rows.join(plan, ["_source", "_bucket"])
    wanted = F.floor(F.col("target") + 0.5)
    rows = rows.withColumns({"_at": F.col("_begins") + F.col("_ahead"), "_wanted": wanted, "_plan": cycled(schedules, F.col("rank"))})
    takes = []
    for turn in range(math.ceil(cap)):
        begin = F.col("_at") + F.col("source_size") * turn
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_wanted") - begin))
        place = (begin + words / 2) / F.col("_wanted")
        position = F.when(words > 0, time_of(place, F.col("_plan"), len(schedules[0]) - 1))
        takes.append(F.struct(F.lit(turn).alias("turn"), words.cast("long").alias("words"), position.alias("position")))
    rows = rows.withColumn("takes", F.filter(F.array(*takes), lambda t: t["words"] > 0))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: n + t["words"])
    return rows.select(*kept, "size", "source_size", "target", taken.alias("taken"), "takes")


def in_time_order(rows: DataFrame, position: str, spread_by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in ranges of training time, one partition each, sorted inside.

    Demand is spread over time by the schedules, so equal ranges of time hold near equal
    work and need no sampling. Rows without a time are spread by a hash of ``spread_by``
    and sort last.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(parts)) if spread_by else F.lit(parts - 1)
    at = F.col(position)
    part = F.when(at.isNull(), spread).otherwise(F.least(F.floor(at * parts), F.lit(parts - 1))).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions(F.col(position).asc_nulls_last())


def mix(docs: DataFrame, **options) -> DataFrame:
    """``schedule_takes`` with ``first_position``, in the order of it."""
    rows = schedule_takes(docs, **options).withColumn("first_position", F.get("takes", F.lit(0))["position"])
    return in_time_order(rows, "first_position", (options.get("id_column", "doc_id"), "size"))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The documents as they are read: a row for each take, in order of time. The
    columns are those of ``docs``; texts stay whole."""
    taken = schedule_takes(docs, **options).select(*docs.columns, F.explode("takes.position").alias("_position"))
    return in_time_order(taken, "_position").select(*docs.columns)
