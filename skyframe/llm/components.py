"""Connected components of a graph of any size, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.session import materialize


def _minima(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``; combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u hangs on the smallest node that u knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = _minima(both).withColumn("m", F.least("u", "m"))
    moved = both.filter("v > u").join(minima, "u")
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours hang on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    minima = _minima(down)
    moved = down.join(minima, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = minima.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(own).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (``a``, ``b``: long).

    The component is its smallest node. Large and small stars take turns until the
    edges are stars about these nodes; the number of rounds grows with the logarithm
    of the size. Each round is written to the shared folder.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")

    def mark(df: DataFrame):
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(df.agg(F.count("*"), total).first())

    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionAll(centres)
