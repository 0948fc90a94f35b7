"""Exact top-k by integer inner product with KD-trees per shard.

Vectors are turned into whole numbers, dealt into shards by a hash of their id, and each
shard is built into a KD-tree: median splits along the widest side, and every node keeps
the tight box of its points. For a query the best inner product that a box can hold is
the sum over dimensions of the better of its two ends. The tree is searched best box
first, and a box that cannot reach the kth score found so far is closed; that kth score
is carried on from tree to tree, so later shards are entered with a high bound.

Queries come in blocks and each block meets every shard once. A lane of a few shards goes to one
task, which builds its trees once and lets the blocks pass: it holds one lane and one block, and
no join is planned that could send the blocks through the driver. Per query, k rows a lane go to
the shuffle.

Scores are exact: whole numbers below 2^53 are multiplied as doubles; where larger ones
could come up, Python numbers are used, and a score beyond 64 bits is cut to its limit.

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors of different length never meet; a query is no candidate of its own row, but
other rows of its id are. With fewer candidates than k all are returned; equal scores go
to the smaller id. Null ids take no part. Only the two named columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyframe.llm.common import small_batches
from skyframe.session import materialize, spread

SCALE = 1024.0
K = 10
LEAF = 64
#: Vectors of one tree, queries of one block, trees of a lane, which one task searches in a row.
SHARD_ROWS = 2048
BLOCK_QUERIES = 1024
LANE_TREES = 4
#: Whole numbers of this size and below have exact products and sums as doubles.
EXACT = float(1 << 53)
_LIMIT = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, dim, v): components as floor(SCALE * x); only rows that take part."""
    scaled = F.transform(vector_column, lambda x: F.floor(x.cast("double") * F.lit(SCALE)).cast("double"))
    fit = F.forall(
        vector_column,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).filter(fit)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.size(vector_column).alias("dim"), scaled.alias("v"))


class Tree:
    """Nodes in the order of building: children, box ends, and the rows of a leaf."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.ids, self.points = ids, points
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        self._build(np.arange(len(ids)))
        self.low_box, self.high_box = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray) -> int:
        """Iterative, as equal points could make a deep tree; they end as one large leaf."""
        waiting = [(rows, -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            node = len(self.low)
            points = self.points[rows]
            low, high = points.min(axis=0), points.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.children.append(None)
            self.rows.append(None)
            if parent >= 0:
                pair = list(self.children[parent] or (0, 0))
                pair[side] = node
                self.children[parent] = (pair[0], pair[1])
            width = high - low
            axis = int(np.argmax(width)) if len(width) else 0
            if len(rows) <= LEAF or not len(width) or width[axis] == 0:
                self.rows[node] = rows
                continue
            order = np.argsort(points[:, axis], kind="stable")
            half = len(rows) // 2
            waiting += [(rows[order[half:]], node, 1), (rows[order[:half]], node, 0)]
        return 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the most that a box can score, a little above in doubles."""
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        best = positive @ self.high_box.T + negative @ self.low_box.T
        slack = np.abs(queries) @ np.maximum(np.abs(self.low_box), np.abs(self.high_box)).T
        return best + slack * 1e-12

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, best: list[tuple[int, int]], exact: bool) -> None:
        """Push better rows into ``best``, a heap of (score, -id) of at most k."""
        frontier = [(-bound[0], 0)]
        while frontier:
            most, node = heapq.heappop(frontier)
            if len(best) == k and -most < best[0][0]:
                return
            children = self.children[node]
            if children:
                for child in children:
                    if len(best) < k or bound[child] >= best[0][0]:
                        heapq.heappush(frontier, (-bound[child], child))
                continue
            rows = self.rows[node]
            if exact:
                found = (self.points[rows] @ query).astype(np.int64)
                if len(best) == k:
                    near = found >= best[0][0]
                    rows, found = rows[near], found[near]
                scores = found.tolist()
            else:
                whole = [int(q) for q in query]
                scores = [sum(int(a) * b for a, b in zip(p, whole)) for p in self.points[rows]]
            for score, row in zip(scores, rows.tolist()):
                found = (score, -int(self.ids[row]))
                if row == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def _blobs(rows: DataFrame, keys: list[str], rows_a_blob: int) -> DataFrame:
    """One row per group: its ids, row numbers and numbers as bytes. Groups are bounded:
    they come from a hash into so many groups that ``rows_a_blob`` is the mean."""

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            flat = batch.column("v").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch.column("dim").to_numpy())])
            for i, key in enumerate(zip(*columns)):
                if held and key not in held:
                    yield _blob(keys, held)
                    held = {}
                held.setdefault(key, []).append((ids[i], marks[i], flat[ends[i] : ends[i + 1]]))
        if held:
            yield _blob(keys, held)

    schema = ", ".join([*[f"{k} int" for k in keys], "ids binary, marks binary, numbers binary"])
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _blob(keys: list[str], held: dict[tuple, list]) -> pa.RecordBatch:
    (key, rows), = held.items()
    blobs = [np.array([r[i] for r in rows], np.int64).tobytes() for i in (0, 1)]
    numbers = np.concatenate([r[2] for r in rows]).astype(np.float64).tobytes()
    arrays = [pa.array([k], pa.int32()) for k in key] + [pa.array([b], pa.binary()) for b in (*blobs, numbers)]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "ids", "marks", "numbers"])


def _numbers(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, marks = (np.frombuffer(row[n], np.int64) for n in ("ids", "marks"))
    return ids, marks, np.frombuffer(row["numbers"], np.float64).reshape(len(ids), row["dim"])


def top_k(
    vectors: DataFrame, every: int, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible
    by ``every``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole_numbers(vectors, id_column, vector_column)
    rows = materialize(rows.withColumn("mark", F.monotonically_increasing_id()), "numbers")
    asked = rows.filter(F.col("id") % every == 0)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int"))
    trees = _blobs(placed, ["dim", "shard"], SHARD_ROWS)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(3)), F.lit(blocks)).cast("int"))
    queries = _blobs(dealt, ["dim", "block"], BLOCK_QUERIES)
    lanes = -(-shards // LANE_TREES)
    blob = ["ids", "marks", "numbers"]
    trees = trees.select("dim", F.pmod("shard", F.lit(lanes)).alias("lane"), F.lit(0).alias("asks"), *blob)
    queries = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(1).alias("asks"), *blob)
    met = spread(trees.unionByName(queries), "dim", "lane").sortWithinPartitions("dim", "lane", "asks")

    def run(batches):
        lane, trees = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["dim"], row["lane"]) != lane:
                    lane, trees = (row["dim"], row["lane"]), []
                ids, marks, points = _numbers(row)
                if not row["asks"]:
                    place = {m: i for i, m in enumerate(marks.tolist())}
                    trees.append((Tree(ids, points), place, float(np.abs(points).max(initial=0))))
                    continue
                best: list[list[tuple[int, int]]] = [[] for _ in ids]
                largest = float(np.abs(points).max(initial=0))
                for tree, place, size in trees:
                    exact = size * largest * row["dim"] < EXACT
                    bounds = tree.bounds(points)
                    if not exact:  # doubles round: no box is closed too early
                        bounds = bounds + np.abs(bounds) * 1e-9 + 1.0
                    for i, mark in enumerate(marks.tolist()):
                        tree.search(points[i], place.get(mark, -1), bounds[i], k, best[i], exact)
                if trees:
                    yield _answers(ids, marks, best)

    found = met.mapInArrow(run, "query_id long, mark long, vec_id long, score long")
    order = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _answers(ids: np.ndarray, marks: np.ndarray, best: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    counts = [len(b) for b in best]
    flat = [x for b in best for x in b]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(ids, counts)), pa.array(np.repeat(marks, counts)),
            pa.array([-i for _, i in flat], pa.int64()),
            pa.array([max(-_LIMIT - 1, min(_LIMIT, s)) for s, _ in flat], pa.int64()),
        ],
        names=["query_id", "mark", "vec_id", "score"],
    )
