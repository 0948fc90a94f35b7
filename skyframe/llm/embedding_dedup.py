"""Near-duplicate vectors by a pigeonhole join over blocks of a rotated space.

Vectors are scaled to length one, where a cosine of c is a squared distance of 2 - 2c,
and turned by a fixed random rotation, which spreads any difference over all directions.
The rotated dimensions are cut into ``BLOCKS`` blocks. If two vectors lie within the
squared distance, then in at least one block they lie within that block's share of it,
in proportion to its dimensions. So each block is range-joined on its own with a much
smaller radius, and every candidate of any block is checked exactly.

The range join of a block parts its space into cells about sampled pivots (each vector
goes to its nearest pivot) and meets two cells at a time. A vector goes to the pair of
its own cell and another one only if its distance to the plane between the two pivots is
within the radius. Cells with many vectors are dealt into sub-cells by hash, so a task
holds two bounded sub-cells however large a cell is.

A link is counted in the first block in which the pair is within its share, found from
whole numbers that do not depend on where the pair met; so it is counted once. Vectors
equal in every component are joined as one with a weight. A set of linked vectors leaves
a task as one link per vector; components are then found by joins.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite
component, links with nothing and is its own component. Vectors of different length never
link. Repeated rows give a row each and link with each other; a null id is ignored when
the smallest of a component is taken. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import small_batches
from skyframe.llm.components import connected_components
from skyframe.llm.simhash import unite
from skyframe.session import materialize

COSINE = 0.9
BLOCKS = 8
#: Doubles of one cell on average, in bytes; a larger cell is dealt into sub-cells of this
#: size. A task holds two. Larger cells mean fewer copies of a vector in the shuffle.
CELL_BYTES = 8 << 20
#: Pivots of a block; sampled, so the driver holds at most this many short vectors.
MAX_PIVOTS = 1024
#: Candidate pairs that are checked at once.
CHECKED_AT_ONCE = 100_000
SEED = 20
#: Distances as doubles are trusted to this; budgets are widened by it.
SLACK = 1e-6
_UNIT = float(1 << 24)


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation: the orthogonal factor of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cell_rows(dim: int) -> int:
    return max(16, CELL_BYTES // (8 * dim))


def block_edges(dim: int) -> list[tuple[int, int]]:
    blocks = min(BLOCKS, dim)
    return [(dim * b // blocks, dim * (b + 1) // blocks) for b in range(blocks)]


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Each block's share of the squared distance, a little widened."""
    whole = (2.0 - 2.0 * cosine) * (1.0 + SLACK) + SLACK
    return np.array([whole * (b - a) / dim for a, b in block_edges(dim)])


def units(numbers: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    scaled = numbers / np.abs(numbers).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, dim, v, fit): ``v`` as bytes of doubles; ``fit`` for vectors that can link."""
    x = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fit = finite & F.exists(x, lambda c: c != 0.0)
    return vectors.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.size(vector_column), F.lit(0)).alias("dim"),
        x.alias("v"), F.coalesce(fit, F.lit(False)).alias("fit"),
    )


def _distinct(rows: DataFrame) -> DataFrame:
    """(node, dim, v, weight): the distinct usable vectors, numbered in the order of the
    written table. Copies meet before the shuffle."""
    kinds = rows.filter("fit").groupBy("dim", "v").agg(F.count("*").alias("weight"))
    return materialize(kinds.withColumn("node", F.monotonically_increasing_id()), "vectors")


def _pivots(nodes: DataFrame, dim: int, cells: int) -> list[np.ndarray]:
    """Pivots of each block: the same sampled vectors in every block. At most MAX_PIVOTS."""
    picked = nodes.orderBy(F.xxhash64("node")).limit(cells).select("v").collect()
    turned = units(np.array([r["v"] for r in picked])) @ rotation(dim)
    return [turned[:, a:b] for a, b in block_edges(dim)]


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all pivots, and the nearest one."""
    squares = (points**2).sum(1)[:, None] - 2.0 * points @ pivots.T + (pivots**2).sum(1)[None]
    return squares, squares.argmin(1)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def _packed(numbers: np.ndarray) -> pa.Array:
    """Each row as bytes, which pass through a shuffle as they are: of floats where these
    hold the numbers exactly, else of doubles."""
    floats = numbers.astype("<f4")
    rows = floats if (floats == numbers).all() else numbers.astype("<f8")
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _unpacked(blobs: list[bytes], dim: int) -> np.ndarray:
    if len({len(b) for b in blobs}) == 1:
        return np.frombuffer(b"".join(blobs), "<f4" if len(blobs[0]) == 4 * dim else "<f8").reshape(-1, dim).astype(float)
    return np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8").astype(float) for b in blobs])


def _cell_pairs(nodes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(block, one, two, node, weight, v): each vector in every pair of sub-cells of every
    block that it has to meet. ``one`` <= ``two``; a pair of a sub-cell with itself is the
    vector's own."""
    count = nodes.count()
    cells = max(1, min(MAX_PIVOTS, -(-count // cell_rows(dim))))
    pivots, radii = _pivots(nodes, dim, cells), np.sqrt(budgets(dim, cosine))
    edges = block_edges(dim)
    held = nodes.select("node", "weight", "v")

    def homes(batches):
        for batch in batches:
            turned = units(_vectors(batch, dim)) @ rotation(dim)
            for b, (low, high) in enumerate(edges):
                _, home = _nearest(turned[:, low:high], pivots[b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(home), b, np.int32)), pa.array(home.astype(np.int32))], names=["block", "cell"]
                )

    sizes = held.mapInArrow(homes, "block int, cell int").groupBy("block", "cell").count().collect()
    parts = np.ones((len(edges), len(pivots[0])), np.int64)
    for r in sizes:  # at most BLOCKS * MAX_PIVOTS rows
        parts[r["block"], r["cell"]] = -(-r["count"] // cell_rows(dim))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _vectors(batch, dim)
            turned, packed = units(numbers) @ rotation(dim), _packed(numbers)
            node = batch.column("node").to_numpy()
            for b, (low, high) in enumerate(edges):
                squares, home = _nearest(turned[:, low:high], pivots[b])
                first = np.cumsum(parts[b]) - parts[b]  # number of a cell's first sub-cell
                mine = first[home] + (node * 7919 + 13) % 1_000_003 % parts[b][home]
                between = np.sqrt(((pivots[b][:, None] - pivots[b][None]) ** 2).sum(2))[home]
                rows = np.arange(len(node))
                # Signed distance to the plane between two pivots, times twice their gap.
                far = squares - squares[rows, home][:, None] > (2.0 * radii[b] + SLACK) * between + SLACK
                row, cell = np.nonzero(~far)
                times = parts[b][cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                other = first[cell] + offset
                one, two = np.minimum(mine[row], other), np.maximum(mine[row], other)
                for at in range(0, len(row), 4096):
                    some = slice(at, at + 4096)
                    picked = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(picked), b, np.int32)), pa.array(one[some].astype(np.int32)),
                            pa.array(two[some].astype(np.int32)), pa.array(mine[row[some]].astype(np.int32)),
                            *[c.take(picked) for c in (batch.column("node"), batch.column("weight"), packed)],
                        ],
                        names=["block", "one", "two", "mine", "node", "weight", "v"],
                    )

    return held.mapInArrow(spread, "block int, one int, two int, mine int, node long, weight long, v binary")


def _whole_blocks(turned_rows: np.ndarray, dim: int) -> np.ndarray:
    """Rotated rows as whole numbers, summed in a fixed order, so that a vector gives the
    same numbers in whatever company it is."""
    turn, out = rotation(dim), np.zeros_like(turned_rows)
    for j in range(dim):
        out += turned_rows[:, j : j + 1] * turn[j]
    return np.rint(out * _UNIT).astype(np.int64)


def first_block(left: np.ndarray, right: np.ndarray, dim: int, cosine: float) -> np.ndarray:
    """The first block in which each pair of whole-number rows is within its share."""
    squares = (left - right) ** 2
    sums = np.stack([squares[:, a:b].sum(1) for a, b in block_edges(dim)], 1)
    return (sums <= np.floor(budgets(dim, cosine) * (1 + SLACK) * _UNIT * _UNIT)).argmax(1)


def _linked(unit: np.ndarray, one: np.ndarray, two: np.ndarray, block: int, dim: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of ``one``, rows of ``two``) that link and count in this block. With
    ``one is two`` each unordered pair comes once."""
    low, high = block_edges(dim)[block]
    turned = (unit @ rotation(dim)[:, low:high]).astype(np.float32)
    limit = np.float32(budgets(dim, cosine)[block] * 1.001 + 1e-5)  # doubles and floats differ by less
    squares, ones = (turned**2).sum(1, keepdims=True), np.ones((len(turned), 1), np.float32)
    # One product gives squared distances: (x, |x|^2, 1) by (-2y, 1, |y|^2).
    left, right = np.hstack([turned, squares, ones]), np.hstack([-2 * turned, ones, squares])
    for at in range(0, len(one), 512):
        rows = one[at : at + 512]
        others = two[at:] if one is two else two  # of one sub-cell each pair is met once
        near = np.flatnonzero(left[rows] @ right[others].T <= limit)
        i, j = np.divmod(near, len(others))
        i, j = rows[i], others[j]
        if one is two:
            i, j = i[i < j], j[i < j]
        for begin in range(0, len(i), CHECKED_AT_ONCE):
            a, b = i[begin : begin + CHECKED_AT_ONCE], j[begin : begin + CHECKED_AT_ONCE]
            good = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            a, b = a[good], b[good]
            if len(a):
                used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                numbers = _whole_blocks(unit[used], dim)
                counts_here = first_block(numbers[place[: len(a)]], numbers[place[len(a) :]], dim, cosine) == block
                yield a[counts_here], b[counts_here]


def _join(pairs: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(node, links, to): for every vector of a pair of sub-cells the links it has there,
    with copies, and one vector it is connected with."""
    keys = ["block", "one", "two"]

    def run(batches):
        for group in _groups(batches, keys, dim):
            block, same = group["block"], group["one"] == group["two"]
            node, weight, unit = group["node"], group["weight"], units(group["v"])
            first = np.flatnonzero(group["mine"] == group["one"])
            second = first if same else np.flatnonzero(group["mine"] == group["two"])
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for a, b in _linked(unit, first, second, block, dim, cosine):
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                unite(root, a, b)
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[hit]), pa.array(links[hit]), pa.array(node[root[hit]])], names=["node", "links", "to"]
                )

    placed = pairs.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, "node long, links long, to long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], dim: int) -> Iterator[dict]:
    """One group at a time; it holds at most two sub-cells."""
    held: list[dict] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n).to_numpy() for n in (*keys, "mine", "node", "weight")}
        columns["v"] = np.array(batch.column("v").to_pylist(), object)
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            now = tuple(columns[k][a] for k in keys)
            if held and now != key:
                yield _merged(held, key, keys, dim)
                held = []
            key = now
            held.append({n: c[a:b] for n, c in columns.items()})
    if held:
        yield _merged(held, key, keys, dim)


def _merged(held: list[dict], key: tuple, keys: list[str], dim: int) -> dict:
    whole = {n: np.concatenate([h[n] for h in held]) for n in ("mine", "node", "weight")}
    whole["v"] = _unpacked([b for h in held for b in h["v"].tolist()], dim)
    return whole | {k: int(v) for k, v in zip(keys, key)}


def vector_links(nodes: DataFrame, cosine: float) -> DataFrame:
    """(node, links, to) over all lengths of vectors."""
    dims = [r["dim"] for r in nodes.select("dim").distinct().orderBy("dim").collect()]
    found = [_join(_cell_pairs(nodes.filter(F.col("dim") == d), d, cosine), d, cosine) for d in dims]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return materialize(out, "links")


def near_duplicate_vectors(
    vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    rows = usable(vectors, id_column, vector_column)
    nodes = _distinct(rows)
    if nodes.isEmpty():
        linked = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        links = vector_links(nodes, cosine)
        counts = links.groupBy("node").agg(F.sum("links").alias("links"))
        classes = connected_components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
        known = nodes.select("node", "dim", "v", "weight").join(counts, "node", "left").join(classes, "node", "left")
        known = known.select(
            "dim", "v", F.coalesce("component", "node").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
        placed = rows.filter("fit").join(known, ["dim", "v"]).select("id", "n_links", "component")
        placed = materialize(placed, "placed")
        smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
        linked = placed.join(smallest, "component").select("id", "n_links", "component_id")
        alone = rows.filter("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        linked = linked.unionAll(alone)
    return linked.select(
        F.col("id").alias(id_column), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
