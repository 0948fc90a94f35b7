"""Near-duplicate documents by 64-bit fingerprints and bit-sliced comparison.

Two fingerprints within ``RADIUS`` bits agree on at least one of ``RADIUS + 1`` bands of
their bits. Fingerprints that share a band meet in one group; a group that is too large
is cut again by the bits its rows have not yet agreed on, which stays exact. Inside a
group the bits are stored vertically: one word holds one bit of 64 fingerprints, and a
few carry-save counters follow the distances of 64 pairs at once.

A corpus (``one_of_each``) takes shorter shingles and a wider radius, so that most texts
with a similarity of 0.8 or more are within it. There a link is a proposal: the two texts
are compared, and it counts if the Jaccard similarity of their five-word shingles is
``SIMILAR`` or more. First each group proposes two forests of its nearest pairs, which joins
most of what is similar. Then every other pair within the radius whose texts are not yet in
one component is compared too, inside the group where the two first meet: sets of shingle
hashes come to the group, and only links that join something leave it. So no link is lost
and no pairs of a large group are listed.

Defined results: a text that is null, empty or white space has the fingerprint zero.
Repeated rows each give a row. A null ``doc_id`` is ignored when the smallest of a
component is taken, and is the component if the component has no other. Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import groups_in_order, ragged, run_starts, small_batches, utf8
from skyframe.llm.components import connected_components
from skyframe.session import broadcast_if_small, materialize

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Near copies of a corpus: words of a shingle and bits by which fingerprints propose
#: them, then words of a shingle and least Jaccard similarity.
CORPUS_WORDS = 3
CORPUS_RADIUS = 8
SIMILAR_WORDS = 5
SIMILAR = 0.8
#: Distinct fingerprints of one group that are compared with each other in one task.
GROUP_ROWS = 2048
#: Levels of bands; after them a group is compared block by block.
LEVELS = 4
#: Shingles (8 bytes each) of the texts that are compared with each other in one task, rows
#: that a task holds at once, and shingles that one text meets at once.
GROUP_SHINGLES = 4_000_000
HELD_ROWS = 1000
SLAB = 1_000_000
#: In place of a path: the texts of one fingerprint, which is the key.
ONE_FINGERPRINT = -1
#: Keys of over-full groups that may be broadcast (24 bytes each).
BROADCAST_KEYS = 100_000


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority of the bits of all shingle hashes; zero for a text without words.

    ``bytes.lower`` and ``bytes.split`` know A-Z and the white space 09-0D and 20 only.
    """
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    width = min(words, len(parts))
    ends = (starts + lengths)[width - 1 :].tolist()
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)]
    h = np.array(hashes, np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(set_bits * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_hash, fp, node) per row; ``fp`` holds the 64 bits as a signed long, and
    ``node`` is a hash of the words in order."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(text_column).alias("text_hash"),
        F.col(text_column).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = utf8(batch.column("text"))
            found = np.array([fingerprint(t, words) for t in texts], np.uint64)
            nodes = np.array([xxh64_intdigest(b" ".join(t.lower().split()), SEED) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(found.view(np.int64)), pa.array(nodes.view(np.int64))],
                names=["id", "text_hash", "fp", "node"],
            )

    return rows.mapInArrow(run, "id long, text_hash long, fp long, node long")


@lru_cache(maxsize=4096)
def band_masks(path: tuple[int, ...], bands: int) -> tuple[int, int]:
    """Bits fixed along ``path`` (one band per level), and those of its last band alone."""
    fixed = 0
    last = 0
    for band in path:
        free = [b for b in range(64) if not fixed >> b & 1]
        low, high = len(free) * band // bands, len(free) * (band + 1) // bands
        last = sum(1 << b for b in free[low:high])
        fixed |= last
    return fixed, last


def _digits(path: int, bands: int) -> tuple[int, ...]:
    """A path is stored as a number whose digits, from the top, are bands plus one."""
    digits = []
    while path:
        digits.append(path % (bands + 1) - 1)
        path //= bands + 1
    return tuple(reversed(digits))


def _deeper(rows: DataFrame, radius: int) -> DataFrame:
    """Each (path, key, fp) under every band of the bits that its path leaves free."""
    bands = radius + 1

    def run(batches):
        for batch in batches:
            path = batch.column("path").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for p in np.unique(path):
                mine = fp[path == p]
                for band in range(bands):
                    fixed, _ = band_masks((*_digits(int(p), bands), band), bands)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(mine), p * (bands + 1) + band + 1, np.int64)),
                            pa.array((mine & np.uint64(fixed)).view(np.int64)),
                            pa.array(mine.view(np.int64)),
                        ],
                        names=["path", "key", "fp"],
                    )

    return rows.mapInArrow(run, "path long, key long, fp long")


def _planes(fp: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: bit r of word (b, p) is bit p of fingerprint 64 * b + r."""
    blocks = -(-len(fp) // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    turned = np.ascontiguousarray(bits.transpose(0, 2, 1))
    return np.packbits(turned, axis=2, bitorder="little").view("<u8").reshape(blocks, 64)


def close_words(planes: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query fingerprint, block of 64): which pairs have a close row, and the
    word of rows at most ``radius`` bits away.

    Distances are kept as bit-sliced counters of ``levels`` words that saturate into
    ``over``. A pair is abandoned once all its 64 rows are over.
    """
    levels = max(1, (radius + 1).bit_length())
    alive = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(levels)]
    over = np.zeros(len(query), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(64):
        wanted = np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1))
        carry = planes[block, p] ^ wanted
        for i in range(levels):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if p % 4 == 3:
            beyond = over | _exceeds(counters, radius)
            keep = beyond != full
            if not keep.all():
                alive, query, block, over = alive[keep], query[keep], block[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(alive):
                    break
    return alive, ~(over | _exceeds(counters, radius))


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Rows whose counter is over ``radius``, by comparing from the top bit."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def spanning_links(fp: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is close inside each group ``starts[i]:starts[i + 1]``.

    All pairs of a group are compared, but a set of n connected rows is told by n - 1
    links to its first row.
    """
    root = np.arange(len(fp))
    for left, right in close_pairs(fp, starts, radius):
        unite(root, left, right)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return moved, root[moved]


def nearest_links(fp: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs of each group: a spanning forest of the nearest, and one of the rest.
    At most two for each row, however many pairs are close."""
    left = right = np.zeros(0, np.int64)
    for more in close_pairs(fp, starts, radius):
        once = more[0] < more[1]
        left, right = np.concatenate([left, more[0][once]]), np.concatenate([right, more[1][once]])
        bits = np.bitwise_count(fp[left] ^ fp[right])
        first = _forest(left, right, bits, len(fp))
        rest = np.flatnonzero(~first)
        first[rest[_forest(left[rest], right[rest], bits[rest], len(fp))]] = True
        left, right = left[first], right[first]
    return left, right


def _forest(left: np.ndarray, right: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Which pairs are in the least spanning forest; each set takes its least pair, and the
    sets so joined go on."""
    taken = np.zeros(len(left), bool)
    root = np.arange(n)
    # The position breaks ties, so that no two pairs are equal and no circle closes.
    rank = np.empty(len(left), np.int64)
    rank[np.lexsort((np.arange(len(left)), bits))] = np.arange(len(left))
    at = np.argsort(rank)
    open_ = np.arange(len(left))
    while True:
        open_ = open_[root[left[open_]] != root[right[open_]]]
        if not len(open_):
            return taken
        least = np.full(n, len(rank))
        np.minimum.at(least, root[left[open_]], rank[open_])
        np.minimum.at(least, root[right[open_]], rank[open_])
        chosen = at[np.unique(least[least < len(rank)])]
        taken[chosen] = True
        unite(root, left[chosen], right[chosen])


def close_pairs(fp: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows at most ``radius`` bits apart inside each group, some at a time. Of two rows of
    one block both orders come."""
    order_planes, block_rows, pairs_q, pairs_b = [], [], [], []
    blocks = 0
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        n = b - a
        if n < 2:
            continue
        count = -(-n // 64)
        order_planes.append(_planes(fp[a:b]))
        block_rows.append(np.stack([a + 64 * np.arange(count), np.full(count, b)], 1))
        q = np.arange(n)
        later = count - q // 64
        pairs_q.append(np.repeat(a + q, later))
        pairs_b.append(blocks + np.repeat(count - later, later) + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later))
        blocks += count
    if not blocks:
        return
    planes, rows = np.concatenate(order_planes), np.concatenate(block_rows)
    q, b = np.concatenate(pairs_q), np.concatenate(pairs_b)
    for at in range(0, len(q), 65_536):
        part_q, part_b = q[at : at + 65_536], b[at : at + 65_536]
        alive, words = close_words(planes, fp[part_q], part_b, radius)
        hit = words != 0
        alive, words = alive[hit], words[hit]
        for begin in range(0, len(alive), 8192):
            some = alive[begin : begin + 8192]
            bits = np.unpackbits(words[begin : begin + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, offset = np.nonzero(bits)
            left, base = part_q[some][i], rows[part_b[some][i]]
            right = base[:, 0] + offset
            real = (right < base[:, 1]) & (right != left)
            yield left[real], right[real]


def unite(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the sets of each pair; ``root`` is kept flat, with the smallest row as root."""
    while len(left):
        a, b = root[left], root[right]
        differ = a != b
        left, right = left[differ], right[differ]
        if not len(left):
            break
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(root, high, low)
        while True:
            nearer = root[root]
            if (nearer == root).all():
                break
            root[:] = nearer


def apart_links(
    component: np.ndarray, mixed: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ``pairs`` that are not of one component. A ``mixed`` row has texts of several."""
    for left, right in pairs:
        apart = mixed[left] | mixed[right] | (component[left] != component[right])
        yield left[apart], right[apart]


def first_meeting(path: np.ndarray, differing: np.ndarray, radius: int) -> np.ndarray:
    """Whether two fingerprints with these ``differing`` bits, which meet under ``path``, meet
    under no path before it. So each pair within the radius has one group."""
    bands = radius + 1
    first = np.ones(len(path), bool)
    for p in np.unique(path).tolist():
        digits = _digits(p, bands)
        mine = np.flatnonzero(path == p)
        for level, band in enumerate(digits):
            for before in range(band):
                first[mine] &= differing[mine] & np.uint64(band_masks((*digits[:level], before), bands)[1]) != 0
    return first


def _apart_rows(block: dict[str, np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    """(path, key, fp) of the rows that have a pair of two components in their group, if the
    two first meet there."""
    fp, path = block["fp"].view(np.uint64), block["path"]
    busy = np.zeros(len(fp), bool)
    pairs = close_pairs(fp, run_starts(block, ["path", "key"]), radius)
    for left, right in apart_links(block["component"], block["mixed"].astype(bool), pairs):
        met = first_meeting(path[left], fp[left] ^ fp[right], radius)
        busy[left[met]] = busy[right[met]] = True
    for p in np.unique(path[busy]).tolist():
        mine = fp[busy & (path == p)]
        fixed = np.uint64(band_masks(_digits(p, radius + 1), radius + 1)[0])
        columns = [np.full(len(mine), p, np.int64), (mine & fixed).view(np.int64), mine.view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "key", "fp"])


def _compare(rows: DataFrame, radius: int, nearest: bool, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) inside the groups (path, key) of ``rows``. With ``known`` components
    (fp, component, mixed), the rows (path, key, fp) that have pairs which these leave apart."""
    keys = ["path", "key"]
    linked = nearest_links if nearest else spanning_links
    apart = known is not None

    def run(batches):
        for block in groups_in_order(batches, keys):
            if apart:
                yield from _apart_rows(block, radius)
                continue
            fp = block["fp"]
            i, j = linked(fp.view(np.uint64), run_starts(block, keys), radius)
            if len(i):
                ends = [pa.array(np.minimum(fp[i], fp[j])), pa.array(np.maximum(fp[i], fp[j]))]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    if apart:
        rows = rows.join(known, "fp")
    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, "path long, key long, fp long" if apart else "a long, b long")


def _blockwise(rows: DataFrame, counts: DataFrame, group_rows: int) -> DataFrame:
    """Groups that no further band can cut: their rows go to pairs of sub-blocks, so that
    each task sees at most two sub-blocks and every pair of rows meets once."""
    sized = rows.join(counts.select("path", "key", F.ceil(F.col("n") / (group_rows // 2)).alias("parts")), ["path", "key"])
    part = F.pmod(F.xxhash64("fp"), "parts")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, "part").alias("low"), F.greatest(j, "part").alias("high"))
    )
    spread = sized.withColumn("part", part).select("path", "key", "fp", F.explode(pairs).alias("p"))
    # The pair joins the key; a key only tells the groups of a path apart here.
    return spread.select("path", F.xxhash64("key", "p.low", "p.high").alias("key"), "fp")


def fingerprint_links(
    distinct: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS, nearest: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits. The two
    of a ``nearest`` link are that close themselves. With ``known`` components (fp, component,
    mixed) not links come, but rows (path, key, fp): all close pairs that are not in one of
    these are inside the groups of these rows."""
    spark = distinct.sparkSession
    small_batches(spark)
    links = None
    rows = distinct.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key"), "fp")
    for level in range(LEVELS + 1):
        rows = materialize(_deeper(rows, radius), "bands") if level < LEVELS else rows
        counts = rows.groupBy("path", "key").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows)
        counts = materialize(counts, "hot")
        hot = broadcast_if_small(counts.select("path", "key"), BROADCAST_KEYS)
        here = _compare(rows.join(hot, ["path", "key"], "left_anti"), radius, nearest, known)
        links = here if links is None else links.unionAll(here)
        if counts.isEmpty():
            return links
        rows = rows.join(hot, ["path", "key"], "left_semi")
        if level == LEVELS - 1:
            return links.unionAll(_compare(_blockwise(rows, counts, group_rows), radius, nearest, known))
    return links


def fingerprint_components(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component): the component of every distinct fingerprint of ``marked``."""
    distinct = materialize(marked.select("fp").distinct(), "distinct")
    found = connected_components(fingerprint_links(distinct, radius))
    joined = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, text_hash,
    and first_hash, the smallest text hash among the component's rows of that id."""
    marked = materialize(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = fingerprint_components(marked, radius)
    first = marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"))
    sized = materialize(first.join(classes, "fp"), "classes")
    smallest = sized.groupBy("component").agg(F.min("first").alias("smallest"))
    labels = materialize(sized.select("fp", "component").join(smallest, "component").select("fp", "smallest"), "labels")
    return marked.join(labels, "fp").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("smallest.id").alias("component_id"),
        "text_hash",
        F.col("smallest.text_hash").alias("first_hash"),
    )


def similar(left: bytes, right: bytes, words: int = SIMILAR_WORDS, least: float = SIMILAR) -> bool:
    """Whether the sets of shingles have a Jaccard similarity of ``least`` or more. Texts of
    fewer words are one shingle; two without words are alike."""

    def shingles(text: bytes) -> set[bytes]:
        parts = text.lower().split()
        width = min(words, len(parts))
        return {b" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1)} if parts else set()

    a, b = shingles(left), shingles(right)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(a & b)
    return common >= least * (len(a) + len(b) - common)


def shingle_hashes(text: bytes, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles that ``similar`` compares."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    width = min(words, len(parts))
    texts = (b" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1 if parts else 0))
    return np.unique(np.fromiter((xxh64_intdigest(t, SEED) for t in texts), np.uint64))


def similar_inside(block: dict[str, np.ndarray], starts: np.ndarray, radius: int, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Links between similar rows of each group ``starts[i]:starts[i + 1]`` that join what is
    similar among all pairs within the radius. Rows of one component are joined already."""
    fp, path, part = block["fp"].view(np.uint64), block["path"], block["part"]
    sizes = np.array([len(x) // 8 for x in block["shingles"]], np.int64)
    begins = np.cumsum(sizes) - sizes
    all_ids, ids = np.unique(np.frombuffer(b"".join(block["shingles"]), "<u8"), return_inverse=True)
    marked = np.zeros(len(all_ids), bool)
    _, first, component = np.unique(block["component"], return_index=True, return_inverse=True)
    root = first[component]
    found: list[tuple[int, int]] = []
    for left, right in close_pairs(fp, starts, radius):
        small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
        keep = (left < right) & (small >= least * large) & (root[left] != root[right])
        # Of two parts of a group, only pairs across; those of one part meet by themselves.
        keep &= (block["low"][left] == block["high"][left]) | (part[left] != part[right])
        keep &= (fp[left] == fp[right]) == (path[left] == ONE_FINGERPRINT)
        left, right = left[keep], right[keep]
        apart = path[left] == ONE_FINGERPRINT
        apart[~apart] = first_meeting(path[left[~apart]], fp[left[~apart]] ^ fp[right[~apart]], radius)
        order = np.argsort(left[apart], kind="stable")
        left, right = left[apart][order], right[apart][order]
        cuts = np.append(np.flatnonzero(np.append(True, left[1:] != left[:-1])), len(left)).tolist() if len(left) else []
        for low, high in zip(cuts, cuts[1:]):
            i = int(left[low])
            own = ids[begins[i] : begins[i] + sizes[i]]
            marked[own] = True
            slabs = np.cumsum(sizes[right[low:high]]) // SLAB
            for slab in np.unique(slabs):
                others = right[low:high][slabs == slab]
                others = others[root[others] != root[i]]
                if not len(others):
                    continue
                n = sizes[others]
                common = np.add.reduceat(marked[ids[ragged(begins[others], n)]], np.cumsum(n) - n, dtype=np.int64)
                good = others[common >= least * (sizes[i] + n - common)]
                good = good[np.unique(root[good], return_index=True)[1]]
                found += [(i, j) for j in good.tolist()]
                unite(root, np.full(len(good), i), good)
            marked[own] = False
    ends = np.array(found, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def links_inside(members: DataFrame, texts: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between similar texts (node, text) in the groups (path, key) of
    ``members`` (path, key, fp, node, component). A group of many rows or shingles is
    compared part by part."""
    keys = ["path", "key", "low", "high"]

    def shingled(batches):
        for batch in batches:
            found = [shingle_hashes(t) for t in utf8(batch.column("text"))]
            columns = [batch.column("node"), pa.array([f.astype("<u8").tobytes() for f in found], pa.binary()), pa.array([len(f) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "n"])

    def run(batches):
        for block in groups_in_order(batches, keys, HELD_ROWS):
            i, j = similar_inside(block, run_starts(block, keys), radius)
            node = block["node"]
            ends = [pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    sets = materialize(texts.mapInArrow(shingled, "node long, shingles binary, n long"), "shingles")
    sized = members.join(sets.select("node", "n"), "node").groupBy("path", "key").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    whole = (F.col("n") <= GROUP_SHINGLES) & (F.col("rows") <= GROUP_ROWS)
    cut = F.greatest(F.ceil(F.col("n") / (GROUP_SHINGLES // 2)), F.ceil(F.col("rows") / (GROUP_ROWS // 2)))
    sized = sized.select("path", "key", F.when(whole, F.lit(1)).otherwise(cut).cast("long").alias("parts"))
    parted = members.join(sized, ["path", "key"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct(F.least(j, "part").alias("low"), F.greatest(j, "part").alias("high"))
    )
    spread = parted.select("path", "key", "fp", "node", "component", "part", F.inline(pairs))
    placed = spread.join(sets.drop("n"), "node").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, "a long, b long").distinct()


def similar_links(links: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``links`` (a, b) whose texts (node, text) are similar."""
    ends = broadcast_if_small(links, BROADCAST_KEYS)
    sides = [texts.withColumnsRenamed({"node": e, "text": f"text_{e}"}).join(ends, e).select("a", "b", f"text_{e}") for e in "ab"]

    def run(batches):
        for batch in batches:
            a, b = utf8(batch.column("text_a")), utf8(batch.column("text_b"))
            good = pa.array([similar(x, y) for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return sides[0].join(sides[1], ["a", "b"]).mapInArrow(run, "a long, b long")


def _texts_of(named: DataFrame, nodes: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, text): one text of every node that is ``named``. Texts of one node have the
    same words."""
    wanted = nodes.join(named, "node").select("node", F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.xxhash64(text_column).alias("_hash"), F.col(text_column).alias("text"))
    wanted = broadcast_if_small(wanted, BROADCAST_KEYS)
    on = rows["_id"].eqNullSafe(wanted["_id"]) & (rows["_hash"] == wanted["_hash"])
    return materialize(rows.join(wanted, on).select("node", "text").dropDuplicates(["node"]), "texts")


def similar_groups(
    docs: DataFrame, id_column: str, text_column: str, radius: int = CORPUS_RADIUS, words: int = CORPUS_WORDS
) -> DataFrame:
    """(id, text_hash, component_id, first_hash) per row, with the components of texts that
    fingerprints propose and shingles confirm."""
    marked = materialize(fingerprints(docs, id_column, text_column, words), "fingerprints")
    nodes = marked.groupBy("fp", "node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"))
    nodes = materialize(nodes, "nodes")
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    near = materialize(fingerprint_links(heads.select("fp"), radius, nearest=True).distinct(), "near")
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(
        heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b"
    )
    equal = nodes.join(heads, "fp").filter("node <> head")
    links = near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionAll(equal.select(F.col("head").alias("a"), F.col("node").alias("b")))
    links = materialize(links, "proposed")
    named = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    good = materialize(similar_links(links, _texts_of(named, nodes, docs, id_column, text_column)), "similar")
    # Forests and heads may pass over a link, so all pairs they leave apart are compared.
    joined = nodes.join(connected_components(good), "node", "left")
    joined = materialize(joined.select("fp", "node", F.coalesce("component", "node").alias("component")), "joined")
    known = joined.groupBy("fp").agg(F.min("component").alias("component"), (F.min("component") < F.max("component")).alias("mixed"))
    known = materialize(known, "known")
    places = fingerprint_links(known.select("fp"), radius, known=known)
    mixed = known.filter("mixed").select(F.lit(ONE_FINGERPRINT).cast("long").alias("path"), F.col("fp").alias("key"), "fp")
    members = materialize(places.unionAll(mixed).distinct().join(joined, "fp"), "members")
    texts = _texts_of(members.select("node").distinct(), nodes, docs, id_column, text_column)
    rest = materialize(links_inside(members.select("path", "key", "fp", "node", "component"), texts, radius), "rest")
    more = similar_links(rest, texts)
    found = connected_components(good.unionAll(more))
    classes = materialize(nodes.join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "classes")
    smallest = classes.groupBy("component").agg(F.min("first").alias("smallest"))
    labels = materialize(classes.join(smallest, "component").select("node", "smallest"), "labels")
    return marked.join(labels, "node").select(
        F.col("id").alias(id_column), "text_hash", F.col("smallest.id").alias("component_id"), F.col("smallest.text_hash").alias("first_hash")
    )


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = CORPUS_RADIUS, words: int = CORPUS_WORDS
) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id
    stays (of rows repeated whole, one)."""
    groups = similar_groups(docs, id_column, text_column, radius, words)
    kept = groups.filter(
        F.col(id_column).eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    )
    kept = kept.groupBy(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("n"))
    kept = materialize(kept, "kept")
    rows = docs.withColumn("_text_hash", F.xxhash64(text_column))
    same = rows[id_column].cast("long").eqNullSafe(kept["_id"]) & (rows["_text_hash"] == kept["_hash"])
    rows = rows.join(kept, same, "left_semi")
    if not kept.filter("n > 1").isEmpty():  # only then do whole rows repeat
        rows = rows.dropDuplicates([id_column, "_text_hash"])
    return rows.drop("_text_hash")
