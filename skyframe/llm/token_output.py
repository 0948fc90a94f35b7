"""Token ids on disk: documents in order of their ids, in shards compressed by Re-Pair.

The documents are range-partitioned by id, encoded, and closed with an end id. Runs of
about ``SHARD_IDS`` ids become shards. Within a shard the frequent pairs of neighbouring
symbols are replaced by new symbols, pass after pass; a rule is a pair of symbols, and
the length of its expansion is stored with it. A document is a run of symbols, as pairs
never reach over a document's end, so one document can be decoded without the others.

The file format is a table of shards, one row each, so that Spark's commit protocol
covers lost tasks: partition, shard, begins (ids before it in its partition), total (its
ids), doc_ids, id_nulls, sizes (ids of each document), places (first
symbol of each document), first_symbol, rules (pairs), expansions (length of each rule's
expansion) and symbols. Arrays are little-endian 32-bit numbers, doc_ids 64-bit.

Defined results: a null or empty text holds the end id alone. A null doc_id comes first.
Rows of one doc_id are ordered by the hash of their text. An empty table gives no rows.
Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import ragged, small_batches, utf8
from skyframe.llm.wordbpe import encoder

END_ID = 1
#: Ids after which a shard is closed (a longer document is a shard of its own).
SHARD_IDS = 1 << 19
PASSES = 6
#: A pair must occur so often in a shard to be worth a rule.
LEAST_COUNT = 8
#: Rules of one pass; the most frequent pairs first.
RULES_A_PASS = 4096

SHARD_SCHEMA = (
    "partition int, shard int, begins long, total long, doc_ids binary, id_nulls binary, sizes binary, places binary, "
    "first_symbol int, rules binary, expansions binary, symbols binary"
)


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one shard: (rules, expansion lengths, symbols, first symbol of each
    document). ``ends`` is where each document ends in ``ids``.

    Each pass counts all neighbouring pairs, makes rules of the most frequent ones, and
    replaces them from the left wherever both symbols are still free.
    """
    symbols = ids.astype(np.int64)
    last = np.zeros(len(symbols), bool)
    last[ends - 1] = True
    first_symbol = next_symbol = int(symbols.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    for _ in range(PASSES):
        if len(symbols) < 2:
            break
        pairs = (symbols[:-1] << 32) | symbols[1:]
        inside = ~last[:-1]
        # Most pairs are rare. A count by hash tells which can be frequent; only those are sorted.
        bits = max(len(pairs).bit_length(), 10)
        slots = _slots(pairs, bits)
        likely = np.bincount(slots, minlength=1 << bits)[slots] >= LEAST_COUNT
        found, counts = np.unique(pairs[likely & inside], return_counts=True)
        often = counts >= LEAST_COUNT
        found, counts = found[often], counts[often]
        if not len(found):
            break
        if len(found) > RULES_A_PASS:
            best = np.argpartition(-counts, RULES_A_PASS)[:RULES_A_PASS]
            found = np.sort(found[best])
        # Of pairs that share a slot one gets a rule now, the others in a later pass.
        rule_at = np.zeros(1 << bits, np.int32)
        rule_at[_slots(found, bits)] = np.arange(len(found), dtype=np.int32)
        at = rule_at[slots]
        hits = np.flatnonzero((found[at] == pairs) & inside)
        hits = hits[_every_other(hits)]
        used, rank = np.unique(at[hits], return_inverse=True)
        rules.append(np.stack([found[used] >> 32, found[used] & 0xFFFFFFFF], 1))
        symbols[hits] = next_symbol + rank
        next_symbol += len(used)
        last[hits] = last[hits + 1]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        symbols, last = symbols[keep], last[keep]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    places = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    return table, expansion_lengths(table, first_symbol), symbols, places


def _slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    """A hash of each pair in so many bits."""
    mixed = pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _every_other(hits: np.ndarray) -> np.ndarray:
    """Of each run of hits at neighbouring places the first, third and so on: those that
    do not overlap."""
    if not len(hits):
        return np.zeros(0, bool)
    begins = np.ones(len(hits), bool)
    begins[1:] = hits[1:] != hits[:-1] + 1
    start = np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
    return (np.arange(len(hits)) - start) % 2 == 0


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Ids that each rule stands for. A rule's parts come before it."""
    lengths: list[int] = []
    for left, right in rules.tolist():
        a = lengths[left - first_symbol] if left >= first_symbol else 1
        b = lengths[right - first_symbol] if right >= first_symbol else 1
        lengths.append(a + b)
    return np.array(lengths, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids of some symbols, by whole expansions of the rules they hold."""
    starts = np.cumsum(expansions) - expansions
    texts = np.zeros(int(expansions.sum()), np.int64)
    known = np.zeros(len(rules), bool)
    while not known.all():
        ready = ~known
        for side in (0, 1):
            part = rules[:, side]
            inner = part >= first_symbol
            ready &= ~inner | known[np.where(inner, part - first_symbol, 0)]
        todo = np.flatnonzero(ready)
        offset = starts[todo].copy()
        for side in (0, 1):
            part = rules[todo, side]
            inner = part >= first_symbol
            texts[offset[~inner]] = part[~inner]
            child = part[inner] - first_symbol
            size = expansions[child]
            texts[ragged(offset[inner], size)] = texts[ragged(starts[child], size)]
            offset[~inner] += 1
            offset[inner] += size
        known[todo] = True
    rule = symbols >= first_symbol
    index = np.where(rule, symbols - first_symbol, 0)
    sizes = np.where(rule, expansions[index], 1) if len(rules) else np.ones(len(symbols), np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    out[(ends - sizes)[~rule]] = symbols[~rule]
    out[ragged((ends - sizes)[rule], sizes[rule])] = texts[ragged(starts[index[rule]], sizes[rule])]
    return out


def write_token_shards(
    docs: DataFrame, folder: str, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID
) -> None:
    """Encode ``docs`` with the tokenizer at ``path`` and write their shards to ``folder``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        partition, shard = TaskContext.get().partitionId(), 0
        names, found, held, begins = [], [], 0, 0
        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), utf8(batch.column("text"))):
                ids = np.append(bpe.encode(text.decode()), end_id)
                names.append(name)
                found.append(ids)
                held += len(ids)
                if held >= SHARD_IDS:
                    yield _shard(partition, shard, begins, names, found)
                    names, found, held, begins, shard = [], [], 0, begins + held, shard + 1
        if found:
            yield _shard(partition, shard, begins, names, found)

    placed.mapInArrow(run, SHARD_SCHEMA).write.parquet(folder)


def _shard(partition: int, shard: int, begins: int, names: list[int | None], found: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(f) for f in found])
    rules, expansions, symbols, places = compress(np.concatenate(found), np.cumsum(sizes))
    first = int(max(f.max() for f in found)) + 1
    blobs = [
        np.array([n or 0 for n in names], "<i8"),
        np.array([n is None for n in names], np.uint8),
        *[sizes.astype("<u4"), places.astype("<u4")],
    ]
    after = [rules.astype("<u4"), expansions.astype("<u4"), symbols.astype("<u4")]
    row = [partition, shard, begins, int(sizes.sum()), *[b.tobytes() for b in blobs], first, *[b.tobytes() for b in after]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int32(), *[pa.binary()] * 3]
    columns = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=columns)


def read_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary: little-endian 32-bit) from the files.

    ``start`` counts the ids of all documents before. The driver adds up the totals of
    the partitions, one number each; inside a partition the shards know their place.
    """
    small_batches(spark)
    stored = spark.read.parquet(folder)
    totals = stored.groupBy("partition").agg(F.max(F.col("begins") + F.col("total")).alias("total"))
    starts, at = {}, 0
    for partition, total in sorted(totals.collect()):
        starts[partition] = at
        at += total
    sent = spark.sparkContext.broadcast(starts)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number = {k: np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("sizes", "places", "rules", "expansions", "symbols")}
                ids = expand(number["symbols"], number["rules"].reshape(-1, 2), number["expansions"], row["first_symbol"])
                ends = np.cumsum(number["sizes"])
                begins = ends - number["sizes"]
                nulls = np.frombuffer(row["id_nulls"], np.uint8).astype(bool)
                blob = ids.astype("<u4").tobytes()
                for low in range(0, len(ends), 256):
                    some = slice(low, low + 256)
                    texts = [blob[4 * a : 4 * b] for a, b in zip(begins[some].tolist(), ends[some].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.frombuffer(row["doc_ids"], "<i8")[some], mask=nulls[some]),
                            pa.array(begins[some] + sent.value[row["partition"]] + row["begins"]),
                            pa.array(number["sizes"][some]),
                            pa.array(texts, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def decode_document(row: dict, index: int) -> np.ndarray:
    """Ids of one document of a stored shard, from its own symbols and the rules."""
    places = np.append(np.frombuffer(row["places"], "<u4"), len(row["symbols"]) // 4)
    symbols = np.frombuffer(row["symbols"], "<u4")[places[index] : places[index + 1]].astype(np.int64)
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    return expand(symbols, rules, np.frombuffer(row["expansions"], "<u4").astype(np.int64), row["first_symbol"])
