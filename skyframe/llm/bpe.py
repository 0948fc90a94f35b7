"""Byte-pair encoding and decoding with content-defined chunk reuse.

A rolling hash cuts every text into chunks where its own bytes say so, so a passage that
documents share gives the same chunks wherever it stands. Chunks are counted over all
documents; those that save most by reuse, up to ``REUSED_BYTES`` of text, are encoded
once and handed to every task. All other text is encoded where it stands, so the bound
is one of memory and never of results.

A chunk's own first and last word may go on in its neighbours. Only its inner ids, from
its first to its last white space, are reused; what lies between two inner parts is
encoded again, together with the known word at either side. Where the ids of those two
words come out as known, the join is exact; if they do not, the window grows until they
do, and at last is the whole text.

Defined results: a null text is encoded like the empty one, to no ids. Every row gives a
row. Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import small_batches, utf8
from skyframe.llm.wordbpe import WordBpe, encoder
from skyframe.session import materialize

WINDOW = 48
#: A cut comes where the top bits of the window's hash are zero: every 1,024 bytes on average.
CUT_BITS = 10
MIN_CHUNK = 256
MAX_CHUNK = 8192
#: Text of all chunks that are encoded ahead and sent to every task.
REUSED_BYTES = 4 << 20
#: Any odd number serves; its powers weigh the bytes of the window.
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 16

_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    steps = np.full(SEGMENT + WINDOW + 1, base & _MASK, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


POWERS = _powers(BASE)
INVERSES = _powers(pow(BASE, -1, 1 << 64))


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW bytes allows a cut.

    The hash of a window is a difference of prefix sums, brought to the same power.
    """
    found = []
    for at in range(0, max(len(data) - WINDOW + 1, 0), SEGMENT):
        part = data[at : at + SEGMENT + WINDOW - 1].astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * POWERS[: len(part)], dtype=np.uint64)])
        hashes = (sums[WINDOW:] - sums[:-WINDOW]) * INVERSES[: len(part) - WINDOW + 1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + at + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(data: bytes) -> list[bytes]:
    """Chunks of MIN_CHUNK to MAX_CHUNK bytes; cuts never fall inside a character."""
    if len(data) <= MIN_CHUNK:
        return [data] if data else []
    cuts, begin = [0], 0
    for cut in [*cut_candidates(np.frombuffer(data, np.uint8)).tolist(), len(data)]:
        while cut - begin > MAX_CHUNK:
            begin = _at_character(data, begin + MAX_CHUNK)
            cuts.append(begin)
        if cut < len(data):
            cut = _at_character(data, cut)
            if cut - begin < MIN_CHUNK:
                continue
        if cut > begin:
            cuts.append(cut)
            begin = cut
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _at_character(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _inner(chunk: bytes) -> tuple[int, int]:
    """First and last white space that surely parts words; (-1, -1) without two of them."""
    firsts = [i for i in (chunk.find(b" "), chunk.find(b"\n")) if i >= 0]
    if not firsts:
        return -1, -1
    first, last = min(firsts), max(chunk.rfind(b" "), chunk.rfind(b"\n"))
    return (first, last) if last > first else (-1, -1)


def reused_chunks(docs: DataFrame, text_column: str, max_bytes: int = REUSED_BYTES) -> DataFrame:
    """(chunk) of the texts whose reuse saves most, at most ``max_bytes`` in all.

    Chunks are counted by hash over all documents. Savings fall into powers of two; the
    bins are taken from the top while their texts fit, which needs 64 counts, no sort.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_column).alias("text"))

    def hashes(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            found = [c for t in utf8(batch.column("text")) for c in chunks(t)]
            h = np.array([xxh3_64_intdigest(c) for c in found], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.array([len(c) for c in found], np.int32))], names=["h", "size"]
            )

    counted = texts.mapInArrow(hashes, "h long, size int").groupBy("h").agg(
        F.count("*").alias("n"), F.max("size").cast("long").alias("size")
    )
    saving = F.floor(F.log2((F.col("n") - 1) * F.col("size"))).alias("bin")
    shared = materialize(counted.filter("n > 1").select("h", "size", saving), "shared")
    bins = shared.groupBy("bin").agg(F.sum("size").alias("bytes")).orderBy(F.desc("bin")).collect()
    least, total = None, 0
    for row in bins:
        total += row["bytes"]
        if total > max_bytes:
            break
        least = row["bin"]
    if least is None:
        return docs.sparkSession.createDataFrame([], "chunk binary")
    wanted = {r["h"] for r in shared.filter(F.col("bin") >= least).select("h").collect()}  # max_bytes / MIN_CHUNK at most
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def fetch(batches):
        from xxhash import xxh3_64_intdigest

        seen: set[int] = set()
        for batch in batches:
            found = []
            for t in utf8(batch.column("text")):
                for c in chunks(t):
                    h = xxh3_64_intdigest(c)
                    h -= (h >> 63) << 64
                    if h in sent.value and h not in seen:
                        seen.add(h)
                        found.append((h, c))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary())], names=["h", "chunk"]
                )

    return texts.mapInArrow(fetch, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk")).select("chunk")


class Known:
    """A reused chunk: the words at its inner ends, and the ids of all inner words."""

    __slots__ = ("first", "last", "ids", "head", "tail", "left", "right")

    def __init__(self, bpe: WordBpe, chunk: bytes, ids: np.ndarray) -> None:
        first, last = _inner(chunk)
        words = chunk[first:last].decode().replace("\n", " ").split(" ")
        words = [w for w in words if w]
        self.ids = ids
        self.head, self.tail = chunk[:first], chunk[last:]
        self.first, self.last = (words[0], words[-1]) if words else ("", "")
        self.left, self.right = bpe.encode(self.first), bpe.encode(self.last)


def encode_inner(chunks_: DataFrame, path: str) -> DataFrame:
    """(chunk, ids): the ids of the inner part of each chunk, as 32-bit numbers."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            found = batch.column("chunk").to_pylist()
            spans = [_inner(c) for c in found]
            ids = [bpe.encode(c[a:b].decode() if b > a else "").astype("<u4").tobytes() for c, (a, b) in zip(found, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    return chunks_.mapInArrow(run, "chunk binary, ids binary")


def encode_with_reuse(bpe: WordBpe, data: bytes, known: dict[bytes, Known]) -> np.ndarray:
    """Ids of a whole text from reused inner ids and joins encoded anew."""
    parts = [known.get(c, c) for c in chunks(data)] if known else [data]
    if not any(isinstance(p, Known) for p in parts):
        return bpe.encode(data.decode())
    out: list[np.ndarray] = []
    between: list[bytes] = []
    before: Known | None = None
    for part in [*parts, None]:
        if isinstance(part, bytes):
            between.append(part)
            continue
        if part is not None:
            between.append(part.head)
        ids = _join(bpe, before, b"".join(between).decode(), part)
        if ids is None:  # no agreement at any width below the whole text
            return np.array(bpe.whole([data.decode()])[0], np.uint32)
        out.append(ids)
        if part is not None:
            out.append(part.ids)
            between = [part.tail]
        before = part
    return np.concatenate(out)


def _join(bpe: WordBpe, before: Known | None, text: str, after: Known | None) -> np.ndarray | None:
    """Ids of ``text`` between two inner parts, encoded with the known word at each side;
    None if those words come out otherwise."""
    left, right = before.right if before else None, after.left if after else None
    window = f"{before.last if before else ''}{text} {after.first if after else ''}"
    ids = bpe.encode(window) if len(window) > 2048 else np.array(bpe.whole([window])[0], np.uint32)
    start, end = len(left) if before else 0, len(ids) - (len(right) if after else 0)
    agrees = (not before or np.array_equal(ids[:start], left)) and (not after or np.array_equal(ids[end:], right))
    return ids[start:end] if agrees and start <= end else None


def encode_documents(
    docs: DataFrame, path: str, text_column: str = "text", decoded: bool = False, max_bytes: int = REUSED_BYTES
) -> DataFrame:
    """Documents with ``ids`` (array of int) and, if asked for, the ``decoded`` text."""
    spark = docs.sparkSession
    small_batches(spark)
    table = encode_inner(reused_chunks(docs, text_column, max_bytes), path).collect()  # bounded by max_bytes
    sent = spark.sparkContext.broadcast([(bytes(r["chunk"]), bytes(r["ids"])) for r in table])
    kept = [c for c in docs.columns if c not in ("ids", "decoded", "_text")]
    rows = docs.select(*kept, F.col(text_column).alias("_text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        held = ((c, np.frombuffer(i, "<u4")) for c, i in sent.value)
        known = {c: Known(bpe, c, i) for c, i in held if _inner(c)[0] >= 0} if bpe.split else {}
        for batch in batches:
            found = [encode_with_reuse(bpe, t, known) for t in utf8(batch.column("_text"))]
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            columns = [batch.column(c) for c in kept] + [ids]
            names = [*kept, "ids"]
            if decoded:
                columns.append(pa.array([bpe.decode(f.tolist()) for f in found], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema + (", decoded string" if decoded else ""))
