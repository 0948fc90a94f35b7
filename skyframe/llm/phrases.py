"""Phrase collocations: contiguous phrases that occur more often than their parts explain.

Texts become chunks once: the words of about ``CHUNK_BYTES`` of text of one language as
numbers, with a mark between pieces. Then phrases are counted by length, one more word a
level. In a chunk the words that are frequent in the whole corpus are ranked by frequency, and
the pairs of neighbours split into square tiles of ranks: tiles that are full enough are
counted in a dense array addressed by the pair itself, all other pairs as sorted coordinates.
Pairs that are frequent in the whole corpus are ranked anew and paired again with their
neighbours, which gives phrases of three words, and so on. What chunks count is added up by
Spark, by the phrase's own text, so every count is exact.

Which phrases of one level are frequent reaches the tasks as a Bloom filter of at most
``MOST_BITS`` bits. It may let others through, which are counted in vain and go by their own
count; it never holds back a frequent one.

Defined results: a null text is empty, a null language is ``und``. Every row is a document,
repeated rows and null ids too. An empty table gives no rows. Only the two named columns
are read, so other columns cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm.common import small_batches, utf8
from skyframe.session import materialize

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
NO_LANGUAGE = "und"
#: Text of a chunk, all of one language; counting it takes some thirty times as much memory.
CHUNK_BYTES = 1 << 19
#: Text of unfinished chunks of all languages together.
HELD_BYTES = 4 << 20
#: Ranks on a tile's side, and tiles on a side that may be dense.
TILE = 512
DENSE_SIDE = 64
#: A tile is counted densely if it has a pair for so many of its cells.
CELLS_A_PAIR = 16
#: Bits of the Bloom filter: 16 for each phrase, at most these.
MOST_BITS = 1 << 27
PROBES = 4
#: Bits by which the hash of a phrase turns before that of its next word joins it.
TURN = 21
PHRASE_HASH = (
    "aggregate(split(phrase, ' '), 0L, (h, word) -> "
    f"(shiftleft(h, {TURN}) | shiftrightunsigned(h, {64 - TURN})) ^ xxhash64(lang, word))"
)
#: A part is hot if it holds this share of all cuts, so at most so many parts are hot.
HOT_SHARE = 4096
#: Parts in which the phrases of one language are ranked before they meet.
SALTS = 64
OUT_ROWS = 50_000

#: Ends of pieces become a byte that no UTF-8 text holds.
BREAK = b"\xff"
TO_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)

CHUNK_SCHEMA = "lang string, words binary, ids binary, n long"
#: ``lang_phrase`` is both with a line end between, which no phrase holds.
COUNT_SCHEMA = "lang_phrase string, n long"


def word_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to chunks: distinct words joined by spaces, and int32 numbers of the
    words in order with -1 between pieces."""
    known: dict[str, dict[bytes, int]] = {}
    found: dict[str, list[np.ndarray]] = {}
    held: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
            words = known.setdefault(lang, {BREAK: 0})
            tokens = text.lower().translate(TO_BREAKS).replace(BREAK, b" \xff ").split()
            ids = [words.setdefault(w, len(words)) for w in tokens]
            ids.append(0)
            found.setdefault(lang, []).append(np.array(ids, np.int32))
            held[lang] = held.get(lang, 0) + len(text)
            if held[lang] >= CHUNK_BYTES:
                yield from _chunks({lang: known.pop(lang)}, found)
                del found[lang], held[lang]
            elif sum(held.values()) >= HELD_BYTES:
                yield from _chunks(known, found)
                known, found, held = {}, {}, {}
    yield from _chunks(known, found)


def _chunks(known: dict[str, dict[bytes, int]], found: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, words in known.items():
        ids = np.concatenate(found[lang]) - 1
        row = [[lang], [b" ".join(list(words)[1:])], [ids.astype("<i4").tobytes()], [int((ids >= 0).sum())]]
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["lang", "words", "ids", "n"])


def count_pairs(
    left: np.ndarray, right: np.ndarray, ranks: int, places: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ranks below ``ranks``: (left, right, count, place of each input
    pair among them). Without ``places`` there are none of these."""
    inverse = np.zeros(len(left) if places else 0, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    row, column = left // TILE, right // TILE
    near = (row < DENSE_SIDE) & (column < DENSE_SIDE)
    tile = np.where(near, row * DENSE_SIDE + column, DENSE_SIDE * DENSE_SIDE)
    filled = np.bincount(tile, minlength=DENSE_SIDE * DENSE_SIDE + 1)[:-1]
    sparse = np.ones(len(left), bool)
    for t in np.flatnonzero(filled * CELLS_A_PAIR >= TILE * TILE):
        here = np.flatnonzero(tile == t)
        cell = left[here] % TILE * TILE + right[here] % TILE
        counts = np.bincount(cell, minlength=TILE * TILE)
        used = np.flatnonzero(counts)
        if places:
            place = np.zeros(TILE * TILE, np.int64)
            place[used] = np.arange(len(used)) + size
            inverse[here] = place[cell]
        parts.append((used // TILE + t // DENSE_SIDE * TILE, used % TILE + t % DENSE_SIDE * TILE, counts[used]))
        size += len(used)
        sparse[here] = False
    rest = np.flatnonzero(sparse)
    codes = left[rest] * ranks + right[rest]
    if places:
        codes, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
        inverse[rest] = at + size
    else:
        codes, counts = np.unique(codes, return_counts=True)
    parts.append((codes // max(ranks, 1), codes % max(ranks, 1), counts))
    return (*[np.concatenate(p) for p in zip(*parts)], inverse)


class Bloom:
    """Which phrases may be frequent."""

    def __init__(self, slots: np.ndarray, bits: int) -> None:
        self.slots, self.bits = slots, bits

    def holds(self, lang: str, phrases: list[bytes]) -> np.ndarray:
        found = np.zeros(len(phrases), np.uint64)
        for i, phrase in enumerate(phrases):
            for h in word_hashes(lang, phrase.split(b" ")):
                found[i] = extended(found[i], h)
        return self.holds_hashes(found)

    def holds_hashes(self, hashes: np.ndarray) -> np.ndarray:
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        inside = np.ones(len(hashes), bool)
        for j in range(PROBES):
            at = (low + np.uint64(j) * high) & np.uint64(self.bits - 1)
            inside &= (self.slots[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return inside


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Spark's ``xxhash64(lang, word)`` of every word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word, from theirs and the word's: so a phrase has no
    text before it is given out. The same as ``PHRASE_HASH``."""
    return ((hashes << np.uint64(TURN)) | (hashes >> np.uint64(64 - TURN))) ^ words


def bloom_of(counts: DataFrame) -> Bloom:
    """The filter of all (lang, phrase), put together by Spark; the driver gets at most
    MOST_BITS / 64 numbers."""
    bits = min(MOST_BITS, 1 << max(16, (16 * counts.count()).bit_length()))
    probes = [f"((h & 4294967295) + {j} * (shiftrightunsigned(h, 32) | 1)) & {bits - 1}" for j in range(PROBES)]
    at = counts.select(F.expr(PHRASE_HASH).alias("h")).select(F.explode(F.array(*map(F.expr, probes))).alias("at"))
    mask = F.expr("shiftleft(1L, int(at & 63))").alias("mask")
    found = at.select(F.expr("int(at div 64)").alias("slot"), mask).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros(bits // 64, np.uint64)
    slots[found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Bloom(slots, bits)


def counted_phrases(lang: str, words: list[bytes], ids: np.ndarray, blooms: list[Bloom]) -> tuple[list[np.ndarray], np.ndarray]:
    """Phrases of one word more than there are filters, as the numbers of their first,
    second, ... words, with their counts in a chunk."""
    at = np.flatnonzero(ids >= 0)
    inverse = ids[at].astype(np.int64)
    counts = np.bincount(inverse, minlength=len(words))
    parts = [np.arange(len(words))]
    hashes = of_word = word_hashes(lang, words) if blooms else np.zeros(0, np.uint64)
    for n, bloom in enumerate(blooms, 1):
        # Rank what may be frequent, the most frequent first.
        inside = np.flatnonzero(bloom.holds_hashes(hashes))
        inside = inside[np.argsort(-counts[inside], kind="stable")]
        rank = np.full(len(hashes), -1, np.int64)
        rank[inside] = np.arange(len(inside))
        here = np.full(len(ids), -1, np.int64)
        here[at] = rank[inverse]
        at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        left, right, counts, inverse = count_pairs(here[at], here[at + 1], len(inside), n < len(blooms))
        # A phrase is its first part and the last word of its second part.
        left, last = inside[left], parts[-1][inside[right]]
        parts = [*[p[left] for p in parts], last]
        hashes = extended(hashes[left], of_word[last])
    return parts, counts


def texts_of(parts: list[np.ndarray], words: pa.Array, begin: str = "") -> pa.Array:
    """The words of each phrase joined by spaces, after ``begin``."""
    first = pc.binary_join_element_wise(begin, words, "") if begin else words
    columns = [first.take(pa.array(parts[0])), *[words.take(pa.array(p)) for p in parts[1:]]]
    return pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]


def phrases_of(lang: str, words: list[bytes], ids: np.ndarray, blooms: list[Bloom]) -> tuple[list[bytes], np.ndarray]:
    """The phrases of ``counted_phrases`` by their text."""
    parts, counts = counted_phrases(lang, words, ids, blooms)
    return [t.encode() for t in texts_of(parts, pa.array(words, pa.binary()).cast(pa.string())).to_pylist()], counts


def count_phrases(chunks: DataFrame, blooms: list[Bloom]) -> DataFrame:
    """(lang, phrase, n) of phrases of one word more than there are filters."""
    sent = chunks.sparkSession.sparkContext.broadcast(blooms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in range(batch.num_rows):
                lang, words, ids = (batch.column(c)[chunk].as_py() for c in ("lang", "words", "ids"))
                known = words.split(b" ")
                parts, counts = counted_phrases(lang, known, np.frombuffer(ids, "<i4"), sent.value)
                texts = pa.array(known, pa.binary()).cast(pa.string())
                for low in range(0, len(counts), OUT_ROWS):
                    some = texts_of([p[low : low + OUT_ROWS] for p in parts], texts, f"{lang}\n")
                    n = pa.array(counts[low : low + OUT_ROWS].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([some, n], names=["lang_phrase", "n"])

    counted = chunks.select("lang", "words", "ids").mapInArrow(run, COUNT_SCHEMA).groupBy("lang_phrase").agg(F.sum("n").alias("f"))
    phrase = F.substring_index("lang_phrase", "\n", -1)
    lang = F.left("lang_phrase", F.length("lang_phrase") - F.length("phrase") - 1)
    return counted.withColumn("phrase", phrase).select(lang.alias("lang"), "phrase", "f")


def _with_count(cuts: DataFrame, counts: DataFrame, part: str, name: str, total: int) -> DataFrame:
    """``cuts`` with the count of their part. A part of very many cuts is looked up in a
    broadcast of at most HOT_SHARE parts; all others meet by a shuffle."""
    of_part = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    hot = cuts.groupBy("lang", part).count().filter(F.col("count") * HOT_SHARE > total).select("lang", part)
    hot = F.broadcast(materialize(hot.join(of_part, ["lang", part]), "hot_parts"))
    rest = cuts.join(hot.select("lang", part), ["lang", part], "left_anti")
    return cuts.join(hot, ["lang", part]).unionByName(rest.join(of_part, ["lang", part]))


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    cover: int = 80,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of count a is cut into two parts of counts l and r where its score,
    floor(2,000,000 a / (l + r)), is lowest. One is left out if a longer phrase that holds
    it has ``cover`` hundredths of its count. n is the number of words of the language.
    """
    small_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(HELD_BYTES))
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    texts = docs.select(lang, F.col(text_column).alias("text"))
    chunks = materialize(texts.mapInArrow(word_chunks, CHUNK_SCHEMA), "word_chunks")

    levels: list[DataFrame] = []
    blooms: list[Bloom] = []
    for size in range(1, max_words + 1):
        frequent = count_phrases(chunks, blooms).filter(F.col("f") >= min_count)
        levels.append(materialize(frequent.withColumn("size", F.lit(size)), f"phrases_{size}"))
        if size < max_words:
            blooms.append(bloom_of(levels[-1]))
    counts = reduce(DataFrame.unionByName, levels)
    candidates = counts.filter(F.col("size") > 1)

    def words(first, count):
        return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")

    one_cut = F.struct(F.col("k"), words(F.lit(1), F.col("k")).alias("head"), words(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), one_cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    cuts = materialize(cuts, "cuts")
    total = cuts.count()
    cuts = _with_count(materialize(_with_count(cuts, counts, "head", "l", total), "cuts"), counts, "tail", "r", total)
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.*")

    inner = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part_size")
    longer = counts.filter(F.col("size") > 2).select("*", inner)
    longer = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part_size") + 1)).alias("first"))
    longer = longer.select("lang", words(F.col("first"), F.col("part_size")).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.coalesce(F.col("longer"), F.lit(0)) * 100 >= F.col("a") * cover
    stay = scored.join(longer, ["lang", "phrase"], "left").filter(~covered).drop("longer")

    # The best of each part of a language first, so that no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = stay.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
