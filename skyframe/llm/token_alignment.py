"""Alignment of two tokenizers: which tokens of one lie on which tokens of the other.

Each text is encoded whole by both: a byte-level BPE (A) and a piece model (B). Where the
joined bytes of both are the same, the ends that tokens of both share are known byte by
byte. A shared end before a token marked by a space, in both, is an anchor. Anchors split a
document into windows of a word or a few, and a window is a tuple of A ids and a tuple of B
ids. The alignment of such a pair of tuples is worked out once and looked up afterwards.
Encoding is shared too: a text is cut at single spaces that no token of either can reach
over, which gives the ids of the whole text, and a part that occurs again is looked up.

Links are weighed by how many documents of the corpus hold the pair of ids linked.
``weigh_links`` counts the pairs inside tasks, adds the counts up by a shuffle, and sends the
most frequent pairs (at most ``HOT_PAIRS``) to all tasks; links of the other pairs, which
few documents hold each, meet their counts by a second shuffle.

Defined results: a null or empty text, and one whose joined A or B bytes differ from a space and
the text, has no tokens: counts are 0 and groups are ''. Every row is a document, so repeated
rows and null ids count as often as they occur. An empty table gives no rows. Only the two
named columns are read, so other columns cannot matter.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import small_batches, utf8
from skyframe.llm.wordbpe import BYTE_LETTERS
from skyframe.session import materialize

#: Text given to the library at once (a longer text goes alone).
BATCH_BYTES = 1 << 20
#: Tokens of the windows remembered in a Python worker; beyond, it starts anew.
MEMO_TOKENS = 3_000_000
#: Parts of texts encoded at once.
PARTS_AT_ONCE = 4096
#: The space mark of B would be read as a space; the other is white space to some patterns only.
ODD_ENDS = "\u2581\u180e"
#: How byte-level tokenizers cut words, and the end of the letters that it is applied to here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_END = "\u0250"
#: Pairs sent to all tasks: those that hold this share of all (document, pair).
HOT_PAIRS = 1 << 19
#: Pairs of documents counted at once in a task.
COUNT_AT_ONCE = 2_000_000

ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


class TwoTokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = {chr(BYTE_LETTERS.get(byte, byte)): byte for byte in range(256)}
        self.bytes_a: list[bytes] = [b""] * (max(self.a.get_vocab().values(), default=-1) + 1)
        for entry, token in self.a.get_vocab().items():
            known = all(c in letters for c in entry)
            self.bytes_a[token] = bytes(letters[c] for c in entry) if known else entry.encode()
        self.bytes_b: list[bytes] = []
        for token in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(token)
            one = self.b.is_byte(token)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if one else piece.replace("▁", " ").encode())
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)

        # Where neither tokenizer can join what lies on both sides of a single space, a text may
        # be encoded in parts. B cannot if no piece holds a space mark after another character,
        # A cannot if it is byte-level with its own pattern, which starts a word at such a space.
        inner = any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(self.b.get_piece_size())))
        kind = json.loads(self.a.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.quick = self._by_ranks(kind)
        self.in_parts = not inner and kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)

    def _by_ranks(self, kind: dict):
        """A by the ranks of its tokens, or None. Where the merges stand in the order of the ids
        they make, merging the pair of the lowest id is the same as merging the first pair."""
        import tiktoken

        model = kind["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [model["vocab"].get("".join(m)) for m in merges]
        if model.get("type") != "BPE" or None in made or any(x >= y for x, y in zip(made, made[1:])):
            return None
        singles = {b for b in self.bytes_a if len(b) == 1}
        if len(singles) < 256 or model.get("ignore_merges") or model.get("dropout") or model.get("end_of_word_suffix"):
            return None
        special = {t["content"] for t in kind.get("added_tokens", [])}
        ranks = {self.bytes_a[i]: i for entry, i in model["vocab"].items() if entry not in special}
        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """(A ids, B ids) of each text. Texts of common letters go by ranks, which gives the
        same ids sooner; for all others the libraries' tables of characters might differ."""
        plain = [self.quick is not None and (t.isascii() or max(t) < PLAIN_END) for t in texts]
        rest = [" " + t for t, p in zip(texts, plain) if not p]
        others = iter(self.a.encode_batch_fast(rest, add_special_tokens=False))
        for text, p, b in zip(texts, plain, self.b.encode(texts, num_threads=1)):
            yield self.quick(" " + text) if p else next(others).ids, b

    def same_bytes(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both are a space and the text, byte by byte."""
        whole = b" " + text.encode()
        return b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole


def parts_of(text: str) -> list[str]:
    """A text cut at single spaces between characters that are no white space; the space
    itself belongs to the part after it, which each tokenizer puts back."""
    parts = text.split(" ")
    if all([p and not p[0].isspace() and not p[-1].isspace() for p in parts]) and not any(c in text for c in ODD_ENDS):
        return parts
    out, held = [], [parts[0]]
    for part in parts[1:]:
        last = held[-1]
        if last and part and not (last[-1].isspace() or part[0].isspace() or last[-1] in ODD_ENDS or part[0] in ODD_ENDS):
            out.append(" ".join(held))
            held = []
        held.append(part)
    return [*out, " ".join(held)]


@lru_cache(maxsize=1)
def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)


def align_window(a: tuple[int, ...], b: tuple[int, ...], len_a: list[int], len_b: list[int], names_b: int) -> tuple[str, list[int]]:
    """Groups as text, and the linked pairs as numbers, of tokens that cover the same bytes.
    ``len_a`` and ``len_b`` are the lengths of all tokens."""
    i = j = 0
    x, y = a[0], b[0]
    end_a, end_b = len_a[x], len_b[y]
    left, right = str(x), str(y)
    groups, pairs = [], [x * names_b + y]
    while True:
        if end_a == end_b:
            groups.append(f"{left}|{right}")
            i, j = i + 1, j + 1
            if i == len(a):
                return ";".join(groups), pairs
            x, y = a[i], b[j]
            end_a, end_b = end_a + len_a[x], end_b + len_b[y]
            left, right = str(x), str(y)
        elif end_a < end_b:
            i += 1
            x = a[i]
            end_a += len_a[x]
            left += f",{x}"
        else:
            j += 1
            y = b[j]
            end_b += len_b[y]
            right += f",{y}"
        pairs.append(x * names_b + y)


class Aligner:
    """Encodes and aligns texts. Windows are remembered by their id tuples, and parts of texts
    by the windows they hold."""

    def __init__(self, two: TwoTokenizers) -> None:
        self.two = two
        self.names_b = max(len(two.bytes_b), 1)
        self.kind = pair_kind(len(two.bytes_a), self.names_b)
        self.sizes_a, self.sizes_b = two.len_a.tolist(), two.len_b.tolist()
        self.forget()

    def forget(self) -> None:
        self.windows: dict[tuple[tuple[int, ...], tuple[int, ...]], tuple[str, list[int]]] = {}
        self.parts: dict[str, int] = {}
        #: Of each part: (n_a, n_b, n_groups), groups as text, and its links, or None.
        self.counts: list[tuple[int, int, int] | None] = []
        self.groups: list[str] = []
        self.pairs: list[list[int]] = []
        self.tokens = 0

    def _window(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[str, list[int]]:
        found = self.windows.get((a, b))
        if found is None:
            found = self.windows[a, b] = align_window(a, b, self.sizes_a, self.sizes_b, self.names_b)
            self.tokens += len(a) + len(b)
        return found

    def _aligned(self, part: str, a: list[int], b: list[int]) -> tuple[tuple[int, int, int] | None, str, list[int]]:
        """Counts, groups and links of a part: its tokens cut into windows at the verified
        ends before a space."""
        if not self.two.same_bytes(part, a, b):
            return None, "", []
        if " " not in part:
            groups, pairs = self._window(tuple(a), tuple(b))
            return (len(a), len(b), groups.count(";") + 1), groups, pairs
        whole = b" " + part.encode()
        ids_a, ids_b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.two.len_a[ids_a]), np.cumsum(self.two.len_b[ids_b])
        ends = np.zeros((2, len(whole) + 1), bool)
        ends[0, ends_a] = ends[1, ends_b] = True
        anchor = ends[0] & ends[1]
        anchor[:-1] &= np.frombuffer(whole, np.uint8) == 0x20
        cuts_a = [0, *(np.flatnonzero(anchor[ends_a]) + 1).tolist()]
        cuts_b = [0, *(np.flatnonzero(anchor[ends_b]) + 1).tolist()]
        cut = zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
        found = [self._window(tuple(a[i:j]), tuple(b[k:m])) for i, j, k, m in cut]
        groups = ";".join([g for g, _ in found])
        return (len(a), len(b), groups.count(";") + 1), groups, [x for _, pairs in found for x in pairs]

    def documents(self, texts: list[str]) -> list[tuple[int, int, int, int, str, bytes, bytes]]:
        """Of each text n_a, n_b, n_groups, n_links, groups, distinct pairs and how often each
        is linked."""
        if self.tokens > MEMO_TOKENS:
            self.forget()
        split = [(parts_of(t) if self.two.in_parts else [t]) if t else [] for t in texts]
        known = self.parts
        new = list({p for parts in split for p in parts if p not in known})
        for low in range(0, len(new), PARTS_AT_ONCE):
            some = new[low : low + PARTS_AT_ONCE]
            for part, (a, b) in zip(some, self.two.encode(some)):
                counts, groups, pairs = self._aligned(part, a, b)
                known[part] = len(self.counts)
                self.counts.append(counts)
                self.groups.append(groups)
                self.pairs.append(pairs)
        return [self._document(text, [known[p] for p in parts]) for text, parts in zip(texts, split)]

    def _document(self, text: str, parts: list[int]) -> tuple[int, int, int, int, str, bytes, bytes]:
        none = (0, 0, 0, 0, "", b"", b"")
        if not parts:
            return none
        used, often = np.unique(np.array(parts), return_counts=True)
        numbers = used.tolist()
        counts = [self.counts[w] for w in numbers]
        if None in counts:
            # Bytes of a part differ. Only if those of the whole text do not are there tokens.
            [(a, b)] = self.two.encode([text])
            of_text, groups, linked = self._aligned(text, a, b)
            if of_text is None:
                return none
            n_a, n_b, n_groups = of_text
            weights = np.ones(len(linked))
        else:
            n_a, n_b, n_groups = (often @ np.array(counts)).tolist()
            held = [self.pairs[w] for w in numbers]
            linked, weights = list(chain.from_iterable(held)), np.repeat(often, [len(h) for h in held])
            groups = ";".join([self.groups[w] for w in parts])
        pairs, place = np.unique(np.array(linked, np.int64), return_inverse=True)
        times = np.bincount(place, weights=weights).astype("<u4")
        n_links = int(times.sum(dtype=np.int64))
        return n_a, n_b, n_groups, n_links, groups, pairs.astype(self.kind).tobytes(), times.tobytes()


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for all tasks that a Python worker runs, one after the other."""
    return Aligner(two_tokenizers(path_a, path_b))


def pair_kind(names_a: int, names_b: int) -> str:
    """How a pair a * names_b + b is stored: in four bytes, if all fit."""
    return "<u4" if names_a * names_b < 1 << 32 else "<u8"


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each document.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and B between ends both share. ``pairs`` are
    the distinct linked pairs as numbers a * (size of B) + b, ``times`` how often each is.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        # What is remembered is millions of small objects, none of them in a cycle.
        gc.disable()
        try:
            yield from aligned(batches, aligner)
        finally:
            gc.enable()

    def aligned(batches: Iterator[pa.RecordBatch], aligner: Aligner) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), utf8(batch.column("text"))
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= BATCH_BYTES):
                    size += len(texts[high])
                    high += 1
                some = texts[low:high]
                found = aligner.documents([t.decode() for t in some])
                rows = [(i, *f) for i, f in zip(ids[low:high], found)]
                kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
                names = [x.split()[0] for x in ALIGNED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                low = high

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, kind: str, names_b: int) -> DataFrame:
    """(pair, n_docs, best): documents that hold a pair, and whether no other pair of
    its A id is in more."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for raw in batch.column("pairs").to_pylist():
                held.append(np.frombuffer(raw, kind))
                size += len(held[-1])
                if size >= COUNT_AT_ONCE:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    counts = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {names_b}")), "pair_counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def weigh_links(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``aligned`` (with any columns but groups) without pairs and times, with n_best (links
    no other pair of whose A id is in more documents) and count_sum (documents that
    hold the pair, added up over links)."""
    two = two_tokenizers(path_a, path_b)
    names_b = max(len(two.bytes_b), 1)
    kind = pair_kind(len(two.bytes_a), names_b)
    stored = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(stored, kind, names_b), "weighed_pairs")
    total = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    is_hot = F.col("n_docs") * HOT_PAIRS > total
    hot = counts.filter(is_hot).toArrow().sort_by("pair")
    hot_pairs, hot_docs = hot["pair"].to_numpy(), hot["n_docs"].to_numpy()
    hot_best = hot["best"].to_numpy(zero_copy_only=False)
    sent = stored.sparkSession.sparkContext.broadcast((hot_pairs, hot_docs, hot_best))
    keep = [c for c in stored.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for batch in batches:
            n_best, count_sum, rare, rare_times = [], [], [], []
            for raw_pairs, raw_times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                pairs = np.frombuffer(raw_pairs, kind).astype(np.int64)
                times = np.frombuffer(raw_times, "<u4").astype(np.int64)
                at = np.searchsorted(known, pairs)
                at[at == len(known)] = 0
                found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                here = at[found]
                n_best.append(int(times[found][best[here]].sum()))
                count_sum.append(int((times[found] * docs[here]).sum()))
                rare.append(pairs[~found])
                rare_times.append(times[~found])
            new = [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            new += [pa.array(x, pa.list_(pa.int64())) for x in (rare, rare_times)]
            names = [*keep, "n_best", "count_sum", "rare", "rare_times"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], names=names)

    fields = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_best long, count_sum long, rare array<long>, rare_times array<long>"
    summed = materialize(stored.mapInArrow(run, schema), "weighed")
    links = summed.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x"))
    links = links.select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    rest = links.join(counts.filter(~is_hot), "pair")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"),
    )
    joined = summed.join(rest, "row", "left")
    return joined.select(
        *[c for c in keep if c != "row"],
        *[(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum"))],
    )
