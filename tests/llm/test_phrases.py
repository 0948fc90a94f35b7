"""Collocations against counts by dictionaries."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import phrases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_count, max_words, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= 80 * candidates[p[i : i + size]]:
                        covered.add(p[i : i + size])
        found = []
        for p, a in candidates.items():
            if p in covered:
                continue
            cuts = [(counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, k = min((2_000_000 * a // (left + right), k) for k, (left, right) in enumerate(cuts))
            found.append((-score, -a, " ".join(p).encode(), *cuts[k]))
        for rank, (score, a, name, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, name.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found_in(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["É", "ß.", "a,b", "THE", "the", "日本", "x y", "-"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(300):
        picked = dice.choices(words, weights, k=dice.randrange(0, 60))
        text = "".join(w + dice.choice([" ", " ", " ", "\t ", "\n", "; "]) for w in picked)
        out.append((dice.choice(["en", "en", "de", None]), text))
    return out + [("en", None), ("fr", ""), (None, " \t\n")] + [("en", "New York City is big. " * 40)] * 2 + [("de", "a b c d e " * 5000)]


@pytest.mark.parametrize("min_count,max_words,top", [(5, 4, 2000), (3, 5, 20), (30, 2, 7)])
def test_against_dictionaries(spark, rows, min_count, max_words, top):
    docs = spark.createDataFrame([(None, lang, text, 1) for lang, text in rows], "doc_id long, lang string, text string, `Phrase` int")
    found = phrases.collocations(docs, min_count=min_count, max_words=max_words, top=top)
    assert found_in(found) == brute(rows, min_count, max_words, top)


def test_small_chunks_and_filters_give_the_same(spark, rows, monkeypatch):
    for name, value in (("CHUNK_BYTES", 500), ("TILE", 4), ("DENSE_SIDE", 2), ("CELLS_A_PAIR", 1), ("OUT_ROWS", 7)):
        monkeypatch.setattr(phrases, name, value)
    lang, text = [r[0] for r in rows], [r[1] for r in rows]
    import pyarrow as pa

    langs = ["und" if x is None else x for x in lang]
    batches = [pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(text, pa.string())], names=["lang", "text"])]
    chunks = [r for b in phrases.word_chunks(iter(batches)) for r in b.to_pylist()]
    assert len(chunks) > 20
    everything = phrases.Bloom(np.full(1024, 2**64 - 1, np.uint64), 1 << 16)
    counts = Counter()
    for c in chunks:
        names, n = phrases.phrases_of(c["lang"], c["words"].split(b" "), np.frombuffer(c["ids"], "<i4"), [everything] * 2)
        for name, k in zip(names, n.tolist()):
            counts[c["lang"], name.decode()] += k
    want = Counter()
    for lang, piece in ((x, p) for x, t in zip(langs, text) for p in re.split(r"[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER))):
        words = re.findall(r"[^\x20\x09]+", piece)
        for i in range(len(words) - 2):
            want[lang, " ".join(words[i : i + 3])] += 1
    assert counts == want


def test_pairs_by_tiles():
    dice = np.random.default_rng(1)
    left = (dice.pareto(0.5, 400_000) * 20).astype(np.int64) % 90_000
    right = (dice.pareto(0.5, 400_000) * 20).astype(np.int64) % 90_000
    a, b, counts, inverse = phrases.count_pairs(left, right, 90_000)
    assert (a[inverse] == left).all() and (b[inverse] == right).all()
    assert (np.bincount(inverse, minlength=len(a)) == counts).all()
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)


def test_filter_agrees_with_spark(spark):
    names = [f"größe {i} of" for i in range(5000)]
    counts = spark.createDataFrame([("de", x) for x in names], "lang string, phrase string")
    bloom = phrases.bloom_of(counts)
    assert bloom.holds("de", [x.encode() for x in names]).all()
    others = bloom.holds("de", [f"other {i}".encode() for i in range(5000)]).mean()
    assert others < 0.05 and bloom.holds("en", [x.encode() for x in names]).mean() < 0.05


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(docs.withColumn("x", F.lit(1))).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_a_chunk_is_of_one_language(monkeypatch):
    """Texts of languages in turn fill one chunk each, and what is held together is bounded."""
    import pyarrow as pa

    texts = ["a b " * 25 for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"] * 20), pa.array(texts)], names=["lang", "text"])
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 1000)
    found = [(c.column("lang")[0].as_py(), c.column("n")[0].as_py()) for c in phrases.word_chunks(iter([batch]))]
    assert found == [("x", 500), ("y", 500)] * 2
    monkeypatch.setattr(phrases, "HELD_BYTES", 400)
    assert sum(c.column("n")[0].as_py() for c in phrases.word_chunks(iter([batch]))) == 2000


def test_a_language_may_hold_a_line_end(spark):
    docs = spark.createDataFrame([("a b a b", "x\ny")] * 20 + [("a b", "x")] * 30, "text string, lang string")
    found = {(r["lang"], r["phrase"], r["a"], r["n"]) for r in phrases.collocations(docs, min_count=30).collect()}
    assert ("x\ny", "a b", 40, 80) in found and ("x", "a b", 30, 60) in found


def test_hashes_of_phrases_need_no_text(spark):
    """What a chunk extends word by word is what Spark hashes, and passes its filter."""
    words = [f"größe{i}".encode() for i in range(50)]
    dice = np.random.default_rng(5)
    parts = [dice.integers(0, 50, 2000) for _ in range(3)]
    of_word = phrases.word_hashes("de", words)
    hashes = np.zeros(2000, np.uint64)
    for part in parts:
        hashes = phrases.extended(hashes, of_word[part])
    names = [b" ".join(words[i] for i in p).decode() for p in zip(*[x.tolist() for x in parts])]
    counts = spark.createDataFrame([("de", x) for x in names], "lang string, phrase string")
    found = dict(counts.select("phrase", F.expr(phrases.PHRASE_HASH)).collect())
    assert [found[x] % 2**64 for x in names] == hashes.tolist()
    assert phrases.bloom_of(counts).holds_hashes(hashes).all()
    ids = np.concatenate([[*p, -1] for p in zip(*parts)]).astype(np.int32)
    everything = phrases.Bloom(np.full(1024, 2**64 - 1, np.uint64), 1 << 16)
    counted, n = phrases.counted_phrases("de", words, ids, [everything] * 2)
    assert sorted(zip(*[p.tolist() for p in counted], n.tolist())) == sorted((*k, v) for k, v in Counter(zip(*[p.tolist() for p in parts])).items())
