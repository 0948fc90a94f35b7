"""Encoding and decoding, and token shards, against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from skyframe.llm import bpe, token_output  # noqa: E402
from skyframe.llm.wordbpe import WordBpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def reference(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", "  ", "İstanbul ſ K", "á b", "'S don't it'll", "x<|endoftext|>y <|startoftext|>", "a\tb c d", "日本語 텍스트", "ŉ Ĳ ß ẞ",
    "\x1c\x1d a\x0bb", "ΑΣ ΑΣΑ", "½²³ ª", "🙂🙂 a", "ẹ́ ́x", " <|endof text|>", "''s!'s", "can''t've", "ŀL·l", "­ x",
    "".join(map(chr, range(0x20, 0x250))),
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_pieces_equal_the_library(name):
    path = public_tokenizers.path(name)
    own, lib = WordBpe(path), Tokenizer.from_file(path)
    for text in [*ODD, "The CAT sat. On the mat, it's!\n" * 5]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_the_cache_starts_anew_at_its_bound(monkeypatch, library):
    monkeypatch.setattr("skyframe.llm.wordbpe.MAX_PIECES", 10)
    own = WordBpe(PATH)
    text = " ".join(f"w{chr(97 + i % 26)}{'x' * (i % 9)}" for i in range(500))
    assert own.encode(text).tolist() == reference(library, text)
    assert len(own.pieces) <= 10


def test_chunks_follow_content():
    rng = random.Random(1)
    shared = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) + str(rng.randrange(99)) for _ in range(4000)).encode()
    one, two = b"one begin " + shared, b"quite another beginning of it " + shared
    assert b"".join(bpe.chunks(one)) == one and b"".join(bpe.chunks(two)) == two
    assert len(set(bpe.chunks(one)) & set(bpe.chunks(two))) > 0.8 * len(bpe.chunks(one))
    for c in bpe.chunks(("é" * 40_000).encode()):
        c.decode()
        assert len(c) <= bpe.MAX_CHUNK


def passages(seed, count):
    rng = random.Random(seed)
    words = ["Alpha", "beta's", "gamma,", "it'll", "Ωmega", "x", "délta-9", "12", "\n", "é!"]
    return [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(600)) for _ in range(count)]


def test_documents_with_shared_passages(spark, documents, library, odd_rows):
    rng, shared = random.Random(2), passages(3, 4)
    texts = [" ".join(rng.choices(shared, k=3)) + f" own end {i}" for i in range(60)] + ["x" * 20_000 + shared[0] + "y" * 300] * 3 + ODD
    rows = [(i, t, "s") for i, t in enumerate(texts)] + odd_rows
    docs = documents(rows).selectExpr("*", "'old' AS ids")
    assert bpe.reused_chunks(docs, "text").count() > 5
    for budget in (bpe.REUSED_BYTES, 2000, 0):
        found = bpe.encode_documents(docs, PATH, decoded=True, max_bytes=budget).collect()
        assert len(found) == len(rows)
        for r in found:
            ids = reference(library, r["text"])
            assert r["ids"] == ids
            assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_no_documents(spark, documents):
    assert bpe.encode_documents(documents([]), PATH).collect() == []


def test_compression_is_exact_and_random_access():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 20_000):
        ids = rng.integers(0, 6, n)
        ends = np.unique(np.append(rng.integers(1, n + 1, 1 + n // 40), n))
        rules, expansions, symbols, places = token_output.compress(ids, ends)
        first = int(ids.max()) + 1
        assert (token_output.expand(symbols, rules, expansions, first) == ids).all()
        assert n < 1000 or len(symbols) < 0.7 * n
        edges = np.append(places, len(symbols))
        for a, b, p, q in zip(np.append(0, ends), ends, edges, edges[1:]):
            assert (token_output.expand(symbols[p:q], rules, expansions, first) == ids[a:b]).all()


def test_runs_of_one_pair():
    ids = np.full(1001, 7)
    rules, expansions, symbols, _ = token_output.compress(ids, np.array([1001]))
    assert (token_output.expand(symbols, rules, expansions, 8) == ids).all() and len(symbols) < 50


def test_shards_give_the_documents_back(spark, documents, library, odd_rows, tmp_path, monkeypatch):
    rows = [(i, f"{t} {i}", "s") for i, t in enumerate(passages(7, 40), start=100)] + odd_rows
    token_output.write_token_shards(documents(rows), f"{tmp_path}/t", PATH)
    found = sorted(token_output.read_token_shards(spark, f"{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert len(found) == len(rows)
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    texts = sorted(hashlib.md5(np.array([*reference(library, t), 1], "<u4").tobytes()).hexdigest() for _, t, _ in rows)
    assert texts == sorted(hashlib.md5(r["ids"]).hexdigest() for r in found)
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    shard = spark.read.parquet(f"{tmp_path}/t").first().asDict()
    whole = np.concatenate([token_output.decode_document(shard, i) for i in range(len(shard["sizes"]) // 4)])
    assert len(whole) == shard["total"]


def test_no_shards(spark, documents, tmp_path):
    token_output.write_token_shards(documents([]), f"{tmp_path}/t", PATH)
    assert token_output.read_token_shards(spark, f"{tmp_path}/t").collect() == []
