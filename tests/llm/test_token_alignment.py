"""Alignment of two tokenizers against byte ranges of every pair of tokens."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyframe.llm import token_alignment
from skyframe.llm.queries import op12_token_alignment, tokenizer_path


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def tokens(two, text):
    """Ids and bytes of A and B, by the libraries one text at a time."""
    a = two.a.encode(" " + text, add_special_tokens=False).ids
    b = two.b.encode(text)
    from tokenizers.pre_tokenizers import ByteLevel

    assert len(ByteLevel.alphabet()) == 256
    bytes_b = [bytes([int(p[3:5], 16)]) if two.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, two.b.id_to_piece(i)) for i in b)]
    return a, [two.bytes_a[i] for i in a], b, bytes_b


def brute(two, texts):
    documents, held, groups = [], defaultdict(int), []
    for text in texts:
        a, bytes_a, b, bytes_b = tokens(two, text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            documents.append(None)
            continue
        ranges = []
        for parts in (bytes_a, bytes_b):
            at, found = 0, []
            for p in parts:
                found.append((at, at + len(p)))
                at += len(p)
            ranges.append(found)
        links = Counter((x, y) for x, (s, e) in zip(a, ranges[0]) for y, (t, f) in zip(b, ranges[1]) if s < f and t < e)
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        cut, low = [], 0
        for end in ends:
            left = [x for x, (s, e) in zip(a, ranges[0]) if low < e <= end]
            right = [x for x, (s, e) in zip(b, ranges[1]) if low < e <= end]
            cut.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            low = end
        for pair in links:
            held[pair] += 1
        documents.append((len(a), len(b), ends, links, ";".join(cut)))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d in documents:
        if d is None:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        n_a, n_b, ends, links, cut = d
        best = sum(k for (x, y), k in links.items() if held[x, y] == most[x])
        out.append((n_a, n_b, len(ends), sum(links.values()), cut, best, sum(k * held[p] for p, k in links.items())))
    return out


TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "The quick brown fox jumps over the lazy dog.",
    "  two  spaces,\ttabs\nand lines \n\n",
    "naïve Ärger 日本語のテキスト 🙂🙂 ́",
    "▁ a piece mark in the text",
    "<|endoftext|> <s> </s> <unk> <0x41> are plain",
    "x" * 400,
    "12345678901234567890 a_b-c(d) don't",
    None,
    "",
    " ",
    "\x00\x01 control",
    "quick lazy dogs jumping over foxes " * 20,
]


@pytest.mark.parametrize("hot", [1 << 19, 40, 1])
def test_against_ranges(spark, paths, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(token_alignment, "BATCH_BYTES", 60)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, `Pairs` int")
    found = token_alignment.align_documents(docs, *paths)
    weighed = token_alignment.weigh_links(found, *paths)
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    got = [tuple(r) for r in weighed.orderBy("id").select(*columns).collect()]
    want = brute(token_alignment.two_tokenizers(*paths), TEXTS)
    assert got == want
    assert all(a + b - g == n for a, b, g, n, *_ in got)


def test_given_documents_and_forgetting(spark, paths, tmp_path, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()[:40]
    two = token_alignment.two_tokenizers(*paths)
    runs = []
    for tokens_held, in_parts in ((10, True), (10**9, True), (10**9, False)):
        monkeypatch.setattr(token_alignment, "MEMO_TOKENS", tokens_held)
        monkeypatch.setattr(two, "in_parts", in_parts)
        aligner = token_alignment.Aligner(two)
        runs.append([aligner.documents([r["text"] or ""])[0] for r in rows])
    assert runs[2] == runs[1]
    assert runs[0] == runs[1]
    short = [r["text"] for r in rows if len(r["text"] or "") < 3000]
    want = {t: w for t, w in zip(short, brute(two, short))}
    for r, got in zip(rows, runs[0]):
        if r["text"] in want:
            assert got[:5] == want[r["text"]][:5]


def test_parts_give_the_ids_of_whole_texts(spark, paths):
    """Against the libraries on whole texts: the given documents, and random strings of
    characters that tokenizers treat in their own ways."""
    two = token_alignment.two_tokenizers(*paths)
    assert two.in_parts
    dice = random.Random(11)
    odd = list("ab1'.,-_ \u00a0\t\n\u0085\u2003\u180e\u200b\u2581\u0301ÉßЖ日🙂<>s") + [" ", " ", " ", "'s", "don't", "0x41", "  "]
    texts = ["".join(dice.choices(odd, k=dice.randrange(1, 30))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"]]
    assert two.quick is not None
    plain = list("abZ19'.,-_()\t\n \u00a0ÉßñžÿĳŒ") + [" ", " ", "'s", "'ll", "don't", "  "]
    texts += ["".join(dice.choices(plain, k=dice.randrange(1, 40))) for _ in range(3000)]
    for text, (a, b) in zip(texts, two.encode(texts)):
        assert a == two.a.encode(" " + text, add_special_tokens=False).ids
        assert b == two.b.encode(text)
    aligner = token_alignment.Aligner(two)
    for text, (n_a, n_b, _, _, groups, _, _) in zip(texts, aligner.documents(texts)):
        [(a, b)] = two.encode([text])
        if two.same_bytes(text, a, b):
            ids = [[int(x) for g in groups.split(";") for x in g.split("|")[side].split(",")] for side in (0, 1)]
            assert ids == [a, b] and (n_a, n_b) == (len(a), len(b))
        else:
            assert n_a == 0 and groups == ""


def test_query_and_empty_table(spark, tmp_path, odd_rows, documents):
    documents(odd_rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_token_alignment(spark, str(tmp_path)).collect()
    assert len(found) == len(odd_rows)
    assert all((r["groups_sha256"] == "") == (r["n_a"] == 0) for r in found)
    assert sum(r["n_a"] == 0 for r in found) == 3
    documents([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_token_alignment(spark, f"{tmp_path}/none").filter(F.col("n_a") >= 0).collect() == []
