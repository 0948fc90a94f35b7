"""The pipeline: stages against brute force, columns, and its registration."""

import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skyframe.llm import quality, secrets
from skyframe.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", q)[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "secret_scans", "source_mixing", "bpe_encoding",
    ]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and gave."""
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        seen.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return seen


def test_stages_keep_the_columns_of_documents(stages):
    assert all(columns == COLUMNS for _, _, columns in stages[:-1])
    assert stages[-1][2] == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]


def test_quality_rejects_by_score(spark, stages):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = quality.score(docs, quality.train(docs, labels)).collect()
    assert {r["doc_id"] for r in stages[0][1]} == {r["doc_id"] for r in scores if r["score"] >= quality.THRESHOLD}


def test_one_document_of_each_group_stays(stages):
    from test_simhash import fingerprint, groups

    before, after, _ = stages[1]
    before = sorted(before, key=lambda r: r["doc_id"])
    root = groups([fingerprint(r["text"]) for r in before])
    first = {}
    for r, g in zip(before, root):
        first.setdefault(g, r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())


def test_secrets_are_masked(stages):
    before, after, _ = stages[2]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(before) == len(after)
    for r in after:
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not secrets.base_spans(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]] or "[SECRET]" in r["text"]


def test_sources_near_their_targets(stages):
    from test_mixing import fill, words

    before, after, _ = stages[3]
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += words(r["text"])
        longest[r["source"]] = max(longest[r["source"]], words(r["text"]))
    for r in after:
        taken[r["source"]] += words(r["text"])
    for source, target in fill(sizes).items():
        assert target - 1 <= taken[source] <= target + longest[source] + 1
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_ids_are_the_library_s(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    before, after, _ = stages[4]
    wanted = Counter(tuple(library.encode(r["text"], add_special_tokens=False).ids) for r in before)
    assert wanted == Counter(tuple(r["ids"]) for r in after)


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
    assert docs.count() == 0
