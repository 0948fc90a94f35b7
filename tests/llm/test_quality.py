"""Quality: held-out accuracy, odd rows, no leak of labels."""

import os
import random
from zlib import crc32

import numpy as np
import pytest

from skyframe.llm import quality

FOLDER = "/root/testdata/sf0.01"


def corpus(documents, spark, count=600):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "and", "of", "word", "other", "thing"]) + "." * (rng.random() < 0.1) for _ in range(80))
    bad = lambda: " | ".join(rng.choice(["the", "and", "of", "word"]) for _ in range(60))
    rows = [(i, bad() if i % 6 == 0 else good(), "s") for i in range(count)]
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(count)], "doc_id long, quality int, toxic int")
    return documents(rows), labels


def test_held_out_accuracy(spark, documents):
    docs, labels = corpus(documents, spark)
    found = quality.score(docs, quality.train(docs, labels)).select("doc_id", "score", quality.held_out().alias("held")).collect()
    held = [r for r in found if r["held"]]
    assert all(r["held"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found) and len(held) > 80
    assert all((r["score"] >= quality.THRESHOLD) == (r["doc_id"] % 6 != 0) for r in held)


def test_held_out_labels_are_never_seen(spark, documents):
    docs, labels = corpus(documents, spark, 200)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert np.array_equal(quality.train(docs, labels), quality.train(docs, flipped))


def test_odd_rows_and_empty_tables(spark, documents, odd_rows):
    docs, labels = corpus(documents, spark, 120)
    doubled = labels.unionAll(labels).unionAll(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema))
    weights = quality.train(docs, doubled)
    assert np.array_equal(weights, quality.train(docs.unionAll(docs), labels))
    odd = documents(odd_rows).selectExpr("*", "'x' AS score")
    found = quality.score(odd, weights).collect()
    assert len(found) == len(odd_rows) and all(0.0 <= r["score"] <= 1.0 for r in found)
    empty = quality.sigmoid(float(weights[-1]))
    assert all(r["score"] == pytest.approx(empty) for r in found if not (r["text"] or "").split())
    none = quality.train(docs.limit(0), labels.limit(0))
    assert not none.any() and quality.score(odd, none).first()["score"] == 0.5
    assert quality.good_documents(docs.limit(0), labels).collect() == []


def test_the_sample_is_bounded(spark, documents):
    docs, labels = corpus(documents, spark, 300)
    assert quality.train(docs, labels, sample=40).any()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_given_labels(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter(quality.held_out())
    rows = scored.select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([s >= quality.THRESHOLD for s in good]) >= 0.98
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
