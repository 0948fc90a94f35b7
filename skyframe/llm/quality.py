"""Quality of documents by hashed word n-grams and logistic regression.

A text is cut into words and runs of marks; one that repeats the one before is replaced by
one sign. Single ones and pairs are hashed into 2^18 places; a text is the share of each
place. The model is trained by follow the regularised
leader (per-place step sizes, L1 and L2) on a bounded sample of labelled documents, and a
score is one sparse dot product.

The sample: at most ``SAMPLE`` labelled documents (chosen by a hash of their id, so that
every size of input gives a sample of the whole), the only cap here. Every document is
scored on its whole text. Rows whose id falls in the held-out fold never train.

Defined results: a null or empty text has no places and gets the score of the intercept.
A document with several labels takes the smallest; null labels and ids do not train. With
no labelled document every score is 0.5. Input columns named like an output column are
replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import fields_of, small_batches
from skyframe.session import materialize

BITS = 18
SAMPLE = 8192
FOLDS = 5
#: Scores at or above it are good. It is low, as most documents are good and a good
#: document lost costs more than a bad one kept.
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens whose hashes a worker holds.
MAX_TOKENS = 200_000
#: Stands for a word that repeats the one before, whichever it is.
SAME = np.uint64(0xD1B54A32D192ED03)
SCALE = 16.0
PASSES = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1


class TokenHashes(dict):
    def __missing__(self, token: str) -> bytes:
        from xxhash import xxh64_digest

        if len(self) >= MAX_TOKENS:
            self.clear()
        value = xxh64_digest(token)
        self[token] = value
        return value


@lru_cache(maxsize=1)
def token_hashes() -> TokenHashes:
    return TokenHashes()


def places(text: str) -> np.ndarray:
    """The place of every word and every pair of words, with repeats."""
    words = np.frombuffer(b"".join(map(token_hashes().__getitem__, TOKEN.findall(text.lower()))), "<u8")
    hashes = words.copy()
    hashes[1:][words[1:] == words[:-1]] = SAME
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(31)
    both = np.concatenate([hashes, pairs * np.uint64(0xBF58476D1CE4E5B9)])
    return (both >> np.uint64(64 - BITS)).astype(np.int64)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Leader:
    """Logistic regression by follow the regularised leader, place by place."""

    def __init__(self) -> None:
        size = (1 << BITS) + 1  # the last place is the intercept, which is not regularised
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (sigmoid(float(w @ x)) - label) * x
        squares = gradient * gradient
        rate = (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += gradient - rate * w
        self.n[at] += squares


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-np.clip(x, -40, 40))))


def example(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = places(text)
    at, counts = np.unique(found, return_counts=True)
    x = counts * (SCALE / max(len(found), 1))
    return np.append(at, 1 << BITS).astype(np.int32), np.append(x, 1.0).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights (2^BITS places and the intercept) from a sample of labelled documents.

    Places are computed where the documents are; one task, holding at most ``sample``
    sparse rows, then learns them in the order of a hash.
    """
    small_batches(docs.sparkSession)
    one = labels.select(F.col(id_column).cast("long").alias("_id"), F.col(label_column).cast("int").alias("_y"))
    one = one.filter("_id IS NOT NULL AND _y IS NOT NULL").filter(~held_out("_id"))
    one = materialize(one.groupBy("_id").agg(F.min("_y").alias("_y")), "labels")
    known = one.count()
    luck = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = one.filter(luck < sample / max(known, 1)).orderBy(F.xxhash64("_id")).limit(sample)
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(text_column, F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(materialize(chosen, "chosen")), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # repeated ids teach once

    def examples(batches):
        for batch in batches:
            found = [example(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("_y"),
                    pa.array([a.tobytes() for a, _ in found], pa.binary()),
                    pa.array([x.tobytes() for _, x in found], pa.binary()),
                ],
                names=["id", "y", "at", "x"],
            )

    def learn(batches):
        leader, held = Leader(), []
        for batch in batches:
            held += list(zip(batch.column("y").to_pylist(), batch.column("at").to_pylist(), batch.column("x").to_pylist()))
        for _ in range(PASSES):
            for y, at, x in held:
                leader.learn(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32).astype(float), float(y > 0))
        weights = leader.weights(np.arange((1 << BITS) + 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    sparse = rows.mapInArrow(examples, "id long, y int, at binary, x binary")
    model = sparse.repartition(1).sortWithinPartitions(F.xxhash64("id")).mapInArrow(learn, "weights binary").first()
    return np.frombuffer(model["weights"], np.float32) if model else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # one megabyte, whatever the input
    kept = [c for c in docs.columns if c.lower() != "score"]

    def run(batches):
        w = sent.value.astype(np.float64)
        for batch in batches:
            out = []
            for text in batch.column(text_column).to_pylist():
                found = places(text or "")
                out.append(sigmoid(w[-1] + SCALE * w[found].mean() if len(found) else w[-1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.float64())], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(run, f"{fields_of(docs, *kept)}, score double")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    return score(docs, train(docs, labels)).filter(F.col("score") >= threshold).select(*docs.columns)
