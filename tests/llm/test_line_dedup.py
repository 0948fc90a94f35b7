"""Line dedup against a count by dictionaries."""

import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyframe.llm import line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(texts, min_docs):
    split = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(line_dedup.WHITE).translate(LOWER) for x in lines] for lines in split]
    counts = Counter(k for ks in keys for k in set(ks))
    out = []
    for lines, ks in zip(split, keys):
        kept = [x for x, k in zip(lines, ks) if not (k and counts[k] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(rows, docs, **named):
    found = line_dedup.drop_common_lines(docs, **named)
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect())
    want = brute([t for _, t, _ in rows], named.get("min_docs", line_dedup.MIN_DOCS))
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, want))
    return found


@pytest.fixture(scope="module")
def shared():
    rows = []
    for i in range(60):
        lines = [f"only {i}", "Everyone has This ", "\x0b everyone has THIS", "", " \t", f"by {i % 7} all", f"by {i % 4} ALL", "Ärger  "]
        rows.append((i, "\n".join(lines[: 3 + i % 6] + [f"by {i % 3} x"] * (i % 4)), "s"))
    return rows


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (5, 2), (4, 3)])
def test_any_batches(documents, shared, batches, fan_out):
    check(shared, documents(shared), batches=batches, fan_out=fan_out)


def test_odd_rows(documents, odd_rows):
    rows = odd_rows + [(20, "a\r\nb\n\na", "s"), (21, "\n" * 2000 + "a", "s")] + [(22, "x y" * 30000 + " \n" + "z\n" * 5000, "s")] * 3
    check(rows, documents(rows), min_docs=3, batches=2)


def test_empty_table(documents):
    assert line_dedup.drop_common_lines(documents([])).collect() == []


def test_extra_columns(spark, documents, shared):
    docs = documents(shared)
    for name in ("i1", "H1", "at", "batch", "input", "Lines", "dropped", "first", "keys", "a b.c"):
        docs = docs.withColumn(name, F.create_map(F.lit("k"), F.col("doc_id")))
    docs = docs.withColumn("Kept", F.lit(7))
    found = check(shared, docs)
    assert [c for c in found.columns if c not in ("n_lines", "n_dropped", "kept")] == [c for c in docs.columns if c != "Kept"]
    assert found.select("`a b.c`", "doc_id").first()[0] is not None


def test_native_and_runs_meet_without_exchange(spark, documents, shared):
    plan = line_dedup.drop_common_lines(documents(shared))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    runs = line_dedup.LineRuns(spark, "runs_of_test", min_docs=2)
    for _ in range(2):
        runs.add(spark.range(100).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).alias("n_docs")))
    counts = spark.range(5).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("n_docs"))
    one = runs.unsettled(counts.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")))
    assert one.collect() == []
    assert one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    again = line_dedup.LineRuns(spark, "runs_of_test", min_docs=2)
    assert again.levels == runs.levels
    assert again.settled().count() == 100
    for level in again.levels.values():
        again._drop(level)
