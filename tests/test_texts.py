"""Bounded texts: what reaches Python, and that it does not change the result."""

import pandas as pd
from pyspark.sql import functions as F

from skyframe.functions import text
from skyframe.workload.registry import load


def test_ascii_stays_out_of_python_and_batches_are_small(spark, work, monkeypatch):
    def told():
        @F.pandas_udf("string")
        def size(texts: pd.Series) -> pd.Series:
            return texts.where(texts.isna(), f"{len(texts)}")

        return size

    rows = [(i, "plain" if i % 2 else "größe", "en", "s", 5) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{work}/documents.parquet")
    monkeypatch.setattr(text, "nfkc", told)
    found = {r["doc_id"] % 2: r["bounded"] for r in load()["bounded_texts"].run(spark, work).collect()}
    assert found[1] == "plain" and int(found[0]) <= 256


def test_bounded_text(spark):
    given = ["ﬁne  ①", "a\tb\x00c ", "é x", " \n", "", None, "x" * 300, "é" * 300]
    df = spark.createDataFrame([(g,) for g in given], "t string").coalesce(1)
    found = [r[0] for r in df.select(text.bounded_text(F.col("t"), 255)).collect()]
    assert found == ["fine 1", "abc", "é x", None, None, None, "x" * 255, "é" * 255]
