"""Mixing: targets by hand, words taken, and the curriculum's order."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyframe.llm import mixing


def fill(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        unit = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if unit * weight[n] >= cap * sizes[n]}
        if not full:
            target |= {n: unit * weight[n] for n in open_}
            break
        target |= {n: cap * sizes[n] for n in full}
        left -= sum(target[n] for n in full)
        open_ -= full
    return target


def words(text):
    return len((text or "").encode().split())


def check(rows, found):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    target, taken = fill(sizes), Counter()
    assert len(found) == len(rows)
    for r in found:
        assert r["size"] == words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 0.5


def test_targets_are_met(spark, documents):
    rows = [(i, "w " * (i * 7 % 40), "big" if i % 3 == 0 else f"s{i % 11}") for i in range(900)] + [(1000, "a b", None), (1001, "ä", "é")]
    check(rows, mixing.mix(documents(rows)).collect())


def test_odd_rows_and_reruns(spark, documents, odd_rows):
    docs = documents(odd_rows)
    check(odd_rows, mixing.mix(docs).collect())
    runs = [sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]


def test_empty_table_and_clashing_names(spark, documents):
    assert mixing.mix(documents([])).collect() == []
    docs = documents([(1, "a b c", "s")]).selectExpr("*", "'x' AS target", "7 AS SIZE", "8 AS taken")
    (row,) = mixing.mix(docs).collect()
    assert (row["size"], row["target"], row["taken"]) == (3, 4.5, 5)


def test_time_inverts_the_integral(spark):
    for schedule in ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5), (1.0, 3.0, 0.5), (0.0, 2.0)):
        steps = len(schedule) - 1
        plan = F.array(*map(F.lit, schedule))
        rows = spark.range(0, 101).select((F.col("id") / 100.0).alias("x")).select("x", mixing.time_of(F.col("x"), plan, steps).alias("t"))
        whole = sum((a + b) / 2 / steps for a, b in zip(schedule, schedule[1:]))
        for r in rows.collect():
            area, t = 0.0, r["t"]
            for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
                part = min(max(t * steps - i, 0.0), 1.0)
                area += (a * part + (b - a) * part * part / 2) / steps
            assert area / whole == pytest.approx(r["x"], abs=1e-9)


def test_training_order_is_sorted_and_repeats(spark, documents):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(300)]
    docs = documents(rows)
    expected = Counter({r["doc_id"]: len(r["takes"]) for r in mixing.schedule_takes(docs).collect() if r["takes"]})
    ordered = mixing.training_order(docs)
    assert ordered.columns == docs.columns
    assert Counter(r["doc_id"] for r in ordered.collect()) == expected
    positions = [r["first_position"] for r in mixing.mix(docs).collect() if r["first_position"] is not None]
    assert positions == sorted(positions)


def test_main_path_has_no_python(spark, documents):
    plan = mixing.mix(documents([(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
