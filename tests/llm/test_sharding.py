"""Sharding: near equal bytes, gapless slots, groups of copies cut only when too large."""

from collections import Counter, defaultdict

import pytest

from skyframe.llm import sharding


def check(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal(spark, documents):
    rows = [(i, "x" * (i * 37 % 301), "s") for i in range(4000)]
    found = sharding.shard_records(documents(rows)).collect()
    check(found, 8)
    total = Counter()
    for r in found:
        total[r["shard"]] += len(r["text"]) + 1
    mean = sum(total.values()) / 8
    assert all(abs(t - mean) < 0.02 * mean for t in total.values())
    assert sorted(r["doc_id"] for r in found) == list(range(4000))


def test_a_third_of_copies_is_cut_by_id(spark, documents):
    rows = [(i, "the same text" if i % 3 == 0 else f"text number {i}", "s") for i in range(6000)]
    found = sharding.shard_records(documents(rows)).collect()
    check(found, 8)
    total = Counter()
    for r in found:
        total[r["shard"]] += len(r["text"]) + 1
    mean = sum(total.values()) / 8
    assert all(abs(t - mean) < 0.03 * mean for t in total.values())


def test_small_groups_of_equal_texts_stay_together(spark, documents):
    rows = [(i, f"text {i // 3}", "s") for i in range(6000)]
    where = defaultdict(set)
    for r in sharding.shard_records(documents(rows)).collect():
        where[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_odd_rows_and_reruns(spark, documents, odd_rows):
    docs = documents(odd_rows)
    found = sorted(map(str, sharding.shard_records(docs).collect()))
    assert len(found) == len(odd_rows)
    check(sharding.shard_records(docs).collect(), 8)
    assert found == sorted(map(str, sharding.shard_records(docs.repartition(5)).collect()))


def test_empty_table_and_clashing_names(spark, documents):
    assert sharding.shard_records(documents([])).collect() == []
    docs = documents([(1, "a", "s"), (2, "b", "s")]).selectExpr("*", "'x' AS shard", "'y' AS SLOT", "0 AS size")
    found = sharding.shard_records(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot"]
    check(found.collect(), 8)


def test_written_shards_hold_their_rows(spark, documents, tmp_path):
    docs = documents([(i, f"t{i}", "s") for i in range(50)])
    sharding.write_shards(sharding.shard_records(docs), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 50


def test_splitters_place_like_a_sorted_list():
    np = pytest.importorskip("numpy")
    splitters = sharding.Splitters([(5, 0), (5, 10), (9, -(1 << 63))])
    hashes = np.array([4, 5, 5, 5, 8, 9, 10])
    ids = np.array([0, -1, 0, 10, 7, 0, 0])
    assert splitters.place(hashes, ids).tolist() == [0, 0, 1, 2, 2, 3, 3]
