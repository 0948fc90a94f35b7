"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from skyframe.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """[(n_links, component)] per row, by all pairs."""
    usable = [v is not None and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    links = [set() for _ in rows]
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and usable[i] and usable[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = E.near_duplicate_vectors(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str)


def clusters(seed, count, size, dim, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(count):
        centre = rng.standard_normal(dim)
        rows += [centre + noise * rng.standard_normal(dim) for _ in range(size)]
    rows += list(rng.standard_normal((60, dim)))
    return [(i, np.float32(v).tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("noise", [0.1, 0.32])
def test_equals_all_pairs(spark, noise):
    rows = clusters(3, 8, 12, 64, noise)
    assert found(spark, rows) == brute(rows)


def test_equals_all_pairs_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL_BYTES", 8 * 16 * 20)
    rows = clusters(4, 3, 50, 16, 0.3)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    same = [1.0, 2.0, 3.0, 0.5]
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, same), (2, same), (2, same), (3, [2.0, 4.0, 6.0, 1.0]), (None, same), (4, [0.0] * 4), (5, [0.0] * 4), (6, None), (7, []),
        (8, [1.0, nan, 0.0, 0.0]), (9, [1.0, inf, 0.0, 0.0]), (10, [1.0, None, 0.0, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0, 2.0, 3.0]),
        (None, None), (13, [1e30, 0.0, 0.0, 0.0]), (14, [1e-30, 0.0, 0.0, 0.0]), (15, [5.0]), (16, [7.0]), (17, [-7.0]),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_pigeonhole_shares_cover_the_whole():
    for dim in (1, 5, 64):
        assert E.budgets(dim, 0.9).sum() >= 0.2
        assert E.block_edges(dim)[-1][1] == dim
