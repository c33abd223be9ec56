from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import metric_search as ms


def brute(rows, k=5):
    held = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in held:
        if i % 50 == 0:
            scores = sorted({(-sum(a * b for a, b in zip(v, w, strict=True)), j, w) for j, w in held
                             if j != i and len(w) == len(v)})
            out += [(i, rank + 1, j, -s) for rank, (s, j, _) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"id": F.lit("x"), "v": F.lit(1), "dim": F.lit(0), "query": F.lit(True)})
    usable = df.filter(ms.usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), ms.scaled(F.col("embedding")).alias("v"))
    return sorted(tuple(r) for r in ms.top_products(usable, k, F.col("id") % 50 == 0).collect())


def vectors(n, dim, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [(i, (centres[i % 6] + spread * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("rows", "pivots"), [(1024, 1024), (60, 50), (30, 20)])
def test_agrees_with_brute_force(spark, monkeypatch, rows, pivots):
    monkeypatch.setattr(ms, "TREE_ROWS", rows)
    monkeypatch.setattr(ms, "ROWS_PER_PIVOT", pivots)
    monkeypatch.setattr(ms, "PAGE", 8)
    monkeypatch.setattr(ms, "QUERY_BLOCK", 7)
    data = vectors(700, 6)
    data += [(1000 + i, data[3][1]) for i in range(40)]  # ties
    assert found(spark, data) == brute(data)


def test_awkward_rows(spark):
    data = vectors(120, 4) + [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [float("nan")] * 4),
                              (250, [float("inf")] * 4), (300, [0.0] * 4), (350, [1.0, 2.0]), (351, [2.0, 1.0]),
                              (400, []), (401, []), (450, [0.5] * 4), (50, vectors(120, 4)[50][1])]
    data.append(data[0])
    assert found(spark, data) == brute(data)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0])]) == []


def test_products_too_large_for_bounds(spark):
    rng = np.random.default_rng(3)
    data = [(i, (rng.integers(-9, 9, 3) * 1e5).astype(np.float32).tolist()) for i in range(120)]
    assert found(spark, data) == brute(data)


def test_bounds_spare_computations():
    rng = np.random.default_rng(1)
    points = np.floor(rng.standard_normal((3000, 3)) * 1000)
    largest = float((points * points).sum(axis=1).max())
    lifted = ms.lift(points, largest)
    tree = ms.build_tree(lifted, np.arange(3000), lifted[0])
    seen = []
    original = ms._distances
    ids = [[i] for i in range(3000)]

    class Counting(list):
        def __getitem__(self, i):
            seen.append(i)
            return list.__getitem__(self, i)

    def searched(rows, worst):
        queries = np.column_stack([points[rows], np.zeros(len(rows))])
        return ms.search_tree(tree, lifted[0], Counting(ids), queries, np.full(len(rows), -1), 5, largest, worst)

    def best(row):
        scores = points @ points[row]
        return sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda e: (-e[0], e[1]))[:5]

    [got] = searched([17], np.array([-np.inf]))
    assert sorted(got, key=lambda e: (-e[0], e[1])) == best(17)
    assert len(seen) < 300 and original is ms._distances
    # queries that walk together find what each finds alone; what is below ``worst`` does not count
    rows = list(range(0, 3000, 7))
    worst = np.array([-np.inf if r % 2 else best(r)[2][0] for r in rows])
    for row, least, got in zip(rows, worst, searched(rows, worst), strict=True):
        assert sorted(got, key=lambda e: (-e[0], e[1])) == [e for e in best(row) if e[0] >= least]


def test_null_ids_take_no_place(spark):
    rows = [(None, [1, 1]), *[(i, [1, 1]) for i in range(9)], (50, [1, 0])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = ms.top_products(df, 3, F.col("id") == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 2), (0, 2, 2, 2), (0, 3, 3, 2)]
