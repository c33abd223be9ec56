from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup as ed


def brute(rows, similarity=ed.SIMILARITY):
    good = [i for i, (key, v, label) in enumerate(rows)
            if key is not None and label is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups: dict = {}
    for i in good:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for held in groups.values():
        x = np.array([rows[i][1] for i in held], float)
        norm = np.sqrt((x * x).sum(axis=1))
        cosine = x @ x.T / norm[:, None] / norm
        for a, b in np.argwhere(cosine >= similarity):
            if a < b:
                links[held[a]] += 1
                links[held[b]] += 1
                p, q = find(held[a]), find(held[b])
                root[max(p, q)] = min(p, q)
    least: dict = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    out = []
    for i, (key, _, _) in enumerate(rows):
        component = least.get(find(i)) if key is not None else None
        out.append((key, links[i], component, key == component))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {"id": F.lit("x"), "hash": F.lit(1), "vector": F.lit(2), "n_links": F.lit(3), "component": F.lit(4)})
    return sorted([tuple(r) for r in ed.vector_links(df, "vec_id", "embedding", "label").collect()], key=repr)


def clusters(n, dim, spread, labels=2, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    return [(i, (centres[rng.integers(8)] + spread * rng.standard_normal(dim)).astype(np.float32).tolist(),
             int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("dim", "spread"), [(8, 0.08), (64, 0.1), (64, 0.15)])
def test_agrees_with_brute_force(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(ed, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ed, "SHARD_ROWS", 3000)
    rows = clusters(500, dim, spread)
    got, want = found(spark, rows), brute(rows)
    assert got == want
    assert sum(r[1] for r in want) > 0


def test_awkward_rows(spark):
    rows = clusters(80, 8, 0.08)
    same = rows[0][1]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, None] * 4, 0), (1003, [float("nan")] * 8, 0),
             (1004, [float("inf")] * 8, 0), (1005, same, None), (1006, same, rows[0][2]), (1007, same, rows[0][2]),
             (1008, [1.0, 2.0], 1), (1009, [2.0, 4.0], 1), (1010, [], 1), (0, same, rows[0][2])]
    assert found(spark, rows) == brute(rows)
    got = found(spark, [(None, same, 1), (1, same, 1)])
    assert got == [(1, 0, 1, True), (None, 0, None, True)]
    assert found(spark, []) == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes = ed.Codes(unit)
    i, j = np.triu_indices(400, 1)
    cosine = (unit[i] * unit[j]).sum(axis=1)
    estimate = (codes.signs[i] * codes.rotated[j]).sum(axis=1) / codes.factor[i]
    assert abs((estimate - cosine).mean()) < 2e-3
    assert (codes.upper(i, j) >= cosine).mean() > 0.9999


def test_tables_follow_the_recall():
    for rows in (10, 10_000, 10**9):
        bits, tables = ed.table_plan(rows, 0.98)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - agree) ** tables <= ed.MISSED
