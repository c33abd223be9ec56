from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import lookup
from tidemark.plans.lookup import heavy_keys, lookup_join
from tidemark.plans.ordered import block_edges, positions, previous, range_positions, running
from tidemark.plans.quantiles import exact_quantiles, quantiles_of_counts


@pytest.fixture(scope="module")
def hot():
    """One key holds most of the rows."""
    rng = np.random.default_rng(3)
    n = 4000
    return pd.DataFrame(
        {"k": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n)),
         "t": rng.permutation(n), "v": rng.integers(-50, 50, n)}
    )


@pytest.mark.parametrize("rows_per_block", [10_000, 150])
def test_running_and_previous(spark, hot, rows_per_block):
    df = spark.createDataFrame(hot)
    edges = block_edges(df, "t", rows_per_block)
    assert (len(edges) > 10) == (rows_per_block == 150)
    out = running(df, ["k"], "t", {"s": ("sum", "v"), "m": ("max", "v")}, edges=edges)
    out = running(out, ["k"], "t", {"before": ("min", "v")}, inclusive=False, edges=edges)
    out = running(out, ["k"], "t", {"rest": ("sum", "v")}, descending=True, edges=edges)
    out = positions(out, ["k"], "t", "pos", edges=edges)
    out = previous(out, ["k"], "t", "v", "last", edges=edges)
    got = out.toPandas().sort_values("t").reset_index(drop=True)
    want = hot.sort_values("t").reset_index(drop=True)
    g = want.groupby("k").v
    assert (got.s == g.cumsum()).all() and (got.m == g.cummax()).all()
    assert (got.pos == want.groupby("k").cumcount() + 1).all()
    assert got["last"].equals(g.shift().astype("float64"))
    low = g.transform(lambda x: x.cummin().shift())
    assert got.before.equals(low.astype("float64"))
    assert (got.rest == g.transform("sum") - g.cumsum() + want.v).all()


def test_blocks_are_made_for_large_keys_only(spark, hot):
    df = spark.createDataFrame(hot)
    most = int(hot.groupby("k").size().max())
    assert block_edges(df, "t", most, keys=["k"]) == []
    assert len(block_edges(df, "t", most - 1, keys=["k"])) >= 1
    assert block_edges(df.filter("false"), "t", 1, keys=["k"]) == block_edges(df, "t", 150, at_most=100) == []


@pytest.mark.parametrize("limit", [1_000_000, 300, 20, 2])
def test_quantiles_are_exact_however_they_are_found(spark, limit):
    rng = np.random.default_rng(1)
    n = 6000
    pdf = pd.DataFrame(
        {"plain": rng.normal(size=n), "tied": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(size=n) * 10),
         "whole": rng.integers(0, 5, n).astype(float), "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.random(n))}
    )
    df = spark.createDataFrame(pdf)
    columns = {c: F.when(~F.isnan(c), F.col(c)) for c in pdf}
    shares = [Fraction(i, 10) for i in range(11)]
    counts = {c: int(pdf[c].notna().sum()) for c in pdf}
    found = exact_quantiles(df, columns, dict.fromkeys(pdf, shares), counts, limit)
    for c in pdf:
        want = np.quantile(pdf[c].dropna(), [float(s) for s in shares])
        assert np.allclose(found[c], want, rtol=1e-12, atol=1e-15)


def test_quantiles_with_infinities_and_zeros(spark):
    values = [float("-inf"), -0.0, 0.0, 0.0, 1.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = exact_quantiles(df, {"x": F.col("x")}, {"x": [Fraction(1, 2), Fraction(1)]}, {"x": 7}, 1)
    assert found["x"] == [0.0, float("inf")]


def test_quantiles_of_counts():
    counts = {1.0: 3, 2.0: 1, 10.0: 4}
    values = np.repeat(list(counts), list(counts.values()))
    shares = [Fraction(i, 7) for i in range(8)]
    want = np.quantile(values, [i / 7 for i in range(8)])
    assert np.allclose(quantiles_of_counts(counts, shares), want)


def test_lookup_join_beyond_the_broadcast_bound(spark, hot):
    facts = spark.createDataFrame(hot)
    dims = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, d int")
    for how in ("inner", "left", "left_semi"):
        near = lookup_join(facts, dims, ["k"], how, ["t"])
        far = lookup_join(facts, dims, ["k"], how, ["t"], broadcast_rows=1)
        assert sorted(map(tuple, near.collect()), key=str) == sorted(map(tuple, far.collect()), key=str)


def test_only_heavy_keys_are_repeated(spark, hot, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY_ROWS", 1_500)
    facts = spark.createDataFrame(hot).withColumn("k", F.when(F.col("t") % 10 != 0, F.col("k")))
    assert [tuple(r) for r in heavy_keys(facts, ["k"]).collect()] == [("hot",)]
    names = ["hot", "a", "z", None, *map(str, range(500))]
    dims = spark.createDataFrame([(k, i) for i, k in enumerate(names)], "k string, d int")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    # a number per salt tells how often a row of the dimension is there
    for how in ("inner", "left", "left_semi", "left_anti"):
        near = lookup_join(facts, dims, ["k"], how, ["t"])
        far = lookup_join(facts, dims, ["k"], how, ["t"], broadcast_rows=1)
        assert sorted(map(tuple, near.collect()), key=str) == sorted(map(tuple, far.collect()), key=str)
    joined = lookup_join(facts.filter("k = 'a'"), dims, ["k"], "right", ["t"], broadcast_rows=1)
    # with nothing heavy every row of the dimension is there once
    joined.select("d").mapInPandas(counted, "d int").count()
    assert seen.value == (hot.k[hot.t % 10 != 0] == "a").sum() + len(names) - 1


@pytest.mark.parametrize("rows_per_block", [10_000, 150])
def test_positions_in_an_order_of_text(spark, hot, rows_per_block):
    text = hot.assign(s=[f"{v}-{t}" for v, t in zip(hot.v, hot.t)])
    df = spark.createDataFrame(text).withColumn("k", F.when(F.col("k") != "b", F.col("k")))
    got = positions(df, ["k"], "s", "pos", rows_per_block=rows_per_block).toPandas()
    want = got.sort_values("s").groupby("k", dropna=False).cumcount() + 1
    assert len(got) == len(hot) and (got.pos == want.reindex(got.index)).all()
    every = positions(df.select("s"), [], "s", "pos", rows_per_block=rows_per_block)
    assert [r["pos"] for r in every.orderBy("s").collect()] == list(range(1, len(hot) + 1))
    ranged = range_positions(df, [F.col("s")], "at", len(hot), rows_per_block)
    assert [r["at"] for r in ranged.orderBy("s").collect()] == list(range(len(hot)))


def test_positions_of_more_rows_than_a_block_in_an_order_of_text(spark):
    df = spark.range(500_100).select((F.col("id") % 3).alias("k"), F.concat_ws("-", "id", F.lit("x")).alias("s"))
    got = positions(df, ["k"], "s", "pos").agg(F.max("pos"), F.sum("pos"), F.count("pos")).first()
    n = 166_700
    assert tuple(got) == (n, 3 * n * (n + 1) // 2, 3 * n)
