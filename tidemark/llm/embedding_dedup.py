"""Near copies among vectors of a label, by randomised-rotation binary codes.

Candidates come from tables of hashed sign bits of random rotations. Bits per
table follow the number of vectors, tables follow from the bits: a pair at the
threshold shares no table with probability below 1e-7.

Vectors that share a bucket are compared by their code: a further random
rotation, the signs of its components, and the stored correction factor
<code, vector>. The code's estimate of a cosine is unbiased, and its error is
bounded by CONFIDENCE * sqrt((1 - f^2) / f^2) / sqrt(D - 1), f the factor.
Pairs whose upper bound stays under the threshold are done; for all others the
cosine is computed in double precision, and it alone decides.

A pair is compared in the first table it shares only, so nothing is counted
twice and no pairs leave a task: a task returns the links of each vector and
the smallest vector of each group it has connected. Buckets are cut into
blocks that meet in pairs, so a large group of near copies is spread. Equal
vectors are one vector with a count.

Defined results: vectors that are null, all zero, or hold null or non-finite
components, and rows without label, link with nothing; vectors of different
length do not link. A row with a null id links with nothing and is kept. Rows
that repeat an id and a vector count as copies of it; an id that has several
vectors adds their links up. Other columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import meet_in_blocks, pairs_in_runs, written
from tidemark.llm.components import connected_components
from tidemark.llm.metric_search import usable

SIMILARITY = 0.98
#: A pair at the threshold is missed with this probability at most.
MISSED = 1e-7
#: Width of the confidence interval of an estimate.
CONFIDENCE = 5.0
BLOCK_ROWS = 1024
SHARD_ROWS = 20_000


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(rows: int, similarity: float) -> tuple[int, int]:
    """Bits per table and tables for so many vectors."""
    bits = min(30, max(8, math.ceil(math.log2(max(rows, 1))) + 3))
    agree = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log1p(-agree))


def bucket_codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One code per table: signs of directions out of random rotations."""
    dim = unit.shape[1]
    wanted = bits * tables
    planes = np.concatenate([rotation(dim, 1000 + i) for i in range(-(-wanted // dim))], axis=1)[:, :wanted]
    signs = (unit @ planes >= 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Codes:
    """Sign codes of unit vectors with their correction factors."""

    def __init__(self, unit: np.ndarray):
        dim = unit.shape[1]
        self.rotated = (unit @ rotation(dim, 1)).astype(np.float32)
        self.signs = np.where(self.rotated >= 0, 1, -1).astype(np.float32) / np.float32(math.sqrt(dim))
        self.factor = (self.signs * self.rotated).sum(axis=1).clip(1e-3, 1.0)
        self.error = (CONFIDENCE * np.sqrt(np.maximum(1 - self.factor**2, 0) / self.factor**2)
                      / math.sqrt(max(dim - 1, 1)) + 1e-5)

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper confidence bound of the cosine of each pair: the closer of both codes' bounds."""
        one = (self.signs[i] * self.rotated[j]).sum(axis=1) / self.factor[i] + self.error[i]
        two = (self.signs[j] * self.rotated[i]).sum(axis=1) / self.factor[j] + self.error[j]
        return np.minimum(one, two)


def _compare(rows: pd.DataFrame, bits: int, tables: int, similarity: float) -> pd.DataFrame:
    """Links per vector and the smallest vector each is connected with, in one shard."""
    out = []
    for _, part in rows.groupby(rows["vector"].map(len)):
        part = part.sort_values(["label", "table", "code", "one", "two", "id"])
        ids, at = np.unique(part["id"].to_numpy(), return_inverse=True)
        # a vector of the shard is prepared once, however many tables brought it
        first = np.zeros(len(ids), np.int64)
        first[at[::-1]] = np.arange(len(part))[::-1]
        x = _matrix(part["vector"].iloc[first])
        copies = part["copies"].to_numpy()[first]
        unit = _unit(x)
        codes, buckets = Codes(unit), bucket_codes(unit, bits, tables)
        group = part.groupby(["label", "table", "code", "one", "two"], sort=False).ngroup().to_numpy()
        two_blocks = (part["one"] != part["two"]).to_numpy()
        side = np.where(two_blocks, part["mine"].to_numpy(), -1)
        table = part["table"].to_numpy()
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        linked = []
        for p, q in pairs_in_runs(group, side):
            i, j, t = at[p], at[q], table[p]
            maybe = codes.upper(i, j) >= similarity
            i, j, t = i[maybe], j[maybe], t[maybe]
            before = (buckets[i] == buckets[j]).argmax(axis=1)  # first table the pair shares
            own = (before == t) & (i != j)
            i, j = i[own], j[own]
            cosine = (x[i] * x[j]).sum(axis=1) / (
                np.sqrt((x[i] * x[i]).sum(axis=1)) * np.sqrt((x[j] * x[j]).sum(axis=1)))
            hit = cosine >= similarity
            i, j = i[hit], j[hit]
            links += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
            links += np.bincount(j, weights=copies[i], minlength=len(ids)).astype(np.int64)
            linked.append((i, j))
        if linked:
            i, j = (np.concatenate(c) for c in zip(*linked, strict=True))
            while True:  # smallest neighbour, then smallest of that, until nothing moves
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
        some = links > 0
        out.append(pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["id", "links", "root"], dtype="int64")


def vector_links(df: DataFrame, id_col: str, vector_col: str, label_col: str,
                 similarity: float = SIMILARITY) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row."""
    vector = F.col(vector_col)
    takes_part = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector)
                  & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)))
    rows = written(df.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(takes_part, F.xxhash64(label_col, vector_col)).alias("hash"),
        F.when(takes_part, F.col(label_col)).alias("label"), F.when(takes_part, vector).alias("vector")), "vector-rows")
    distinct = written(rows.filter("hash IS NOT NULL").groupBy("hash", "label", "vector").agg(
        F.min("id").alias("id"), F.count("*").alias("copies")), "vector-distinct")
    most = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_plan(most, similarity)

    def hashed(batches):
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].map(len)):
                codes = bucket_codes(_unit(_matrix(part["vector"])), bits, tables)
                yield pd.DataFrame({"id": part["id"].to_numpy().repeat(tables), "label": part["label"].to_numpy().repeat(tables),
                                    "dim": len(part["vector"].iloc[0]), "table": np.tile(np.arange(tables), len(part)),
                                    "code": codes.ravel()})

    label_type = distinct.schema["label"].dataType.simpleString()
    coded = distinct.select("id", "label", "vector").mapInPandas(
        hashed, f"id long, label {label_type}, dim int, table int, code long")
    key = ["label", "dim", "table", "code"]
    shared = written(coded.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), "vector-buckets")
    met = meet_in_blocks(coded.join(shared, key), "n", "id", BLOCK_ROWS) \
        .select("id", "label", "table", "code", "mine", "one", "two")
    met = written(met, "vector-met")
    shards = max(1, -(-met.count() // SHARD_ROWS))
    carried = met.join(distinct.select("id", "label", "vector", "copies"), ["id", "label"])
    shard = F.pmod(F.xxhash64("label", "table", "code", "one", "two"), F.lit(shards))
    compared = written(carried.groupBy(shard.alias("shard")).applyInPandas(
        lambda group: _compare(group, bits, tables, similarity), "id long, links long, root long"), "vector-links")
    roots = connected_components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = distinct.join(links, "id", "left").join(roots, "id", "left").select(
        F.col("hash").alias("k"), F.col("vector").alias("same"), F.col("label").alias("its"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"))
    nodes = written(nodes, "vector-nodes")
    joined = rows.join(nodes, (F.col("hash") == F.col("k")) & (F.col("vector") == F.col("same"))
                       & (F.col("label") == F.col("its")), "left")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))
