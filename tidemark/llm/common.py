"""Helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import new_folder

#: Odd multipliers of 64-bit mixing functions (fixed values).
MIX_A = 0x9E3779B97F4A7C15
MIX_B = 0xBF58476D1CE4E5B9
MIX_C = 0x94D049BB133111EB


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder all executors share and read it from there.

    Cuts the lineage: what reads the result survives lost executors without
    computing ``df`` again.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``run`` as a task that leaves no memory behind.

    Python workers serve task after task of all stages. ``forget`` are functions
    of modules, so that they empty what this worker remembers; then what the
    allocators hold in reserve goes back to the machine.
    """
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for empty in forget:
                empty()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU C library only
            if trim is not None:
                trim(0)

    return task


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; ``x`` is uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_B)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_C)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as the long values Spark holds."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def pieces(batches: Iterable, rows: int = 256) -> Iterator:
    """Cut pandas batches so that a step holds at most ``rows`` texts."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def arrow_pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches; columns that only pass through keep their values and nulls."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def replaced(batch: pa.RecordBatch, without: str | None, **new: pa.Array) -> pa.RecordBatch:
    """The batch without a column, and with new ones or others in the place of old ones."""
    columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != without}
    columns.update(new)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def pairs_in_runs(groups: np.ndarray, side: np.ndarray, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) inside each run of equal ``groups``, ``at_once`` at a time.

    ``side`` is negative where all pairs count; in runs that hold two blocks it
    names the block, and only pairs across the blocks count.
    """
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    sizes = np.diff(edges)
    for size in np.unique(sizes[sizes > 1]):
        starts = edges[:-1][sizes == size]
        i, j = np.triu_indices(size, 1)
        per = max(1, at_once // len(i))
        for first in range(0, len(starts), per):
            part = starts[first : first + per, None]
            for cut in range(0, len(i), at_once):
                a = (part + i[cut : cut + at_once]).ravel()
                b = (part + j[cut : cut + at_once]).ravel()
                across = (side[a] < 0) | (side[a] != side[b])
                yield a[across], b[across]


def meet_in_blocks(rows: DataFrame, members: str, key: str, block_rows: int) -> DataFrame:
    """Repeat the rows of a group so that its blocks meet in pairs.

    ``members`` is the column with the group's size. Adds ``mine``, the row's
    block, and ``one`` <= ``two``, the blocks that meet: every pair of rows of
    a group meets, and no meeting has more than about two blocks of rows.
    """
    return (rows.withColumn("__blocks", F.ceil(F.col(members) / block_rows).cast("int"))
            .withColumn("mine", F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int"))
            .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
            .withColumns({"one": F.least("mine", "__other"), "two": F.greatest("mine", "__other")})
            .drop("__blocks", "__other"))
