"""State as a log of versions, and the commits its readers follow.

A micro-batch writes the rows of the keys it has touched, by bucket of keys,
below its own folder: ``<table>/version=<n>/bucket=<b>``. Nothing is visible
until its commit, one small file that lists the versions every bucket is made
of and that appears last. Of a key's rows those of the newest version count. A
bucket with ``compact_after`` versions is written whole by the next micro-batch
that touches it; buckets nobody touches are neither read nor written. Folders
that the last ``keep`` commits do not mention are removed.

A micro-batch that was killed has no commit: its replay overwrites what it had
written. One that is replayed after its commit finds it and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.plans.local import small_table
from tidemark.session import folder_names, remove_folder
from tidemark.sources.store import partition_path

VERSION, BUCKET = "version", "bucket"
BUCKETS = 64
COMPACT_AFTER = 8
KEEP = 2

Live = Mapping[tuple[str, int], tuple[int, ...]]


class CommitLog:
    """Versioned tables of one key column below a root."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS,
                 compact_after: int = COMPACT_AFTER, keep: int = KEEP) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.buckets, self.compact_after, self.keep = buckets, compact_after, keep
        self._seen: dict[int, Live] = {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(col(self.key)), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[int]:
        """Numbers of the commits that are still kept."""
        names = folder_names(self.spark, f"{self.root}/commits")
        done = [n for n in names if n.startswith(f"{VERSION}=")
                and any(f.startswith("part-") for f in folder_names(self.spark, f"{self.root}/commits/{n}"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def newest(self) -> int | None:
        return max(self.commits(), default=None)

    def live(self, commit: int) -> Live:
        """Versions that every (table, bucket) is made of; at most one entry per bucket."""
        if commit in self._seen:
            return self._seen[commit]
        rows = self.spark.read.parquet(partition_path(self.root, "commits", VERSION, commit)).collect()
        return {(r["name"], r["bucket"]): tuple(r["versions"]) for r in rows if r["name"] is not None}

    def _path(self, table: str, version: int, bucket: int) -> str:
        return f"{partition_path(self.root, table, VERSION, version)}/{BUCKET}={bucket}"

    def read(self, table: str, live: Live, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """Newest rows of the keys in some buckets (all by default); other folders are not opened."""
        wanted = None if buckets is None else set(buckets)
        held = {b: v for (name, b), v in live.items() if name == table and (wanted is None or b in wanted)}
        paths = [self._path(table, v, b) for b, versions in held.items() for v in versions]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths)
        if all(len(versions) == 1 for versions in held.values()):
            return rows.drop(VERSION, BUCKET)
        # one row per key and version meets here, not the rows of the table
        newest = rows.groupBy(col(self.key).alias("__key")).agg(F.max(VERSION).alias("__newest"))
        return rows.join(newest, (col(self.key) == F.col("__key")) & (F.col(VERSION) == F.col("__newest")), "left_semi") \
            .drop(VERSION, BUCKET)

    def write(self, table: str, version: int, touched: DataFrame, live: Live, buckets: Iterable[int]) -> dict:
        """Write the rows of the touched keys; returns what becomes of the buckets.

        ``touched`` has all rows that count for its keys from now on.
        """
        buckets = list(buckets)
        whole = [b for b in buckets if len(live.get((table, b), ())) + 1 >= self.compact_after]
        rows = touched.withColumn(BUCKET, self.bucket())
        if whole:
            before = self.read(table, live, whole)
            others = before.join(touched.select(self.key).distinct(), self.key, "left_anti")
            rows = rows.unionByName(others.withColumn(BUCKET, self.bucket()))
        path = partition_path(self.root, table, VERSION, version)
        # a bucket is one folder; its files are as many as the tasks that hold its rows
        rows.repartition(F.col(BUCKET), F.pmod(F.xxhash64(col(self.key)), F.lit(4 * self.buckets))) \
            .write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        return {(table, b): (version,) if b in whole else (*live.get((table, b), ()), version) for b in buckets}

    def commit(self, version: int, live: Live) -> None:
        """Make a version visible, then remove what no kept commit needs."""
        rows = [(name, bucket, list(versions)) for (name, bucket), versions in sorted(live.items())]
        schema = "name string, bucket int, versions array<int>"
        # a single file: it is there or it is not; a commit without buckets still is one
        small_table(self.spark, rows or [(None, None, None)], schema).coalesce(1).write.mode("overwrite").parquet(
            partition_path(self.root, "commits", VERSION, version))
        self._seen = {c: v for c, v in self._seen.items() if c > version - self.keep} | {version: dict(live)}
        kept = self.commits()[-self.keep:]
        needed = {(name, v) for c in kept for (name, _), versions in self.live(c).items() for v in versions}
        for name in {name for name, _ in live}:
            for folder in folder_names(self.spark, f"{self.root}/{name}"):
                if folder.startswith(f"{VERSION}=") and (name, int(folder.split("=")[1])) not in needed:
                    remove_folder(self.spark, f"{self.root}/{name}/{folder}")
        for old in folder_names(self.spark, f"{self.root}/commits"):
            if old.startswith(f"{VERSION}=") and int(old.split("=")[1]) < kept[0]:
                remove_folder(self.spark, f"{self.root}/commits/{old}")
