from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators.monitor import AT, BATCH, KEY, SEQ, arrival_order
from tidemark.session import checkpoints_removed, cut_lineage, folder_names, new_folder
from tidemark.sources.commit_log import CommitLog


def _rows(spark, version, keys):
    return spark.createDataFrame([(k, version, i) for k in keys for i in range(2)], "k string, v long, i long")


def _step(log, spark, version, keys, live):
    rows = _rows(spark, version, keys)
    touched = [r["b"] for r in rows.select(log.bucket().alias("b")).distinct().collect()]
    return {**live, **log.write("t", version, rows, live, touched)}


def _held(df):
    return sorted(map(tuple, df.select("k", "v", "i").collect()))


def test_newest_versions_count_and_only_touched_buckets_are_written(spark):
    log = CommitLog(spark, new_folder(spark, "log"), "k", buckets=8, compact_after=3)
    keys = [f"k{i}" for i in range(30)]
    newest = {}
    live = {}
    for version in range(9):
        touched = keys if version == 0 else keys[version % 3 : 3 + version % 3]
        live = _step(log, spark, version, touched, live)
        log.commit(version, live)
        newest.update(dict.fromkeys(touched, version))
        buckets = folder_names(spark, f"{log.root}/t/version={version}")
        assert 0 < len([b for b in buckets if b.startswith("bucket=")]) <= len(touched)
        assert _held(log.read("t", log.live(log.newest()))) == sorted((k, v, i) for k, v in newest.items() for i in range(2))
    assert max(len(v) for v in live.values()) <= 3
    # commits and versions that nobody needs are gone, idle buckets are where they were
    assert log.commits() == [7, 8]
    kept = {int(n.split("=")[1]) for n in folder_names(spark, f"{log.root}/t")}
    assert kept == {v for c in (7, 8) for vs in log.live(c).values() for v in vs} and 0 in kept
    some = {b for _, b in live} - {0, 1, 2}
    only = log.read("t", live, sorted(some)[:1])
    assert {r["b"] for r in only.select(log.bucket().alias("b")).collect()} == set(sorted(some)[:1])


def test_a_killed_version_is_invisible_and_its_replay_overwrites(spark):
    log = CommitLog(spark, new_folder(spark, "log"), "k", buckets=4)
    live = _step(log, spark, 0, ["a", "b", "c"], {})
    assert log.newest() is None and log.read("t", {}) is None
    log.commit(0, live)
    _step(log, spark, 1, ["a", "z"], live)  # killed before its commit
    assert log.newest() == 0
    assert {k for k, _, _ in _held(log.read("t", log.live(0)))} == {"a", "b", "c"}
    live = _step(log, spark, 1, ["a"], log.live(0))
    log.commit(1, live)
    assert _held(log.read("t", log.live(1))) == [("a", 1, 0), ("a", 1, 1), ("b", 0, 0), ("b", 0, 1), ("c", 0, 0), ("c", 0, 1)]
    # a version without any row is a commit as well
    log.commit(2, {**live, **log.write("t", 2, _rows(spark, 2, []), live, [])})
    assert log.newest() == 2 and log.live(2) == live


def test_checkpoints_are_removed_after_use(spark):
    with checkpoints_removed(spark):
        made = cut_lineage(spark.range(5))
        assert made.count() == 5
        file = made._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        assert folder_names(spark, file)
    assert folder_names(spark, file) == []


def _observed(spark, rows):
    return spark.createDataFrame(rows, f"{KEY} string, {BATCH} long, {SEQ} long").withColumn(AT, F.current_timestamp())


def test_rows_follow_their_arrival(spark):
    window = _observed(spark, [("a", 3, 50), ("a", 4, 90), ("b", 1, -7)])
    rows = _observed(spark, [("a", 6, 1), ("a", 5, 200), ("a", 5, 7), ("a", 6, 0), ("b", 2, 100), ("c", 0, -3), ("c", 0, -9)])
    got = arrival_order(rows, window).collect()
    order = {k: [(r[BATCH], r[SEQ]) for r in sorted(got, key=lambda r: r[SEQ]) if r[KEY] == k] for k in "abc"}
    assert [b for b, _ in order["a"]] == [5, 5, 6, 6] and order["a"][0][1] == 91
    assert order["a"][1][1] - order["a"][0][1] == 193
    assert [q for _, q in order["b"]] == [0] or order["b"][0][1] > -7
    assert order["c"] == [(0, 0), (0, 6)]


def test_a_batch_that_goes_back_is_an_error(spark):
    window = _observed(spark, [("a", 4, 90)])
    with pytest.raises(Exception, match="goes back"):
        arrival_order(_observed(spark, [("a", 4, 95)]), window).select(F.sum(SEQ)).collect()
