"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_SETTING = "spark.checkpoint.dir"
_SCOPE = threading.local()


def build_session(app: str, master: str | None = None, shuffle_partitions: int | None = None,
                  **settings: str) -> SparkSession:
    """Session with adaptive execution, UTC timestamps and case-sensitive names."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it; there is no other."""
    named = spark.conf.get(SHARED_DIR_SETTING, None) or spark.sparkContext.getConf().get(
        SHARED_DIR_SETTING, None
    )
    if not named:
        raise RuntimeError(f"set {SHARED_DIR_SETTING} to a folder all executors can reach")
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative intermediate."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    cut = df.checkpoint()
    held = getattr(_SCOPE, "files", None)
    if held is not None:
        file = cut._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            held.append(file.get())
    return cut


def stored(df: DataFrame, label: str) -> DataFrame:
    """Large intermediate as Parquet below the shared folder; takes a part of a checkpoint's space."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    held = getattr(_SCOPE, "files", None)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def checkpoints_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the checkpoints this thread makes inside, once their results are written."""
    outer = getattr(_SCOPE, "files", None)
    _SCOPE.files = []
    try:
        yield
    finally:
        made, _SCOPE.files = _SCOPE.files, outer
        for file in made:
            remove_folder(spark, file)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of this library's own making, wherever it is stored."""
    target, system = _file_system(spark, path)
    system.delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it does not exist."""
    target, system = _file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []
