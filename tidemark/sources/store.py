"""Run bundles, stage outputs and monitor tables as partitioned parquet.

Every write replaces exactly one partition folder, so a repeated task or
micro-batch leaves the same result as a single one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, is_dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import sanitize_key
from tidemark.options import FeatureSpec
from tidemark.plans.local import small_table
from tidemark.session import remove_folder

# --- fixed values -----------------------------------------------------------
STAGES = ("ingestion", "validation", "preprocessing", "training", "evaluation", "registration")
# ----------------------------------------------------------------------------


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def partition_path(root: str, table: str, key: str, value: str | int) -> str:
    parts = [root.rstrip("/"), table, f"{key}={value}"]
    return "/".join(p for p in parts if p)


def safe_run_id(spark: SparkSession, run_id: str) -> str:
    """Run id reduced to characters that are safe in a path."""
    return spark.range(1).select(sanitize_key(F.lit(run_id), "run").alias("k")).first()["k"]


def files_key(spark: SparkSession, path: str) -> str:
    """Key of the files of a dataset: other names, sizes or times give another one; contents are not read.

    Files are listed and folded into one row by tasks, however many there are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mark = F.xxhash64("path", "length", "modificationTime")
    seen = files.select(mark.alias("mark"), "length").agg(
        F.count("mark").alias("files"), F.sum("length").alias("bytes"), F.bit_xor("mark").alias("xor"),
        F.sum(F.pmod("mark", F.lit(1 << 31))).alias("sum"),
    ).first()
    return settings_key({"path": path, **seen.asDict()})


def settings_key(*settings: object) -> str:
    """Key of settings, option classes included; the order of names does not matter."""
    flat = [sorted((k, repr(v)) for k, v in _flat(s)) for s in settings]
    return hashlib.sha256(json.dumps(flat).encode()).hexdigest()


class RunStore:
    """Tables of a training history below one root, one partition per run."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str, run_id: str) -> str:
        return partition_path(self.root, table, "run_id", run_id)

    def write(self, table: str, run_id: str, df: DataFrame) -> DataFrame:
        """Write one run's partition and read it back."""
        df.drop("run_id").write.mode("overwrite").parquet(self.path(table, run_id))
        return self.read_run(table, run_id)

    def read_run(self, table: str, run_id: str) -> DataFrame | None:
        found = read_if_present(self.spark, self.path(table, run_id))
        return None if found is None else found.withColumn("run_id", F.lit(run_id))

    def read(self, table: str) -> DataFrame | None:
        """The table over all runs; partition pruning applies to ``run_id``."""
        return read_if_present(self.spark, f"{self.root}/{table}")

    def stage_key(self, stage: str, run_id: str) -> str | None:
        """What the kept output of a stage was made of; none if there is no complete one."""
        found = read_if_present(self.spark, self.path(f"stage_keys/{stage}", run_id))
        row = None if found is None else found.first()
        return None if row is None else row["stage_key"]

    def _kept(self, stage: str, run_id: str, key: str) -> bool:
        if stage not in STAGES:
            raise ValueError(f"unknown stage '{stage}'")
        if self.stage_key(stage, run_id) == key:
            return True
        # the key goes first and comes back last: an output without one counts for nothing
        remove_folder(self.spark, self.path(f"stage_keys/{stage}", run_id))
        return False

    def _keep(self, stage: str, run_id: str, key: str) -> None:
        self.write(f"stage_keys/{stage}", run_id, small_table(self.spark, [(key,)], "stage_key string"))

    def stage(self, stage: str, run_id: str, build: Callable[[], DataFrame],
              inputs: Sequence[str | None] = (), options: object = None) -> DataFrame:
        """Output of a stage: read if the run has one of the same inputs and options, else built and kept.

        ``inputs`` are keys: ``files_key`` of datasets, ``stage_key`` of the
        stages before. A stage that was killed has no key and is built again.
        """
        key = settings_key({"stage": stage, "inputs": list(inputs)}, {"options": options})
        if self._kept(stage, run_id, key):
            return self.read_run(f"stages/{stage}", run_id)
        built = self.write(f"stages/{stage}", run_id, build())
        self._keep(stage, run_id, key)
        return built

    def model_stage(self, run_id: str, build: Callable[[], PipelineModel],
                    inputs: Sequence[str | None] = (), options: object = None) -> PipelineModel:
        """The model of a run, fitted again only if its inputs or options have changed."""
        key = settings_key({"stage": "training", "inputs": list(inputs)}, {"options": options})
        if not self._kept("training", run_id, key):
            build().write().overwrite().save(self.path("models", run_id))
            self._keep("training", run_id, key)
        return self.load_model(run_id)

    def summarize_stage(self, stage: str, run_id: str, df: DataFrame, split: str | None = None,
                        spec: FeatureSpec | None = None) -> DataFrame:
        """Row and column counts of a stage output, kept next to it.

        With ``split`` also the rows per split, with ``spec`` the feature lists.
        """
        names = [c for c in df.columns if c != "run_id"]
        n = F.count(F.lit(1))
        if split is None:
            counted = df.agg(n.alias("row_count")).withColumn("split_sizes", F.lit(None).cast("map<string,bigint>"))
        else:  # train, validation, test
            entries = F.sort_array(F.collect_list(F.struct(F.col("split"), F.col("n"))))
            counted = df.groupBy(F.col(split).alias("split")).agg(n.alias("n")).agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.map_from_entries(entries).alias("split_sizes"))
        features = {
            f"{kind}_features": F.lit(None).cast("array<string>") if spec is None
            else F.array(*[F.lit(c) for c in getattr(spec, kind)]).cast("array<string>")
            for kind in ("numeric", "categorical")
        }
        summary = counted.select(
            F.lit(stage).alias("stage"),
            F.lit(len(names)).alias("column_count"),
            "row_count",
            F.array(*[F.lit(c) for c in names]).alias("columns"),
            "split_sizes",
            *[c.alias(name) for name, c in features.items()],
        )
        return self.write(f"stage_summary/{stage}", run_id, summary)

    def write_bundle(
        self,
        run_id: str,
        *,
        baseline: DataFrame,
        metrics: DataFrame,
        report: DataFrame,
        split_sizes: DataFrame,
        settings: Mapping[str, object],
        generated_at: str,
        model: PipelineModel | None = None,
    ) -> DataFrame:
        """Model, metrics, report, baseline and settings of a run; returns its ledger row.

        The ledger row is written last, so a run without one is incomplete.
        """
        paths = {name: self.path(name, run_id) for name in ("models", "metrics", "baselines", "reports")}
        if model is not None:
            model.write().overwrite().save(paths["models"])
        self.write("metrics", run_id, metrics)
        self.write("baselines", run_id, baseline)
        self.write("reports", run_id, report)
        self.write("split_sizes", run_id, split_sizes)
        flat = [(k, str(v)) for k, v in _flat(settings)]
        self.write("settings", run_id, small_table(self.spark, flat, "key string, value string"))
        features = baseline.agg(
            F.max("sample_size").alias("sample_size"),
            F.count(F.lit(1)).alias("feature_count"),
            F.array_sort(
                F.collect_list(F.struct("feature_pos", "feature_name", "feature_type"))
            ).alias("f"),
        )

        def of(kind: str):
            kept = F.filter("f", lambda x: x["feature_type"] == kind)
            return F.transform(kept, lambda x: x["feature_name"]).alias(f"{kind}_features")

        row = features.select(
            F.lit(generated_at).alias("generated_at_utc"),
            F.lit(paths["models"] if model is not None else None).cast("string").alias("model_path"),
            F.lit(paths["metrics"]).alias("metrics_path"),
            F.lit(paths["baselines"]).alias("baseline_path"),
            F.lit(paths["reports"]).alias("report_path"),
            F.col("sample_size").alias("baseline_sample_size"),
            F.col("feature_count").alias("baseline_feature_count"),
            of("numeric"),
            of("categorical"),
        )
        return self.write("runs", run_id, row)

    def load_model(self, run_id: str) -> PipelineModel:
        return PipelineModel.load(self.path("models", run_id))

    def runs_with_metadata(self, models: DataFrame) -> DataFrame:
        """Models with their ledger row, nulls where a run has none."""
        runs = self.read("runs")
        return models if runs is None else models.join(runs.drop("model_path"), "run_id", "left")


def _flat(settings: object, prefix: str = "") -> list[tuple[str, object]]:
    if is_dataclass(settings):
        settings = asdict(settings)
    if isinstance(settings, Mapping):
        return [
            leaf
            for key, value in settings.items()
            for leaf in _flat(value, f"{prefix}.{key}" if prefix else str(key))
        ]
    return [(prefix, settings)]
