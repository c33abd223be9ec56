"""Run ledger and model promotion as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.options import RegistryOptions
from tidemark.plans.lookup import lookup_join
from tidemark.plans.ordered import block_edges, running
from tidemark.session import cut_lineage


def _leaves(kind: T.DataType, value: Column, path: str) -> list[Column]:
    """Arrays of (key, value) for every leaf below a column, keys joined by dots."""
    if isinstance(kind, T.StructType):
        return [
            part
            for f in kind.fields
            for part in _leaves(f.dataType, value[f.name], f"{path}.{f.name}")
        ]
    if isinstance(kind, T.MapType):
        entries = F.map_entries(value)
        pairs = F.transform(
            entries,
            lambda e: F.struct(
                F.concat(F.lit(f"{path}."), e["key"].cast("string")).alias("key"),
                e["value"].cast("string").alias("value"),
            ),
        )
        return [F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))]
    return [F.array(F.struct(F.lit(path).alias("key"), value.cast("string").alias("value")))]


def flatten_settings(runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """``(run_id, key, value)`` rows of nested run settings or tags; nulls are skipped."""
    parts = [
        part
        for f in runs.schema.fields
        if f.name != run_id
        for part in _leaves(f.dataType, col(f.name), f.name)
    ]
    return runs.select(col(run_id), F.inline(F.concat(*parts))).filter(F.col("value").isNotNull())


def flatten_metrics(metrics: DataFrame) -> DataFrame:
    """``(run_id, key, value)`` with keys ``<split>_<metric>``; null values are skipped."""
    return metrics.filter(F.col("value").isNotNull()).select(
        "run_id", F.concat_ws("_", "split", "metric").alias("key"), "value"
    )


def candidate_metrics(runs: DataFrame, metrics: DataFrame, options: RegistryOptions) -> DataFrame:
    """Comparison metric of every run, null where it was not measured."""
    chosen = metrics.filter(
        (F.col("split") == options.split) & (F.col("metric") == options.metric)
    ).select("run_id", F.col("value").alias("candidate_metric"))
    return runs.join(chosen, "run_id", "left")


def version_metrics(versions: DataFrame, metrics: DataFrame, options: RegistryOptions) -> DataFrame:
    """Comparison metric of registered versions: their own tag if it is for the same
    split and metric, else the metric of the run they came from; others drop out."""
    of_run = metrics.filter(
        (F.col("split") == options.split) & (F.col("metric") == options.metric)
    ).select("run_id", F.col("value").alias("__run_metric"))
    tagged = F.when(
        (F.col("metric_split") == options.split) & (F.col("metric_name") == options.metric),
        F.col("candidate_metric").cast("double"),
    )
    return (
        versions.join(of_run, "run_id", "left")
        .withColumn("incumbent_metric", F.coalesce(tagged, F.col("__run_metric")))
        .filter(F.col("incumbent_metric").isNotNull())
        .select("model_name", "version", "run_id", "incumbent_metric")
    )


def best_incumbents(
    scored_versions: DataFrame, candidates: DataFrame, options: RegistryOptions
) -> DataFrame:
    """Best version per candidate run, versions of the run itself left out.

    Ties keep the earliest version. The best two versions of different runs are
    enough to answer for any run, so no pairing of all runs with all versions.
    """
    sign = F.lit(-1.0 if options.greater_is_better else 1.0)
    entry = F.struct(
        (F.col("incumbent_metric") * sign).alias("rank"), F.col("version"),
        F.col("incumbent_metric").alias("metric"), F.col("run_id").alias("run"),
    )
    per_run = scored_versions.groupBy("model_name", "run_id").agg(F.min(entry).alias("e"))
    best = per_run.groupBy("model_name").agg(F.min("e").alias("first"))
    second = (
        lookup_join(per_run, best, ["model_name"], spread_by=["run_id"])
        .filter(~F.col("run_id").eqNullSafe(F.col("first.run")))
        .groupBy("model_name")
        .agg(F.min("e").alias("second"))
    )
    top = best.join(second, "model_name", "left")
    own = F.col("first.run").eqNullSafe(F.col("run_id"))
    chosen = F.when(own, F.col("second")).otherwise(F.col("first"))
    joined = lookup_join(candidates, top, ["model_name"], "left", spread_by=["run_id"])
    return joined.withColumns(
        {
            "incumbent_metric": chosen["metric"],
            "incumbent_version": chosen["version"],
        }
    ).drop("first", "second")


def _beats(candidate: Column, incumbent: Column, options: RegistryOptions) -> Column:
    return candidate > incumbent if options.greater_is_better else candidate < incumbent


def promotion_status(candidates: DataFrame, options: RegistryOptions) -> DataFrame:
    """Add the promotion decision; only a strict improvement replaces the incumbent."""
    metric, incumbent = F.col("candidate_metric"), F.col("incumbent_metric")
    status = (
        F.when(F.lit(not options.enabled), "disabled")
        .when(metric.isNull(), "metric_unavailable")
        .when(incumbent.isNotNull() & ~_beats(metric, incumbent, options), "not_best")
        .otherwise("registered")
    )
    return candidates.withColumn("status", status).withColumn(
        "registered", F.col("status") == "registered"
    )


def promotion_history(
    candidates: DataFrame, order: str, options: RegistryOptions, rows_per_block: int = 500_000
) -> DataFrame:
    """Replay promotions of all models over their whole history.

    What is registered is always a running best, so the incumbent of a candidate
    is the best metric before it and its version the number of promotions so far.
    """
    fn = "max" if options.greater_is_better else "min"
    edges = block_edges(candidates, order, rows_per_block)
    before = running(
        candidates, ["model_name"], order, {"incumbent_metric": (fn, "candidate_metric")},
        inclusive=False, edges=edges,
    )
    decided = promotion_status(before, options).withColumn(
        "__one", F.col("registered").cast("bigint")
    )
    numbered = running(decided, ["model_name"], order, {"__versions": ("sum", "__one")}, edges=edges)
    return numbered.withColumns(
        {
            "version": F.when(F.col("registered"), F.col("__versions")),
            "incumbent_version": F.when(
                F.col("incumbent_metric").isNotNull(), F.col("__versions") - F.col("__one")
            ),
        }
    ).drop("__one", "__versions")


def new_versions(promoted: DataFrame, versions: DataFrame, options: RegistryOptions) -> DataFrame:
    """Version rows to append for newly registered runs.

    Several runs of a model follow each other in the order of their run ids,
    which is the order of time.
    """
    latest = versions.groupBy("model_name").agg(F.max("version").alias("__latest"))
    placed = F.row_number().over(Window.partitionBy("model_name").orderBy("run_id"))
    return (
        promoted.filter("registered")
        .withColumn("__place", placed)
        .join(latest, "model_name", "left")
        .select(
            "model_name",
            (F.coalesce("__latest", F.lit(0)) + F.col("__place")).cast("bigint").alias("version"),
            "run_id",
            F.lit(options.metric).alias("metric_name"),
            F.lit(options.split).alias("metric_split"),
            "candidate_metric",
        )
    )


def alias_rows(new: DataFrame, options: RegistryOptions) -> DataFrame:
    if not options.alias:
        new = new.filter(F.lit(False))
    return new.select("model_name", F.lit(options.alias).cast("string").alias("alias"), "version")


def upsert_aliases(aliases: DataFrame, changed: DataFrame) -> DataFrame:
    """Alias table with the changed (model, alias) pairs pointing to their new version."""
    kept = aliases.join(changed.select("model_name", "alias"), ["model_name", "alias"], "left_anti")
    return kept.unionByName(changed)


def resolve_models(
    requests: DataFrame, versions: DataFrame, aliases: DataFrame, strict: bool = True
) -> DataFrame:
    """Version and location of requested models, by alias or by pinned version.

    A request that names both or neither is a LookupError here, and so is one that
    finds no version; without ``strict`` the latter is a row with ``found`` = false.
    """
    unclear = requests.filter(F.col("alias").isNotNull() == F.col("pinned_version").isNotNull()).limit(1).collect()
    if unclear:
        raise LookupError(f"give either an alias or a version of model '{unclear[0]['model_name']}'")
    named = requests.join(
        aliases.withColumnRenamed("version", "__alias_version"), ["model_name", "alias"], "left"
    ).withColumn("version", F.coalesce("pinned_version", "__alias_version"))
    found = versions.select("model_name", "version", "run_id", F.lit(True).alias("found"))
    uri = F.concat(
        F.lit("models:/"), F.col("model_name"),
        F.when(F.col("alias").isNotNull(), F.concat(F.lit("@"), F.col("alias"))).otherwise(
            F.concat(F.lit("/"), F.col("pinned_version").cast("string"))
        ),
    )
    joined = named.join(found, ["model_name", "version"], "left")
    has = F.coalesce(F.col("found"), F.lit(False))
    if strict:
        # asked here, as a check inside a column goes with the column when a plan is pruned
        joined = cut_lineage(joined)
        lost = joined.filter(~has).select(uri.alias("uri")).limit(1).collect()
        if lost:
            raise LookupError(f"no registered model at {lost[0]['uri']}")
        return joined.select(
            "model_name", "alias", "pinned_version", "version", "run_id", uri.alias("model_uri")
        )
    return joined.select(
        "model_name", "alias", "pinned_version", F.when(has, F.col("version")).alias("version"),
        "run_id", F.when(has, uri).alias("model_uri"), has.alias("found"),
    )


def latest_run(
    runs: DataFrame, models: DataFrame, run_id: str | None = None, model_path: str | None = None
) -> DataFrame:
    """The run to serve: an explicit model location, a pinned run, else the newest run
    that has a model. Run ids sort in time order. A model that is not there is an error."""
    if model_path is not None:
        found = models.filter(F.col("model_path") == model_path)
        wanted = f"at '{model_path}'"
    elif run_id is not None:
        found = models.filter(F.col("run_id") == run_id)
        wanted = f"of run '{run_id}'"
    else:
        newest = runs.join(models, "run_id", "left_semi").agg(F.max("run_id").alias("run_id"))
        found = newest.join(models, "run_id")
        wanted = "of any run"
    found = found.select("run_id", "model_path")
    if found.limit(1).count() == 0:
        raise FileNotFoundError(f"no model {wanted}")
    return found


def baseline_for_models(
    models: DataFrame, baselines: DataFrame, keys: Sequence[str], tracked: DataFrame | None = None
) -> DataFrame:
    """Models with the baseline of their run: the local one, else the tracked one, else null.

    Both baseline tables have the same columns. ``baseline_source`` says which one it is.
    """
    names = [c for c in baselines.columns if c not in keys]
    local = baselines.select(*keys, F.struct(*[col(c) for c in names]).alias("__local"))
    joined = models.join(local, list(keys), "left")
    if tracked is None:
        chosen, source = F.col("__local"), F.when(F.col("__local").isNotNull(), "local")
    else:
        other = tracked.select(*keys, F.struct(*[col(c) for c in names]).alias("__tracked"))
        joined = joined.join(other, list(keys), "left")
        chosen = F.coalesce("__local", "__tracked")
        source = F.when(F.col("__local").isNotNull(), "local").when(F.col("__tracked").isNotNull(), "tracked")
    return joined.select(
        *[col(c) for c in models.columns], *[chosen[c].alias(c) for c in names], source.alias("baseline_source")
    )
