"""Model registry as append-only tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import _or_none
from .joins import keyed_join

CSV_KEY = ("model_name", "version", "git_commit")
MODEL_KEY = ("model_name", "version")


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = CSV_KEY) -> DataFrame:
    """Incoming rows whose key is not registered yet; of rows with one key the least, columns compared in turn."""
    rest = [c for c in incoming.columns if c not in keys]
    least = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__least")).select(*keys, "__least.*") if rest else incoming.distinct()
    return keyed_join(least.select(*incoming.columns), existing.select(*keys).distinct(), keys, "left_anti")


def append_once(incoming: DataFrame, path: str, run: str, keys: Sequence[str] = CSV_KEY) -> int:
    """Register the rows of ``run`` whose key no other run has registered; returns how many it holds.

    A run owns one folder, written whole and seen only once complete, so a retry replaces what it wrote before and never adds to it. Two runs that register one key at
    the same time both keep their row on disk; ``read_registry`` shows one of them, always the same.
    """
    spark = incoming.sparkSession
    others = _runs(spark, path, incoming).filter(F.col("run") != run)
    own = written(new_rows(others, incoming, keys), "registry_rows")
    own.write.mode("overwrite").parquet(f"{path}/run={run}")
    return own.count()


def _runs(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    found = _or_none(spark, path)
    if found is not None:
        return found.withColumn("run", F.col("run").cast("string"))
    if like is None:
        raise FileNotFoundError(f"no registry at {path}")
    return like.limit(0).withColumn("run", F.lit(None).cast("string"))


def read_registry(spark: SparkSession, path: str, keys: Sequence[str] = CSV_KEY) -> DataFrame:
    """One row for each key: that of the first run by name; of several runs writing at once, the first one wins for every reader."""
    rows = _runs(spark, path)
    rest = [c for c in rows.columns if c not in keys and c != "run"]
    return rows.groupBy(*keys).agg(F.min(F.struct("run", *rest)).alias("__least")).select(*keys, *[f"__least.{c}" for c in (*rest, "run")])


def active_models(registry: DataFrame, activations: DataFrame, at: str = "activated_at") -> DataFrame:
    """The one active version per model: its latest activation; unknown targets never win."""
    known = keyed_join(activations, registry.select(*MODEL_KEY).distinct(), MODEL_KEY, "left_semi")
    last = known.groupBy("model_name").agg(F.max_by("version", F.struct(at, "version")).alias("version"))
    return registry.join(last, list(MODEL_KEY), "inner")


def list_models(registry: DataFrame, model_name: str | None = None, limit: int = 100, date: str = "training_date", rid: str = "id") -> DataFrame:
    """Newest first, as many rows as asked for, at least one."""
    out = registry if model_name is None else registry.filter(F.col("model_name") == model_name)
    return out.orderBy(F.desc(date), F.desc(rid)).limit(max(limit, 1))


def next_version(registry: DataFrame, artifact: str = "artifact", stems: Sequence[str] | None = None) -> DataFrame:
    """Per model stem ``<name>_v<n>``: highest n plus one."""
    shape = r"^(.*)_v(\d+)$" if stems is None else "^(" + "|".join(map(re.escape, stems)) + r")_v(\d+)$"
    named = registry.filter(F.col(artifact).rlike(shape))
    return named.groupBy(F.regexp_extract(artifact, shape, 1).alias("model_name")).agg(
        (F.max(F.regexp_extract(artifact, shape, 2).cast("int")) + 1).alias("next_version"))


def feature_hash(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """First 16 hex digits of the sha256 of the sorted distinct names (a column list, not data)."""
    names = F.array_join(F.sort_array(F.collect_set(name)), "\n")
    return df.groupBy(*by).agg(F.substring(F.sha2(names, 256), 1, 16).alias("feature_hash"))


def label_map_hash(df: DataFrame, feature: str = "feature", label: str = "label") -> DataFrame:
    """sha1 of the sorted {feature: label} JSON."""
    entry = F.concat(F.lit('"'), F.col(feature), F.lit('": "'), F.col(label), F.lit('"'))
    body = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(feature, entry.alias("e")))), lambda s: s["e"]), ", ")
    return df.agg(F.sha1(F.concat(F.lit("{"), body, F.lit("}"))).alias("label_map_hash"))


def pick_winner(results: DataFrame, by: Sequence[str] = (), metric: str = "rmse", tie: str = "mae", name: str = "model") -> DataFrame:
    """Lowest metric, then lowest tie-breaker, then name."""
    if metric not in results.columns or tie not in results.columns:
        raise ValueError(f"results lack {metric} or {tie}")
    best = F.min_by(F.struct(name, metric, tie), F.struct(metric, tie, name)).alias("w")
    return results.groupBy(*by).agg(best).filter("w IS NOT NULL").select(*by, f"w.{name}", f"w.{metric}", f"w.{tie}")


def consensus(rankings: DataFrame, feature: str = "feature", method: str = "method", score: str = "importance", k: int = 20) -> DataFrame:
    """Features within the top k of every method; k rows per method and task are shuffled."""
    top = rank_features(rankings, feature, method, score, k)
    methods = rankings.agg(F.count_distinct(method).alias("m"))
    seen = top.groupBy(feature).agg(F.count_distinct(method).alias("hits"))
    return seen.join(F.broadcast(methods), F.col("hits") == F.col("m")).select(feature)


def rank_features(rankings: DataFrame, feature: str = "feature", method: str = "method", score: str = "importance", k: int = 20) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy(method).orderBy(F.desc(score), feature)
    return rankings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def artifact_name(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit("_v"), version.cast("string"))
