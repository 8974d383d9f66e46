"""Regression and classification metrics as plain mergeable aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import improvement_pct, target_met
from .quantiles import exact_quantiles

# Fixed values.
TOLERANCE = 0.15
SMALL_SAMPLE = 30
LOWER_IS_BETTER = {"r2": False, "mae": True, "rmse": True, "mape": True}


def metric_columns(actual: Column, predicted: Column, tolerance: float = TOLERANCE) -> dict[str, Column]:
    """Aggregates over money-scale columns: n, r2, mae, rmse, mape, within_tol."""
    err = predicted - actual
    floor = F.greatest(actual, F.lit(1.0))
    n = F.count(err)
    sse, spread = F.sum(err * err), F.var_pop(F.when(err.isNotNull(), actual)) * n
    inside = F.when(err.isNotNull(), F.when(F.abs(err) / floor <= tolerance, 1.0).otherwise(0.0))
    return {
        "n": n,
        "r2": 1 - F.try_divide(sse, spread),
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(F.try_divide(sse, n)),
        "mape": F.avg(F.abs(err) / floor) * 100,
        "within_tol": F.coalesce(F.avg(inside), F.lit(0.0)),
    }


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), log_scale: bool = True, tolerance: float = TOLERANCE
) -> DataFrame:
    """Metrics per group; log inputs are brought back to money first."""
    back = F.expm1 if log_scale else (lambda c: c)
    scored = df.select(*by, back(F.col(actual).cast("double")).alias("y"), back(F.col(predicted).cast("double")).alias("p"))
    m = metric_columns(F.col("y"), F.col("p"), tolerance)
    return scored.groupBy(*by).agg(*[c.alias(k) for k, c in m.items()])


def split_and_slice_metrics(
    df: DataFrame, actual: str, predicted: str, split: str = "split", slice_col: str = "city", log_scale: bool = True
) -> DataFrame:
    """Metrics per split and per (split, slice) in one job; the NULL ``slice_col`` row is the whole split.

    ``small_sample`` marks slices under SMALL_SAMPLE rows.
    """
    back = F.expm1 if log_scale else (lambda c: c)
    scored = df.select(split, slice_col, back(F.col(actual).cast("double")).alias("y"), back(F.col(predicted).cast("double")).alias("p"))
    m = metric_columns(F.col("y"), F.col("p"))
    sets = [[F.col(split)], [F.col(split), F.col(slice_col)]]
    out = scored.groupingSets(sets, split, slice_col).agg(
        *[c.alias(k) for k, c in m.items()], (F.grouping(slice_col) == 1).alias("is_total"))
    return out.withColumn("small_sample", F.col("n") < SMALL_SAMPLE)


def to_long(metrics: DataFrame, ids: Sequence[str], names: Sequence[str] = tuple(LOWER_IS_BETTER)) -> DataFrame:
    return metrics.select(*ids, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])))


def compare_versions(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Improvement of ``new`` over ``old`` long metric tables; a zero baseline is skipped."""
    a = old.select(*keys, "metric", F.col("value").alias("old_value"))
    b = new.select(*keys, "metric", F.col("value").alias("new_value"))
    lower = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, v in LOWER_IS_BETTER.items()], F.lit(True))
    out = a.join(b, [*keys, "metric"]).filter("old_value <> 0")
    out = out.withColumn("improvement_pct", improvement_pct(F.col("old_value"), F.col("new_value"), lower))
    return out.withColumn("target_met", target_met(F.col("improvement_pct")))


def latency_p95(log: DataFrame, latency: str = "latency_ms", by: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(log, by, {latency: (0.95,)})
    return q.select(*by, F.col(f"{latency}_q0").alias("p95_ms"), "rows")


def confusion(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def macro_scores(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Macro precision, recall and F1 over the labels seen as actual or predicted."""
    cells = confusion(df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()), actual, predicted, by)
    sides = F.array(
        F.struct(F.col(actual).alias("label"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")),
    )
    hit = F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)
    per = cells.select(*by, hit.alias("hit"), F.inline(sides)).groupBy(*by, "label").agg(
        (F.sum("hit") / 2).alias("tp"), F.sum("real").alias("real"), F.sum("said").alias("said"))
    p, r = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "real"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return per.groupBy(*by).agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1"), F.count("label").alias("labels"))


def metric_map(df: DataFrame) -> Mapping[str, float]:
    return df.first().asDict()
