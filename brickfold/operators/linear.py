"""Least squares from mergeable moments: one pass over the rows gives every fold's fit and its out-of-fold predictions.

Each task sums the products of (1, inputs, label) per fold; the folds' sums are small square matrices that add up. A fold's fit uses the
total minus its own matrix, so no row is read again for it. Only these matrices, whose size depends on the number of inputs alone, reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .market import fold_of
from .metrics import regression_metrics

FOLDS = 5  # fixed value
MOST_INPUTS = 2000


@dataclass(frozen=True)
class LinearFit:
    intercept: float
    coefficients: tuple[float, ...]
    rows: int


def as_array(df: DataFrame, column: str) -> Column:
    """A feature column as an array, whether it is a vector or already one."""
    return F.col(column) if df.schema[column].dataType.typeName() == "array" else vector_to_array(column)


def with_folds(df: DataFrame, key: Column, folds: int = FOLDS, out: str = "fold") -> DataFrame:
    """A fold for each row by a hash of its key; rows with equal or no key share one."""
    return df.withColumn(out, fold_of(F.coalesce(key.cast("string"), F.lit("")), folds).cast("int"))


def moments(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold") -> dict[int, np.ndarray]:
    """Per fold the matrix of sums of products of (1, inputs, label); rows without label, fold or inputs are left out."""
    rows = df.select(F.col(fold).cast("int").alias("fold"), as_array(df, features).alias("x"), F.col(label).cast("double").alias("y")).filter("fold IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, x, y = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            flat = x.flatten().to_numpy(zero_copy_only=False)
            if len(flat) % len(y) or any(n != len(flat) // len(y) for n in x.value_lengths().to_pylist()):
                raise ValueError("rows with different numbers of inputs")
            z = np.column_stack([np.ones(len(y)), flat.reshape(len(y), -1), y])
            for k in np.unique(fold):
                own = z[fold == k]
                held[int(k)] = held.get(int(k), 0) + own.T @ own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.ravel().tolist() for m in held.values()], pa.list_(pa.float64()))], names=["fold", "cells"])

    cells = rows.mapInArrow(sums, "fold int, cells array<double>").select("fold", F.posexplode("cells").alias("cell", "v"))
    found: dict[int, dict[int, float]] = {}
    for r in cells.groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.fold, {})[r.cell] = r.v
    out = {}
    for k, values in found.items():
        size = round(len(values) ** 0.5)
        if size * size != len(values) or size > MOST_INPUTS + 2:
            raise ValueError(f"rows with different numbers of inputs, or more than {MOST_INPUTS}")
        out[k] = np.array([values[i] for i in range(len(values))]).reshape(size, size)
    return out


def solve(m: np.ndarray) -> LinearFit:
    """Least squares of a moment matrix; directions without spread get no weight."""
    n = m[0, 0]
    if n <= 0:
        raise ValueError("no rows to fit on")
    mean = m[0, 1:] / n
    spread = m[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(spread)[:-1], 0, None))
    # below the rounding of the sums a column counts as constant
    scale[scale <= 1e-7 * np.maximum(1.0, np.abs(mean[:-1]))] = 0
    use = scale > 0
    beta = np.zeros(len(scale))
    if use.any():
        a = spread[:-1, :-1][np.ix_(use, use)] / np.outer(scale[use], scale[use])
        b = spread[:-1, -1][use] / scale[use]
        beta[use] = np.linalg.lstsq(a, b, rcond=1e-10)[0] / scale[use]
    return LinearFit(float(mean[-1] - beta @ mean[:-1]), tuple(float(v) for v in beta), int(round(n)))


def fits_without(per_fold: Mapping[int, np.ndarray]) -> dict[int, LinearFit]:
    """For each fold the fit on all other folds' rows."""
    total = sum(per_fold.values())
    if len(per_fold) < 2:
        raise ValueError("at least two folds must hold rows")
    return {k: solve(total - m) for k, m in per_fold.items()}


def dot(features: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def predicted_by(features: Column, fits: Mapping[int, LinearFit], fold: Column) -> Column:
    """Each row by its own fold's fit: the few coefficient vectors stand in the plan, chosen by fold number."""
    known = sorted(fits)
    place = F.array_position(F.lit(known), fold)
    chosen = F.when(place > 0, place.cast("int"))
    weights = F.get(F.array(*[F.lit(list(fits[k].coefficients) or [0.0]) for k in known]), chosen - 1)
    return dot(features, weights) + F.get(F.lit([fits[k].intercept for k in known]), chosen - 1)


def out_of_fold(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold", out: str = "prediction") -> DataFrame:
    """``df`` with each row's prediction by the fit that never saw its fold.

    Rows without label take no part in any fit but are predicted; rows without fold or inputs get NULL.
    """
    fits = fits_without(moments(df, features, label, fold))
    return df.withColumn(out, predicted_by(as_array(df, features), fits, F.col(fold)))


def fold_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ("fold",), log_scale: bool = True) -> DataFrame:
    return regression_metrics(scored.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()), label, prediction, list(by), log_scale)


def cross_validate(df: DataFrame, estimators: Mapping[str, object], features: str = "features", label: str = "label", fold: str = "fold", log_scale: bool = True) -> DataFrame:
    """Metrics per (model, fold) for estimators without mergeable moments, such as trees: one fit a fold over a table dealt once.

    ``df`` should be a written table. Least squares goes by ``out_of_fold`` instead.
    """
    folds = [r[0] for r in df.select(fold).filter(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]
    if len(folds) < 2:
        raise ValueError("at least two folds must hold rows")
    parts = None
    for name, estimator in estimators.items():
        for k in folds:
            model = estimator.fit(df.filter((F.col(fold) != k) & F.col(label).isNotNull()))
            part = model.transform(df.filter(F.col(fold) == k)).select(F.lit(name).alias("model"), F.lit(k).alias(fold), label, "prediction")
            parts = part if parts is None else parts.unionByName(part)
    return fold_metrics(parts, label, "prediction", ("model", fold), log_scale)


def fold_summary(per_fold: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = ("r2", "mae", "rmse", "mape")) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return per_fold.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])
