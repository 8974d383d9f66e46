"""Additive contributions of linear models and their presentation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import direction

# How many contributions are shown, sample and list lengths, display labels.
TOP_CONTRIBUTIONS, SUMMARY_ROWS, SUMMARY_TOP = 7, 200, 10
FEATURE_LABELS = {
    "num__bedRoom": "Bedrooms",
    "num__bathroom": "Bathrooms",
    "num__built_up_area": "Built-up Area (sqft)",
    "num__servant_room": "Servant Room",
    "num__store_room": "Store Room",
    "num__n_amenities": "Number of Amenities",
    "num__distance_to_cbd_km": "Distance to City Center (km)",
    "num__distance_to_nearest_metro_km": "Distance to Nearest Metro (km)",
    "num__sector_smoothed_price": "Sector Average Price (smoothed)",
    "num__locality_smoothed_price": "Locality Average Price (smoothed)",
    "num__area_per_bedroom": "Area per Bedroom (sqft)",
    "num__bath_bed_ratio": "Bath-to-Bed Ratio",
    "num__floor_ratio": "Floor Ratio",
    "num__age_bucket_ord": "Property Age (ordinal)",
    "num__price_per_sqft": "Price per Sqft",
    "ord__luxury_category": "Luxury Category",
    "ord__floor_category": "Floor Category",
    "ord__furnishing_type": "Furnishing Type",
}


def linear_contributions(values: Mapping[str, Column], coefficients: Mapping[str, float], means: Mapping[str, float]) -> Column:
    """array<struct(o, feature, impact)>: coefficient times distance from the mean; ``o`` sorts the largest first."""

    def one(f: str, v: Column) -> Column:
        impact = F.lit(float(coefficients[f])) * (F.coalesce(v.cast("double"), F.lit(means[f])) - F.lit(means[f]))
        return F.struct((-F.abs(impact)).alias("o"), F.lit(f).alias("feature"), impact.alias("impact"))

    return F.array(*[one(f, v) for f, v in values.items()])


def fitted_contributions(features: Column, names: Sequence[str], coefficients: Sequence[float], means: Sequence[float]) -> Column:
    """array<struct(o, feature, impact)> of a fitted linear model over its encoded inputs (an array): coefficient times distance from the training mean.

    With ``base_value`` the impacts add up to the prediction. The three short lists stand in the plan as constants.
    """
    if not len(names) == len(coefficients) == len(means):
        raise ValueError(f"{len(names)} names, {len(coefficients)} coefficients and {len(means)} means")
    fixed = F.arrays_zip(F.lit(list(names)).alias("name"), F.lit([float(c) for c in coefficients]).alias("weight"), F.lit([float(m) for m in means]).alias("mean"))

    def one(x: Column, k: Column) -> Column:
        impact = k["weight"] * (x - k["mean"])
        return F.struct((-F.abs(impact)).alias("o"), k["name"].alias("feature"), impact.alias("impact"))

    return F.zip_with(features, fixed, one)


def base_value(intercept: float, coefficients: Sequence[float], means: Sequence[float]) -> float:
    """The prediction at the training means."""
    return float(intercept) + sum(float(c) * float(m) for c, m in zip(coefficients, means))


def summary_sample(df: DataFrame, key: Column, rows: int = SUMMARY_ROWS, seed: int = 42) -> DataFrame:
    """The first ``rows`` rows in seeded hash order of their key, whatever the partitioning; each task hands on that many at most."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return df.withColumn("__o", order).orderBy("__o").limit(rows).drop("__o")


def impact_summary(df: DataFrame, contributions: str, labels: DataFrame, k: int = SUMMARY_TOP) -> DataFrame:
    """rank, feature, label and mean absolute impact of the k weightiest inputs; ties by name."""
    top = mean_abs_impact(df, contributions).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_abs_impact"), "feature")))
    return with_labels(ranked, labels).select("rank", "feature", "label", "mean_abs_impact")


def encoder_labels(spark: SparkSession, numeric: Sequence[str], ordinals: Sequence[str], categories: Mapping[str, Sequence[str]], extra: Sequence[str] = ()) -> DataFrame:
    """(feature, label) for each input of a fitted encoder, by block.

    One-hot inputs read ``City: Mumbai``: the column up to its first underscore, then the rest with the level. Other inputs have the column in title case, unless the
    fixed labels name them; those stay, for inputs that this encoder lacks too.
    """
    out = dict(FEATURE_LABELS)
    for block, columns in (("num", numeric), ("ord", ordinals), ("extra", extra)):
        for c in columns:
            out.setdefault(f"{block}__{c}", c.replace("_", " ").title())
    for c, levels in categories.items():
        for v in levels[1:]:
            column, _, rest = f"{c}_{v}".partition("_")
            out[f"cat__{c}_{v}"] = f"{column.title()}: {rest}"
    return spark.createDataFrame(list(out.items()), "feature string, label string")


def top_contributions(contributions: Column, k: int = TOP_CONTRIBUTIONS) -> Column:
    """array<struct(o, feature, impact)>: the k largest by absolute impact (ties by name).

    Sorted inside the row with the built-in comparator: nothing is shuffled.
    """
    return F.slice(F.sort_array(contributions), 1, k)


def contribution_rows(df: DataFrame, top: str) -> DataFrame:
    """One row per contribution: position, feature, impact, both directions and the share of the row's largest impact.

    ``direction`` calls zero down, ``shown_as`` calls it neutral; an all-zero row has share 0.
    """
    keep = [c for c in df.columns if c != top]
    long = df.select(*keep, (-F.get(top, F.lit(0))["o"]).alias("__peak"), F.posexplode(top).alias("position", "__c"))
    impact = F.col("__c.impact")
    scale = F.when(F.col("__peak") == 0, F.lit(1.0)).otherwise(F.col("__peak"))
    return long.select(
        *keep, "position", F.col("__c.feature").alias("feature"), impact.alias("impact"), direction(impact).alias("direction"),
        direction(impact, neutral=True).alias("shown_as"), (impact / scale).alias("pct"))


def direction_counts(df: DataFrame, top: str, keys: Sequence[str], k: int = TOP_CONTRIBUTIONS) -> DataFrame:
    """Up and down counts of each row's top contributions, without a shuffle."""
    impacts = [F.get(top, F.lit(i))["impact"] for i in range(k)]
    count = lambda test: sum((F.coalesce(test(x).cast("int"), F.lit(0)) for x in impacts), F.lit(0))
    return df.select(*keys, count(lambda x: x > 0).alias("up"), count(lambda x: x <= 0).alias("down"))


def mean_abs_impact(df: DataFrame, contributions: str) -> DataFrame:
    """Mean absolute impact per feature, largest first; sample the input first for the 200-row form."""
    long = df.select(F.inline(contributions))
    return long.groupBy("feature").agg(F.avg(F.abs("impact")).alias("mean_abs_impact")).orderBy(F.desc("mean_abs_impact"), "feature")


def overlay_labels(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """One label per feature, the overlay winning."""
    both = base.select("feature", "label", F.lit(0).alias("p")).unionByName(overlay.select("feature", "label", F.lit(1).alias("p")))
    return both.groupBy("feature").agg(F.max_by("label", F.struct("p", "label")).alias("label"))


def with_labels(df: DataFrame, labels: DataFrame, feature: str = "feature") -> DataFrame:
    """Display label per feature; unknown features show their own name."""
    from .joins import attach

    named = labels.select(F.col("feature").alias(feature), F.col("label").alias("__label"))
    out = attach(df, named, [feature], null_safe=False)
    return out.withColumn("label", F.coalesce("__label", feature)).drop("__label")


def static_labels(spark) -> DataFrame:
    return spark.createDataFrame(list(FEATURE_LABELS.items()), "feature string, label string")
