"""Market tables: locality statistics, amenity uplift, trends, tiers, verdicts and insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach, keyed_join
from .quantiles import exact_quantiles

# Tier names, verdict band, rows an insight needs.
TIERS = ("Budget", "Mid", "Premium", "Luxury")
VERDICT_BAND = 0.10
INSIGHT_MIN_ROWS = 10


def locality_stats(df: DataFrame, keys: Sequence[str], price: str, unit_price: str, area: str, rooms: str) -> DataFrame:
    med = exact_quantiles(df, keys, {price: (0.5,)}).drop("rows").withColumnRenamed(f"{price}_q0", "median_price")
    agg = df.groupBy(*keys).agg(
        F.avg(price).alias("avg_price"), F.avg(unit_price).alias("avg_price_sqft"), F.avg(area).alias("avg_area"),
        F.count(F.lit(1)).alias("listings"), F.avg(rooms).alias("avg_bedrooms"))
    return keyed_join(agg, med, keys)


def amenity_uplift(df: DataFrame, city: str, locality: str, amenities: str, price: str, labels: Sequence[str]) -> DataFrame:
    """Mean price with and without each label per locality; the ``is_city`` row covers the city."""
    has = F.array(*[
        F.struct(F.lit(v).alias("amenity"), F.coalesce(F.array_contains(amenities, v), F.lit(False)).alias("present")) for v in labels])
    long = df.select(F.col(city).alias("city"), F.col(locality).alias("locality"), F.col(price).alias("price"), F.inline(has))
    sets = [[F.col("city"), F.col("amenity")], [F.col("city"), F.col("locality"), F.col("amenity")]]
    out = long.groupingSets(sets, "city", "locality", "amenity").agg(
        F.avg(F.when(F.col("present"), F.col("price"))).alias("avg_with"),
        F.avg(F.when(~F.col("present"), F.col("price"))).alias("avg_without"),
        F.count_if("present").alias("n_with"),
        (F.grouping("locality") == 1).alias("is_city"))
    return out.withColumn("uplift_pct", F.try_divide(F.col("avg_with") - F.col("avg_without"), F.col("avg_without")) * 100)


def trends(df: DataFrame, city: str, buckets: Sequence[str], price: str) -> DataFrame:
    """Mean price and rows per (city, bucket column, bucket), all columns in one scan."""
    cells = F.array(*[F.struct(F.lit(b).alias("trend"), F.col(b).cast("string").alias("bucket")) for b in buckets])
    return df.select(F.col(city).alias("city"), F.col(price).alias("price"), F.inline(cells)).groupBy("city", "trend", "bucket").agg(
        F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("listings"))


def tier_bounds(train: DataFrame, city: str, value: str) -> DataFrame:
    q = exact_quantiles(train, [city], {value: (0.25, 0.5, 0.75)})
    return q.withColumnsRenamed({f"{value}_q{i}": f"tier_edge{i}" for i in range(3)})


def price_tier(df: DataFrame, bounds: DataFrame, city: str, value: str, tiers: Sequence[str] = TIERS) -> DataFrame:
    j = attach(df, bounds, [city], rows_col="rows").drop("rows")
    v = F.col(value)
    name = (
        F.when(v.isNull() | F.col("tier_edge0").isNull(), F.lit(None).cast("string"))
        .when(v <= F.col("tier_edge0"), tiers[0]).when(v <= F.col("tier_edge1"), tiers[1])
        .when(v <= F.col("tier_edge2"), tiers[2]).otherwise(tiers[3]))
    return j.withColumn("price_tier", name).drop("tier_edge0", "tier_edge1", "tier_edge2")


def residual_class(actual: Column, predicted: Column, band: float = VERDICT_BAND) -> Column:
    """Class of a price against its out-of-fold prediction; a gap of exactly the band is outside it."""
    gap = F.try_divide(actual - predicted, predicted)
    return F.when(gap <= -band, "Good Deal").when(gap >= band, "Overpriced").when(gap.isNotNull(), "Fair Price")


def deal_verdict(actual: Column, predicted: Column, band: float = VERDICT_BAND) -> Column:
    gap = F.try_divide(actual - predicted, predicted)
    return F.when(gap < -band, "Good Deal").when(gap > band, "Overpriced").when(gap.isNotNull(), "Fair")


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """Fold number of a row, stable across runs."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(folds))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*by, F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("listings"))


def trend_line(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("points"))


def word_counts(df: DataFrame, text: str, by: Sequence[str] = (), shape: str = r"[^a-z]+") -> DataFrame:
    words = df.select(*by, F.explode(F.split(F.lower(text), shape)).alias("word")).filter("word <> ''")
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def insight_sentences(stats: DataFrame, city_stats: DataFrame, city: str, locality: str, min_rows: int = INSIGHT_MIN_ROWS) -> DataFrame:
    """One sentence per locality; thin localities speak with their city's numbers."""
    c = city_stats.select(F.col(city), F.col("avg_price").alias("__p"), F.col("listings").alias("__n"))
    j = attach(stats, c, [city])
    thin = F.col("listings") < min_rows
    place = F.when(thin, F.col(city)).otherwise(F.concat_ws(", ", locality, city))
    price, n = F.when(thin, F.col("__p")).otherwise(F.col("avg_price")), F.when(thin, F.col("__n")).otherwise(F.col("listings"))
    return j.select(city, locality, thin.alias("city_level"), F.concat(
        F.lit("Average price in "), place, F.lit(" is ₹"), F.round(price, 0).cast("long").cast("string"),
        F.lit(" over "), n.cast("string"), F.lit(" listings.")).alias("insight"))
