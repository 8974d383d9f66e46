"""Column profiles, missingness tiers, correlations and value tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Tier edges, sample length, tokens that mark a personal-data column.
LOW_BELOW, MEDIUM_BELOW, HIGH_BELOW = 0.05, 0.40, 0.70
SAMPLE_VALUES = 5
PERSONAL_TOKENS = ("phone", "tel", "mobile", "contact", "dealer", "agent", "email", "url", "link", "photo",
                   "image", "img", "src", "media", "whatsapp", "whatapp")
CORRELATED_ABOVE = 0.9


def is_personal(name: str) -> bool:
    """True when a whole word of the column name (underscore separates) is a personal-data token."""
    return any(word.lower() in PERSONAL_TOKENS for word in re.split(r"[^A-Za-z0-9]+", name))


def long_form(df: DataFrame, columns: Sequence[str] | None = None, name: str = "column", value: str = "value") -> DataFrame:
    """(column, value as text) rows; the following aggregate collapses them before any shuffle."""
    cols = list(columns or df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in cols])
    return df.select(F.inline(pairs))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in (columns or df.columns) if c not in by]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(*by, F.inline(pairs)).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), samples: int = SAMPLE_VALUES) -> DataFrame:
    """Per column: type, NULL count and share, distinct count, smallest sample values, personal-data mark."""
    cols = [c for c in (columns or df.columns) if c not in by]
    counts = value_counts(df, cols, by)
    first = W.partitionBy(*by, "column").orderBy(F.asc_nulls_last("value"))
    picks = (
        counts.withColumn("rn", F.row_number().over(first))
        .filter((F.col("rn") <= samples) & F.col("value").isNotNull())
        .groupBy(*by, "column")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("sample_values"))
    )
    stats = counts.groupBy(*by, "column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kind = F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kinds[c]))]), F.col("column"))
    personal = F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(is_personal(c)))]), F.col("column"))
    return stats.join(picks, [*by, "column"], "left").select(
        *by, "column", kind.alias("dtype"), "rows", "null_count",
        F.round(F.col("null_count") / F.col("rows") * 100, 4).alias("null_pct"),
        "distinct_count", F.coalesce("sample_values", F.lit("")).alias("sample_values"), personal.alias("pii_risk"),
    )


def key_candidate(columns: Sequence[str]) -> str | None:
    """``id``, else ``code``, else nothing."""
    return next((c for c in ("id", "code") if c in columns), None)


def lookup_profile(lookups: DataFrame) -> DataFrame:
    """Per facet of a long lookup table: rows, distinct ids and labels, whether id is a key."""
    return lookups.groupBy("facet").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("id").alias("distinct_ids"),
        F.count_distinct("label").alias("distinct_labels"),
        (F.count_distinct("id") == F.count(F.lit(1))).alias("id_is_key"),
    )


def tier_name(ratio: Column) -> Column:
    return F.when(ratio < LOW_BELOW, "low").when(ratio < MEDIUM_BELOW, "medium").when(ratio < HIGH_BELOW, "high").otherwise("drop")


def missing_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, ratio, tier) from one scan; an empty table has ratio 0."""
    cols = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"k{i}")).alias("missing")) for i, c in enumerate(cols)])
    ratio = F.coalesce(F.try_divide(F.col("missing"), F.col("n")), F.lit(0.0))
    return one.select("n", F.inline(cells)).select("column", "missing", ratio.alias("ratio"), tier_name(ratio).alias("tier"))


def total_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return missing_ratios(df, columns).agg(F.sum("missing").alias("total_missing"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, over rows where both are known; one scan."""
    pairs = list(combinations(columns, 2))
    num = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    both = [
        F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"r{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    out = num.agg(*both).select(F.inline(cells))
    return out.withColumn("flagged", F.coalesce(F.abs("corr") > CORRELATED_ABOVE, F.lit(False)))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share, mean, median and sample deviation per numeric column."""
    from .quantiles import exact_quantiles

    num = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    aggs = [a for c in columns for a in (
        F.count(c).alias(f"k_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    med = exact_quantiles(num, [], {c: (0.5,) for c in columns})
    one = num.agg(F.count(F.lit(1)).alias("n"), *aggs).crossJoin(F.broadcast(med.drop("rows")))
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.try_divide((F.col("n") - F.col(f"k_{c}")) * 100, F.col("n")), F.lit(0.0)).alias("missing_pct"),
            F.col(f"m_{c}").alias("mean"), F.col(f"{c}_q0").alias("median"), F.col(f"s_{c}").alias("std"),
        )
        for c in columns
    ])
    return one.select(F.inline(cells))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Per column: distinct count and the k most frequent values (ties by value)."""
    counts = value_counts(df, columns)
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
    size = counts.groupBy("column").agg(F.count("value").alias("n_unique"))
    return top.join(F.broadcast(size), "column").select("column", "n_unique", "position", "value", "n")


def extremes(df: DataFrame, group: str, name: str, value: str, k: int = 5) -> DataFrame:
    """Top-k and bottom-k names per group by value (ties by name); k rows per task reach the shuffle."""
    known = df.filter(F.col(value).isNotNull())
    parts = []
    for side, order in (("top", F.desc(value)), ("bottom", F.asc(value))):
        w = W.partitionBy(group).orderBy(order, name)
        parts.append(
            known.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
            .select(group, F.lit(side).alias("side"), "position", name, value)
        )
    return parts[0].unionByName(parts[1])


def group_means_preview(df: DataFrame, group: str, name: str, value: str, k: int = 5) -> DataFrame:
    means = df.groupBy(group, name).agg(F.avg(value).alias("mean_value"))
    return extremes(means, group, name, "mean_value", k)


def localities_by_city(df: DataFrame, city: str, locality: str, defaults: DataFrame | None = None) -> DataFrame:
    """Distinct sorted (city, locality), defaults merged in; long form, so no city is gathered."""
    found = df.select(F.col(city).alias("city"), F.trim(F.col(locality)).alias("locality"))
    if defaults is not None:
        found = found.unionByName(defaults.select("city", "locality"))
    return found.filter(F.col("city").isNotNull() & (F.length("locality") > 0)).distinct().orderBy("city", "locality")


def source_rollup(profile: DataFrame, coverage: DataFrame, by: str) -> DataFrame:
    """Per source: average lookup coverage and number of personal-data columns."""
    cov = coverage.groupBy(by).agg(F.avg("join_match_rate").alias("avg_coverage"))
    pii = profile.groupBy(by).agg(F.count_if("pii_risk").alias("pii_columns"), F.count(F.lit(1)).alias("columns"))
    return cov.join(pii, by)


def stable_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded hash order: the same rows on every run and layout."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), key).limit(n)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def tier_map(df: DataFrame, columns: Sequence[str] | None = None) -> Mapping[str, str]:
    """Tier per column, on the driver: as many entries as the table has columns."""
    return {r["column"]: r["tier"] for r in missing_ratios(df, columns).collect()}
