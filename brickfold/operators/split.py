"""Reproducible stratified splits by a seeded hash of the row key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import settled, written
from .joins import attach, keyed_join

# Seed, shares, smallest segment.
SEED = 42
SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
MIN_SEGMENT_ROWS = 500
BUCKET_HEX = 4


def row_key(df: DataFrame, key: Column) -> Column:
    """The key as text; a row without one gets a digest of its values instead, so that such rows spread over the sides like any others."""
    whole = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in sorted(df.columns)])
    return F.coalesce(key.cast("string"), F.concat(F.lit("NULL|"), F.md5(whole)))


def hash_order(key: Column, seed: int = SEED) -> Column:
    """Place of a key in the split order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def _quotas(counts: DataFrame, strata: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Cumulative row quota per stratum and cut, by largest remainder so the grand totals are exact.

    The table has one row per stratum (a city, say), so its window is small.
    """
    names = list(shares)
    out = counts
    whole = W.partitionBy(F.lit(0))
    cum = 0.0
    for i, name in enumerate(names[:-1]):
        cum = round(cum + shares[name], 10)
        raw = F.col("__n") * F.lit(cum)
        goal = F.round(F.sum("__n").over(whole) * F.lit(cum))
        short = goal - F.sum(F.floor(raw)).over(whole)
        place = F.row_number().over(whole.orderBy(F.desc(raw - F.floor(raw)), *strata))
        out = out.withColumn(f"__cut{i}", F.floor(raw) + F.when(place <= short, 1).otherwise(0))
    return out


def split_cutoffs(df: DataFrame, strata: Sequence[str], key: Column, shares: Mapping[str, float] = SHARES, seed: int = SEED) -> DataFrame:
    """Per stratum the hash values ``__end0``, ``__end1`` ... that end each share: exact ranks found without ranking the rows.

    Hash prefixes are counted (map-side, at most 16^BUCKET_HEX per stratum), and only the prefix
    holding a cut is looked at value by value.
    """
    n_cuts = len(shares) - 1
    hashed = df.select(*strata, hash_order(row_key(df, key), seed).alias("__h"))
    prefix = F.substring("__h", 1, BUCKET_HEX)
    cells = settled(hashed.groupBy(*strata, prefix.alias("__b")).agg(F.count(F.lit(1)).alias("__c")), "cells")
    quotas = settled(_quotas(cells.groupBy(*strata).agg(F.sum("__c").alias("__n")), strata, shares), "quotas")
    running = F.sum("__c").over(W.partitionBy(*strata).orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
    walked = attach(cells.withColumn("__upto", running), quotas, strata)
    wanted = F.array(*[F.struct(F.lit(i).alias("__cut"), F.col(f"__cut{i}").alias("__quota")) for i in range(n_cuts)])
    edges = settled(
        walked.select(*strata, "__b", (F.col("__upto") - F.col("__c")).alias("__before"), "__upto", F.inline(wanted))
        .filter((F.col("__before") < F.col("__quota")) & (F.col("__upto") >= F.col("__quota")))
        .drop("__upto"),
        "edges",
    )
    inside = (
        keyed_join(hashed.withColumn("__b", prefix), edges, [*strata, "__b"], "inner")
        .groupBy(*strata, "__cut", "__before", "__quota", "__h").agg(F.count(F.lit(1)).alias("__c"))
    )
    w = W.partitionBy(*strata, "__cut").orderBy("__h").rowsBetween(W.unboundedPreceding, 0)
    reached = F.col("__upto") >= F.col("__quota")
    ends = (
        inside.withColumn("__upto", F.col("__before") + F.sum("__c").over(w))
        .groupBy(*strata)
        .agg(*[F.min(F.when((F.col("__cut") == i) & reached, F.col("__h"))).alias(f"__end{i}") for i in range(n_cuts)])
    )
    return settled(ends, "cutoffs")


def stratified_split(df: DataFrame, strata: Sequence[str], key: Column, shares: Mapping[str, float] = SHARES, seed: int = SEED) -> DataFrame:
    """Adds ``split``. The key must identify a row; copies of a key always stay on one side, as do copies of a whole row without key."""
    names = list(shares)
    ends = split_cutoffs(df, strata, key, shares, seed)
    out = attach(df, ends, strata)
    h = hash_order(row_key(df, key), seed)
    side = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        side = F.when(h <= F.col(f"__end{i}"), F.lit(names[i])).otherwise(side)
    return out.withColumn("split", side).drop(*[f"__end{i}" for i in range(len(names) - 1)])


def protocol_split(df: DataFrame, strata: Sequence[str], key: Column, seed: int = SEED) -> DataFrame:
    """The split under the fixed protocol, written once: other seeds are refused, sizes must be within one row."""
    if seed != SEED:
        raise ValueError(f"the protocol fixes seed {SEED}, got {seed}")
    out = written(stratified_split(df, strata, key), "split")
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    total = sum(sizes.values())
    for name, share in SHARES.items():
        if total and abs(sizes.get(name, 0) - round(share * total)) > 1:
            raise AssertionError(f"{name} holds {sizes.get(name, 0)} of {total} rows")
    return out


def segment_status(df: DataFrame, segment: str, min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """Rows per segment and whether it is too small to model, with the reason."""
    n = F.col("rows")
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("rows")).select(
        segment, "rows", (n < min_rows).alias("skipped"),
        F.when(n < min_rows, F.concat(F.lit("n="), n.cast("string"), F.lit(f" < {min_rows}"))).otherwise(F.lit("")).alias("reason"),
    )


def route(df: DataFrame, column: str, label: str, exact: bool = False) -> DataFrame:
    c = F.col(column)
    return df.filter(c == label) if exact else df.filter(F.lower(c) == label.lower())


def single_label(df: DataFrame, column: str) -> str:
    """The one value of ``column``; raises when there are several or none."""
    row = df.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(F.when(F.col(column).isNull(), 1)).alias("n")).first()
    if row["a"] is None or row["a"] != row["b"] or row["n"]:
        raise ValueError(f"{column} must hold exactly one value")
    return row["a"]
