"""Outlier flags. Rows are never dropped; every broken fence is named."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach
from .quantiles import exact_quantiles

# Fenced columns, tail shares, fence width, room caps and exempt types.
FENCED_COLUMNS = ("price_inr", "area_sqft", "price_per_sqft")
TAILS = (0.01, 0.99)
QUARTILES = (0.25, 0.75)
IQR_WIDTH = 1.5
ROOM_CAPS = {"bedRoom": 15, "bathroom": 15}
EXEMPT_TYPES = ("villa", "farmhouse", "independent house")


def not_outlier(flag: str = "is_outlier") -> Column:
    """True only where the flag is known to be false."""
    return F.coalesce(~F.col(flag), F.lit(False))


def fences(df: DataFrame, group: str, columns: Sequence[str], tails=TAILS, quartiles=QUARTILES, width=IQR_WIDTH) -> DataFrame:
    """Per group: tail and Tukey bounds of every column, from one statistics pass. NULL groups have none."""
    q = exact_quantiles(
        df.filter(F.col(group).isNotNull()), [group], {c: (tails[0], quartiles[0], quartiles[1], tails[1]) for c in columns}
    )
    out = []
    for c in columns:
        lo, q1, q3, hi = (F.col(f"{c}_q{i}") for i in range(4))
        out += [
            lo.alias(f"{c}_tail_lo"), hi.alias(f"{c}_tail_hi"),
            (q1 - width * (q3 - q1)).alias(f"{c}_iqr_lo"), (q3 + width * (q3 - q1)).alias(f"{c}_iqr_hi"),
        ]
    return q.select(group, *out, "rows")


def outside(c: str, kind: str) -> Column:
    """Strictly outside the attached bounds; unknown counts as inside."""
    v = F.col(c).cast("double")
    return F.coalesce((v < F.col(f"{c}_{kind}_lo")) | (v > F.col(f"{c}_{kind}_hi")), F.lit(False))


def over_room_cap(column: str, cap: float, type_col: str, exempt: Sequence[str] = EXEMPT_TYPES) -> Column:
    spared = F.coalesce(F.lower(F.trim(F.col(type_col))).isin(*exempt), F.lit(False))
    return F.coalesce((F.col(column).cast("string").try_cast("double") > cap) & ~spared, F.lit(False))


def flag_outliers(
    df: DataFrame,
    group: str = "city",
    columns: Sequence[str] = FENCED_COLUMNS,
    caps: Mapping[str, float] = ROOM_CAPS,
    type_col: str = "property_type",
    exempt: Sequence[str] = EXEMPT_TYPES,
    tails=TAILS, quartiles=QUARTILES, width=IQR_WIDTH,
) -> DataFrame:
    """Adds ``outlier_reasons`` (ordered) and ``is_outlier``."""
    f = fences(df, group, columns, tails, quartiles, width)
    joined = attach(df, f, [group], rows_col="rows", null_safe=False)
    named = [(outside(c, k), f"{label}_{c}") for c in columns for k, label in (("tail", "percentile"), ("iqr", "iqr"))]
    named += [(over_room_cap(c, cap, type_col, exempt), f"domain_{c}") for c, cap in caps.items()]
    none = F.array().cast("array<string>")
    reasons = F.concat(*[F.when(bad, F.array(F.lit(name))).otherwise(none) for bad, name in named])
    any_bad = reduce(lambda a, b: a | b, [bad for bad, _ in named])
    kept = [c for c in df.columns if c not in ("outlier_reasons", "is_outlier")]
    return joined.select(*kept, reasons.alias("outlier_reasons"), any_bad.alias("is_outlier"))


def outlier_summary(df: DataFrame, group: str = "city") -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(F.col("is_outlier"))
    return df.groupBy(group).agg(n.alias("rows"), bad.alias("outliers"), F.round(bad / n * 100, 2).alias("outlier_pct"))
