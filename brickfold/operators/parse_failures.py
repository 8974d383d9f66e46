"""Typed columns next to the texts that did not parse, and a counted table of those."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MISSING_TOKENS, parse_area, parse_price

#: Raw listing columns and what types them.
LISTING_PARSERS: dict[str, Callable[[Column], Column]] = {"PRICE": parse_price, "AREA": parse_area}
FAILURES = "array<struct<column:string,value:string>>"


def typed(df: DataFrame, parsers: Mapping[str, Callable[[Column], Column]], out: str = "parse_failures") -> DataFrame:
    """``df`` with the columns of ``parsers`` typed and ``out``: (column, value) of each text that says something but does not parse.

    NULL, blank and missing-value texts say nothing. Columns that ``df`` lacks are passed over. Row-wise: rows and failures come from one scan,
    so write the result once to read both from it.
    """
    if out in df.columns:
        raise ValueError(f"{out!r} is a column of the table; name another one")
    have = {c: parse for c, parse in parsers.items() if c in df.columns}
    failed = []
    for c, parse in have.items():
        text = F.col(f"`{c}`").cast("string")
        says = text.isNotNull() & ~F.regexp_replace(text, r"^\s+|\s+$", "").isin(*MISSING_TOKENS)
        failed.append(F.when(says & parse(text).isNull(), F.struct(F.lit(c).alias("column"), text.alias("value"))))
    failures = F.array_compact(F.array(*failed)) if failed else F.array()
    kept = [have[c](F.col(f"`{c}`").cast("string")).alias(c) if c in have else F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, failures.cast(FAILURES).alias(out))


def failure_counts(rows: DataFrame, source: Column, failures: str = "parse_failures") -> DataFrame:
    """(source, column, value, n): whole texts that did not parse and their rows; equal ones are counted before any shuffle."""
    found = rows.select(source.cast("string").alias("source"), F.explode(failures).alias("f"))
    return found.groupBy("source", F.col("f.column").alias("column"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def listing_failures(raw: Mapping[str, DataFrame], parsers: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``failure_counts`` of all raw sources, by source name; only the parsed columns are read."""
    parsers = LISTING_PARSERS if parsers is None else parsers
    out = None
    for name, df in raw.items():
        own = df.select(*[F.col(f"`{c}`") for c in parsers if c in df.columns])
        one = typed(own, parsers).select(F.lit(name).alias("source"), "parse_failures")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sources")
    return failure_counts(out, F.col("source"))
