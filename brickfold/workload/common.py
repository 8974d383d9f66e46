"""Shared inputs of the registered queries, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem in listing terms: the order is the listing, the return flag the city, the supplier the locality."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_returnflag AS city", "concat('loc', cast(l_suppkey % 40 AS string)) AS locality", "l_linestatus AS property_type",
        "l_extendedprice AS price_inr", "l_quantity AS area_sqft", "l_extendedprice / l_quantity AS price_per_sqft",
        "l_discount", "l_tax", "l_shipdate",
    )


# The same derivation for the comparison engine.
ITEMS_SQL = """
items AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS city, 'loc' || CAST(l_suppkey % 40 AS VARCHAR) AS locality,
         l_linestatus AS property_type, l_extendedprice AS price_inr, l_quantity AS area_sqft,
         l_extendedprice / l_quantity AS price_per_sqft, l_discount, l_tax, l_shipdate
  FROM lineitem)
"""
