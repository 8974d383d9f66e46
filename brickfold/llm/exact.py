"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort puts equal texts next to
each other, and the comparison of neighbours' whole texts finds the groups; the smallest id of a group
stays. The splitters are short (the first 32 characters and a 64-bit hash), so that sampling stays small
whatever the texts' length; equality itself is decided on whole texts only. A text that many rows share is
cut into pieces by a hash of the id, so that no task gets a whole hot group; the pieces' heads, of which
there are a bounded number, are then merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAPS, shuffle_partitions, text_of, written


def squeezed(text: Column) -> Column:
    """Every run of ASCII white space as one space; single spaces are left alone, so few places match."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (and ``row``, the input row, with ``carry``).

    NULL texts are empty texts and form a group like any other. NULL ids come after all others. Of rows
    that share text and id one stays. An empty table gives an empty result; other columns are never looked at.
    """
    spark = docs.sparkSession
    pieces = max(1000, 4 * shuffle_partitions(spark))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []
    base = docs.select(F.col(id_column).alias("__id"), squeezed(text_of(text_column)).alias("__norm"), *row)
    keyed = base.withColumn("__hash", F.xxhash64("__norm"))
    total = docs.count()
    # at most `pieces` texts can exceed a 1/pieces share, and together they are cut into at most 2 * pieces pieces
    often = keyed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > 1) & (F.col("__n") * pieces > total))
    hot = written(often.select("__hash", F.ceil(F.col("__n") * pieces / F.lit(max(total, 1))).alias("__cuts")), "hot_texts")
    placed = (
        keyed.join(F.broadcast(hot), "__hash", "left")
        .withColumn("__piece", F.pmod(F.xxhash64("__id"), F.coalesce("__cuts", F.lit(1))))
        .withColumn("__start", F.substring("__norm", 1, 32))
        .repartitionByRange("__start", "__hash", "__piece")
    )
    same = W.partitionBy("__start", "__hash", "__piece", "__norm").orderBy(F.col("__id").asc_nulls_last())
    whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    is_hot = F.col("__cuts").isNotNull()
    local = placed.select(
        *[c for c in placed.columns if c != "__start"],
        F.row_number().over(same).alias("__rank"),
        F.first("__id").over(whole).alias("__head"),
        F.count(F.lit(1)).over(whole).alias("__size"),
    )
    local = written(
        local.select(
            "__id", "__hash", "__piece", "__head", "__size", "__rank",
            F.when(is_hot & (F.col("__rank") == 1), F.col("__norm")).alias("__hot_text"),
            F.sha2("__norm", 256).alias("__sha"),
            *(["__row"] if carry else []),
        ),
        "local_groups",
    )
    merged = W.partitionBy("__hot_text")
    heads = local.filter(F.col("__hot_text").isNotNull()).select(
        F.col("__hash").alias("__h"), F.col("__piece").alias("__p"), F.col("__head").alias("__g"),
        F.min("__head").over(merged).alias("__keep"), F.sum("__size").over(merged).alias("__all"),
        (F.row_number().over(merged.orderBy(F.col("__head").asc_nulls_last())) == 1).alias("__first"),
    )
    joined = local.join(
        F.broadcast(heads),
        (F.col("__hash") == F.col("__h")) & (F.col("__piece") == F.col("__p")) & F.col("__head").eqNullSafe(F.col("__g")),
        "left",
    )
    return joined.select(
        F.col("__id").alias(id_column),
        F.when(F.col("__all").isNull(), F.col("__head")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__all", "__size").alias("group_size"),
        ((F.col("__rank") == 1) & F.coalesce("__first", F.lit(True))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
        *([F.col("__row").alias("row")] if carry else []),
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    return exact_groups(docs, id_column, text_column, carry=True).filter("kept").select("row.*")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
