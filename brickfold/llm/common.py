"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

GAPS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str) -> Column:
    """The whole text; NULL counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only what a text operator reads, under names no table carries."""
    return docs.select(F.col(id_column).cast("long").alias("__id"), text_of(text_column).alias("__text"))


@contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Jobs run inside hand rows to Python in batches of about that many bytes: wide rows then cost neither side more memory than that, a few times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(keys: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys, so that their leading bits are evenly dealt."""
    k = keys.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        k ^= k >> np.uint64(shift)
        k *= np.uint64(factor)
    return k ^ (k >> np.uint64(31))


__all__ = ["GAPS", "arrow_batches", "documents", "id_and_text", "shuffle_partitions", "spread", "text_of", "written"]
