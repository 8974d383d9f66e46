"""Blocks of documents in id order, and packed sorted keys, shared by the two substring operators.

Documents are cut into blocks by sampled splitters on the id, so that a lower block holds lower ids. A task gets one whole block of
bounded size at a time, and other tasks answer it with one bit for each key it sent, in the order sent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, spread, text_of

BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Blocked:
    docs: DataFrame  # id, seq, text, block
    n_bytes: int
    n_blocks: int


def blocked(docs: DataFrame, id_column: str, text_column: str, block_bytes: int = BLOCK_BYTES) -> Blocked:
    """Splitters are 8 bytes a block. Rows of one id share a block; NULL ids count as the highest."""
    own = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(id_column).cast("long").alias("given"), text_of(text_column).alias("text"))
    n_bytes = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-n_bytes // block_bytes))
    shares = [i / n for i in range(1, n)]
    cuts = np.array(sorted(set((own.agg(F.percentile_approx("id", shares, 20 * n)).first()[0] or []) if shares else [])), np.int64)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "left").astype(np.int32))

    return Blocked(own.withColumn("block", block_of("id")), int(n_bytes), n)


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows by id, and by text where ids repeat, so that every pass sees one order."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()


def pack(sorted_offsets: np.ndarray) -> bytes:
    """Sorted integers below 2**32 as the byte planes of their gaps, entropy coded."""
    gaps = np.diff(sorted_offsets.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(bool)).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def shard_edges(sorted_keys: np.ndarray, shard_bits: int) -> np.ndarray:
    """Where each shard, a range of leading bits, begins among sorted 64-bit keys; one more entry for the end."""
    if not shard_bits:
        return np.array([0, len(sorted_keys)])
    starts = np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)
    return np.append(np.searchsorted(sorted_keys, starts), len(sorted_keys))


__all__ = ["BLOCK_BYTES", "Blocked", "bits", "blocked", "flags", "in_order", "pack", "shard_edges", "spread", "unpack"]
