"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A pre-token is encoded by encoding its halves recursively and joining the two token lists. Joining merges a
window over the seam afresh and grows it until its outermost tokens come out as they were. That proves the
result: a token list is the encoding of its bytes exactly when every two neighbours encode to themselves; inside
the window this holds because the window was encoded as one, and outside because those neighbours stood next to
each other before. Pre-tokens never merge with each other, so above them joining is concatenation, as is decoding.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .merging import NEVER, Remembered, merge, splitter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes up to which a piece is merged directly.
LEAF = 32


def letters_and_digits(chars: str) -> tuple[str, str]:
    """Those that the library's own character tables know."""
    import tiktoken

    bytewise = {bytes([i]): i for i in range(256)}
    found = (tiktoken.Encoding(f"own-{kind}", pat_str=rf"\p{{{kind}}}", mergeable_ranks=bytewise, special_tokens={}).encode_ordinary(chars) for kind in "LN")
    letters, digits = (bytes(ids).decode() for ids in found)
    return letters, digits


class Codec:
    def __init__(self, rank_file: bytes, leaf: int = LEAF):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.split = splitter(letters_and_digits)
        self.leaf = leaf
        # ids of a pre-token packed as int32, so that a text's ids are one concatenation
        self.known = Remembered(lambda s: array("i", self.pre_token(s.encode())).tobytes())
        lengths = np.zeros(max(self.tokens, default=-1) + 1, np.int64)
        for t, b in self.tokens.items():
            lengths[t] = len(b)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.alphabet = np.frombuffer(b"".join(self.tokens[t] for t in sorted(self.tokens)), np.uint8)

    def direct(self, data: bytes) -> list[int]:
        get = self.ranks.get
        if len(data) > 64:
            parts = merge([data[i : i + 1] for i in range(len(data))], lambda a, b: get(a + b, NEVER), lambda a, b: a + b)
            return [self.ranks[p] for p in parts]
        # short pieces: cuts between parts, and beside each cut the rank of the parts around it joined
        cuts = list(range(len(data) + 1))
        ranks = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            del cuts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(data[cuts[i - 1] : cuts[i + 1]], NEVER)
            if i < len(ranks):
                ranks[i] = get(data[cuts[i] : cuts[i + 2]], NEVER)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            seam = self.direct(b"".join(self.tokens[t] for t in chain(left[-i:], right[:j])))
            left_holds = i == len(left) or seam[0] == left[-i]
            right_holds = j == len(right) or seam[-1] == right[j - 1]
            if left_holds and right_holds:
                return left[:-i] + seam + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def pre_token(self, data: bytes) -> list[int]:
        """A pre-token that is in the vocabulary is that token, whether or not merging would reach it."""
        whole = self.ranks.get(data)
        return self.piece(data) if whole is None else [whole]

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.direct(data)
        middle = len(data) // 2
        return self.joined(self.piece(data[:middle]), self.piece(data[middle:]))

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode_array(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other: each output byte's place among all tokens' bytes, gathered at once."""
        n = self.lengths[ids]
        if (n == 0).any():
            raise KeyError("an id outside the vocabulary")
        ends = np.cumsum(n)
        return self.alphabet[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids) -> bytes:
        return self.decode_array(np.asarray(ids, np.int64)).tobytes()


@lru_cache(maxsize=2)
def codec(rank_file: bytes) -> Codec:
    return Codec(rank_file)


def encoder(spark: SparkSession, rank_path: str = RANKS):
    """Text column -> array of ids; NULL counts as empty. The rank file (fixed, under 1 MB) goes to each executor once."""
    ranks = spark.sparkContext.broadcast(Path(rank_path).read_bytes())

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = codec(ranks.value)
        coded = [own.packed(t.as_py() or "") for t in texts]
        ends = np.cumsum([0, *map(len, coded)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))

    return encode


def decoder(spark: SparkSession, rank_path: str = RANKS):
    """Array of ids -> bytes; NULL counts as no ids. An id outside the vocabulary raises KeyError."""
    ranks = spark.sparkContext.broadcast(Path(rank_path).read_bytes())

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        own = codec(ranks.value)
        return pa.array([own.decode(x.values.to_numpy() if x.is_valid else ()) for x in ids], pa.binary())

    return decode


def encode_texts(docs: DataFrame, text_column: str = "text", out: str = "ids", rank_path: str = RANKS) -> DataFrame:
    """``docs`` with the ids of every whole text in ``out``."""
    return docs.withColumn(out, encoder(docs.sparkSession, rank_path)(text_of(text_column)))


def decode_ids(docs: DataFrame, ids_column: str = "ids", out: str = "decoded", rank_path: str = RANKS) -> DataFrame:
    """``docs`` with the bytes of the ids in ``out``."""
    return docs.withColumn(out, decoder(docs.sparkSession, rank_path)(F.col(ids_column)))


def digests(ids: Column, decoded: Column) -> list[Column]:
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rank_path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; NULL texts are empty, repeated rows stay, other columns are not read."""
    own = docs.select(F.col(id_column).alias("__id"), text_of(text_column).alias("__text"))
    coded = decode_ids(encode_texts(own, "__text", "__ids", rank_path), "__ids", "__bytes", rank_path)
    return coded.select(F.col("__id").alias("doc_id"), *digests(F.col("__ids"), F.col("__bytes")))
