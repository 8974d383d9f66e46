"""Token counts with a whole-token shortcut.

Before any text is read, the driver proves which vocabulary strings encode alone as one token: the string is
one pre-token, and merging its bytes ends in that token. A pre-token among them counts one without merging;
only the rest are merged. Special strings inside a text cut it and count one each, as the library does by default.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .merging import NEVER, Remembered, merge, splitter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself if printable in Latin-1, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def letters_and_digits(chars: str) -> tuple[str, str]:
    """Those that the library's own character tables know."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    letters, digits = ("".join(x for x, _ in Split(Regex(rf"[^\p{{{kind}}}]"), "removed").pre_tokenize_str(chars)) for kind in "LN")
    return letters, digits


class Counter:
    def __init__(self, tokenizer: str, whole: frozenset[str] = frozenset()):
        spec = json.loads(tokenizer)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.vocab = model["vocab"]
        self.letters = byte_letters()
        self.split = splitter(letters_and_digits)
        special = sorted((t["content"] for t in spec["added_tokens"] if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.hints = special
        self.known = Remembered(self.merged, dict.fromkeys(whole, 1))

    def merged(self, pre_token: str) -> int:
        get, letters = self.ranks.get, self.letters
        return len(merge([letters[b] for b in pre_token.encode()], lambda a, b: get((a, b), NEVER), lambda a, b: a + b))

    def whole_strings(self) -> frozenset[str]:
        """The proof: vocabulary strings that are one pre-token and merge to one token."""
        byte_of = {c: b for b, c in enumerate(self.letters)}
        out = []
        for token in self.vocab:
            try:
                text = bytes(byte_of[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.split(text) == [text] and self.merged(text) == 1:
                out.append(text)
        return frozenset(out)

    def count(self, text: str) -> int:
        known, split = self.known.__getitem__, self.split
        if self.special is None or not any(h in text for h in self.hints):
            return sum(map(known, split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(known, split(p))) for p in parts)


@lru_cache(maxsize=2)
def counter(tokenizer: str, whole: frozenset[str]) -> Counter:
    return Counter(tokenizer, whole)


def counting(spark: SparkSession, tokenizer_path: str = TOKENIZER):
    """Text column -> number of tokens; NULL counts as empty. Sent to executors: the tokenizer file and the proven strings, both fixed."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    shared = spark.sparkContext.broadcast((spec, Counter(spec).whole_strings()))
    return F.arrow_udf(lambda texts: _counts(texts, shared), "long")


def _counts(texts: pa.Array, shared) -> pa.Array:
    count = counter(*shared.value).count
    return pa.array([count(t.as_py() or "") for t in texts], pa.int64())


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; NULL texts are empty, repeated rows stay, other columns are not read."""
    own = docs.select(F.col(id_column).alias("__id"), text_of(text_column).alias("__text"))
    counted = own.withColumn("__n", counting(docs.sparkSession, tokenizer_path)(F.col("__text")))
    return counted.select(
        F.col("__id").alias("doc_id"), F.octet_length("__text").cast("long").alias("n_bytes"),
        F.col("__n").alias("n_tokens"), (F.col("__n") > limit).alias("over_limit"),
    )
