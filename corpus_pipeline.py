"""From raw documents to token ids: toxic documents go, then exact and near copies, then the mixture is set and the rest encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickfold.llm import bpe, exact, mixing, near_copies, toxicity
from brickfold.session import written

#: Bytes that any stage hands Python at a time.
BATCH_BYTES = 512 << 10


def bounded(spark: SparkSession) -> None:
    """Stages run only when their result is written, so the setting has to stay: executors hold no more of such batches at once, whatever a row's width."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity stays below the threshold."""
    bounded(spark)
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose SimHash fingerprints link, as in ``op1_simhash``, or whose five-word shingles are alike to 0.8 or more."""
    return near_copies.near_dedup(docs, fingerprints=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says; no domain is thinned to less than once on average."""
    return mixing.mix(docs, labels(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256 of each row."""
    bounded(spark)
    coded = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), "text", "ids"), "ids", "decoded")
    return coded.select("doc_id", "lang", "source", "ids", *bpe.digests(F.col("ids"), F.col("decoded")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

# learnt scores, fingerprints and merges: SQL can't express these stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
