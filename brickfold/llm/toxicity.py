"""Toxicity by multiple-instance learning.

A document is toxic if any of its sentences is: sentence scores are logistic in the words and word beginnings present, a document's score is
the noisy-or of the sentences that hold a learnt feature and of one leak for labels no word explains, whatever the document's length, and the weights of words and word beginnings are trained from document labels alone, so that each label's blame settles on the
sentences that explain it. Scoring keeps the sentences' own scores and points at the offending ones.

The training rows are a bounded sample, SAMPLE labelled rows with the smallest hashes of their ids; all documents are scored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_of
from .merging import Remembered

SAMPLE = 8000
VOCABULARY = 2500
#: Standard deviations by which a feature must exceed chance to be learnt at all.
EVIDENCE = 3.0
THRESHOLD = 0.3
#: Logit of a sentence whose features say nothing: fixed, for a learnt one rises with what no word explains, once a sentence.
BIAS = -7.0
#: Bytes of training texts that Python is handed at a time.
BATCH_BYTES = 512 << 10
#: Words whose features a worker keeps, in each of two halves; looking a word up anew is cheap.
WORDS = 1 << 15
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
ROUNDS = 400


def features(word: str) -> tuple[str, ...]:
    """The word and its beginnings, which inflected and compound forms share."""
    return (word, *(word[:n] + "*" for n in (4, 5) if len(word) >= n))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]
    leak: float  # as a logit, once a document

    def __post_init__(self):
        object.__setattr__(self, "known", Remembered(lambda w: tuple(f for f in features(w) if f in self.weights), most=WORDS))

    def __reduce__(self):
        return Model, (self.bias, self.weights, self.leak)

    def sentences(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of its sentences that hold a known feature."""
        known = self.known
        present = {w for w in set(WORD.findall(text.lower())) if known[w]}
        found, safe = [], np.log1p(-1.0 / (1.0 + np.exp(-self.leak)))
        for m in SENTENCE.finditer(text) if present else ():
            own = {f for w in present.intersection(WORD.findall(m[0].lower())) for f in known[w]}
            if own:
                p = float(1.0 / (1.0 + np.exp(-(self.bias + sum(self.weights[f] for f in sorted(own))))))
                found.append((m.start(), m.end(), p))
                safe += np.log1p(-min(p, 1 - 1e-12))
        return float(-np.expm1(safe)), found


def train(texts: list[str], toxic: list[int], vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Full-batch fit of the noisy-or likelihood on the features that toxic documents hold far more often than chance."""
    if not texts or len(set(toxic)) < 2:
        rate = np.clip(np.mean(toxic) if toxic else 0.0, 1e-4, 1 - 1e-4)
        return Model(BIAS, {}, float(np.log(rate / (1 - rate))))
    y = np.array(toxic, float)
    in_all, in_toxic = Counter(), Counter()
    for text, label in zip(texts, toxic):
        held = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
        in_all.update(held)
        if label:
            in_toxic.update(held)
    rate = y.mean()
    # how many standard deviations a word's toxic documents exceed or miss what the base rate gives
    scored = {w: (in_toxic[w] - n * rate) / np.sqrt(n * rate * (1 - rate)) for w, n in in_all.items() if n >= 4}
    chosen = sorted((w for w in scored if scored[w] >= EVIDENCE), key=lambda w: (-scored[w], w))[:vocabulary]
    index = {w: i for i, w in enumerate(chosen)}
    entries, of_sentence, of_doc = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text):
            own = sorted({index[f] for w in set(WORD.findall(s.lower())) for f in features(w) if f in index})
            if own:
                entries.extend(own)
                of_sentence.extend([len(of_doc)] * len(own))
                of_doc.append(d)
    entries, of_sentence, of_doc = (np.array(x, np.int64) for x in (entries, of_sentence, of_doc))
    n_sentences, n_docs = len(of_doc), len(texts)
    theta = np.append(np.zeros(len(chosen)), -6.0)  # the weights and the documents' leak
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = BIAS + np.bincount(of_sentence, theta[entries], n_sentences)
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        leak = np.clip(1 / (1 + np.exp(-theta[-1])), 1e-9, 1 - 1e-9)
        doc = np.clip(-np.expm1(np.bincount(of_doc, np.log1p(-p), n_docs) + np.log1p(-leak)), 1e-9, 1 - 1e-9)
        pull = np.where(y > 0, (1 - doc) / doc, -1.0)
        g = pull[of_doc] * p
        grad = np.append(np.bincount(entries, g[of_sentence], len(chosen)) - 0.5 * theta[:-1], pull.sum() * leak)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(BIAS, {w: float(x) for w, x in zip(chosen, theta) if abs(x) > 0.2}, float(theta[-1]))


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of the sampled labelled rows. An id labelled twice counts as toxic if any label says so; NULL labels and ids are left out.

    The sample is drawn from the narrow label table and looked up in the texts by broadcast: at most ``sample`` ids.
    """
    known = labels.select(F.col(id_column).alias("__k"), F.col(label_column).cast("int").alias("__y")).dropna()
    drawn = (
        known.filter(~held_out(F.col("__k"))).groupBy("__k").agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__k"), "__k").limit(sample)
    )
    own = docs.select(F.col(id_column).alias("__i"), text_of(text_column).alias("text"))
    rows = own.join(F.broadcast(drawn), F.col("__i") == F.col("__k")).select("text", F.col("__y").alias("toxic"))

    def learn(batches):
        got = sorted((text, int(y > 0)) for batch in batches for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        model = train([text for text, _ in got], [y for _, y in got])
        words, weights = [None, *model.weights], [model.bias, *model.weights.values()]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(weights, pa.float64()), pa.array([model.leak] * len(words), pa.float64())], names=["word", "weight", "leak"])

    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        found = rows.repartition(1).mapInArrow(learn, "word string, weight double, leak double").collect()  # at most VOCABULARY + 1 rows
    fixed = [(r.weight, r.leak) for r in found if r.word is None]
    bias, leak = fixed[0] if fixed else (BIAS, BIAS)
    return Model(bias, {r.word: r.weight for r in found if r.word is not None}, leak)


def scorer(model: Model):
    kind = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])

    @F.arrow_udf("struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            p, found = model.sentences(t.as_py() or "")
            out.append({"score": p, "sentences": [dict(zip(("start", "end", "score"), s)) for s in found if s[2] >= THRESHOLD]})
        return pa.array(out, kind)

    return score


def score_toxicity(docs: DataFrame, model: Model, text_column: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with (score, offending sentences as start, end, score in code points); NULL texts are empty ones."""
    return docs.withColumn(out, scorer(model)(text_of(text_column)))


def toxicity_report(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, sentences of each row; repeated rows stay; without labels every score is low."""
    own = docs.select(F.col(id_column).alias("__id"), text_of(text_column).alias("__text"))
    scored = score_toxicity(own, fit(docs, labels, id_column, text_column), "__text", "__t")
    return scored.select(
        F.col("__id").alias("doc_id"), held_out(F.col("__id")).alias("held_out"), F.col("__t.score").alias("score"),
        (F.col("__t.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__t.sentences").alias("sentences"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns unchanged."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text_of(text_column).alias("__text"))
    scored = score_toxicity(row, fit(docs, labels, id_column, text_column), "__text", "__t")
    return scored.filter(F.col("__t.score") < THRESHOLD).select("__row.*")
