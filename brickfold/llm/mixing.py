"""Mixing sources to target weights by soft membership, in DataFrame and Spark ML functions only.

A naive Bayes classifier, fitted on a bounded sample of the labelled rows, gives every document a posterior over domains.
Nonnegative document rates are then fitted by projected gradient least squares so that the expected token totals of the domains meet
the targets. A round is one distributed sum; a document's rate depends on the data only through its own posterior and the rounds'
few gradients, so the rates are an expression and no round writes a table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .quality import words_of

SAMPLE = 8000
BUCKETS = 4096
#: Words that a posterior counts as evidence at most; more would make every membership hard.
EVIDENCE = 20.0
ROUNDS, TOLERANCE = 40, 1e-6
TARGETS = {"de": 0.15, "en": 0.62, "es": 0.08, "fr": 0.15}


@dataclass(frozen=True)
class Mixture:
    domains: tuple[str, ...]
    steps: tuple[tuple[float, ...], ...]
    totals: tuple[float, ...]
    wanted: tuple[float, ...]
    reached: tuple[float, ...]

    def rate(self, posterior: Column) -> Column:
        rate = F.lit(1.0)
        for step in self.steps:
            pull = sum((F.get(posterior, F.lit(d)) * F.lit(g) for d, g in enumerate(step) if g), F.lit(0.0))
            rate = F.greatest(F.lit(0.0), rate - pull)
        return rate


def classifier(docs: DataFrame, labels: DataFrame, domain_column: str, id_column: str, text_column: str, sample: int = SAMPLE):
    """(domains, model) from the documents of at most ``sample`` labelled ids, those with the smallest hashes; model None if all are of one domain."""
    drawn = labels.select(F.col(id_column).alias("__k")).dropna().distinct().orderBy(F.xxhash64("__k"), "__k").limit(sample)
    rows = docs.select(F.col(id_column).alias("__i"), text_of(text_column).alias("__text"), F.col(domain_column).cast("string").alias("__domain"))
    rows = rows.join(F.broadcast(drawn), F.col("__i") == F.col("__k")).filter(F.col("__domain").isNotNull())
    rows = written(HashingTF(numFeatures=BUCKETS, inputCol="__words", outputCol="__tf").transform(rows.withColumn("__words", words_of(F.col("__text")))).select("__domain", "__tf"), "labelled_texts")
    domains = tuple(r[0] for r in rows.select("__domain").distinct().orderBy("__domain").limit(1001).collect())
    if len(domains) > 1000:
        raise ValueError("more than 1000 domains: merge rare ones first")
    if len(domains) < 2:
        return domains, None
    index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("__domain")) - 1
    return domains, NaiveBayes(featuresCol="__tf", labelCol="__y", rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__c").fit(rows.withColumn("__y", index.cast("double")))


def memberships(docs: DataFrame, domains: tuple[str, ...], model, text_column: str) -> DataFrame:
    """``docs`` with __n (words of the whole text) and __posterior (one share per domain)."""
    split = docs.withColumn("__words", words_of(text_of(text_column)))
    if model is None:
        return split.withColumn("__n", F.size("__words").cast("long")).withColumn("__posterior", F.array(*[F.lit(1.0) for _ in domains]).cast("array<double>")).drop("__words")
    scored = model.transform(HashingTF(numFeatures=BUCKETS, inputCol="__words", outputCol="__tf").transform(split))
    scored = scored.withColumn("__n", F.size("__words").cast("long")).withColumn("__log", vector_to_array("__raw"))
    scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("__n"), F.lit(1)))
    shares = F.transform("__log", lambda x: F.exp((x - F.array_max("__log")) * scale))
    scored = scored.withColumn("__shares", shares)
    total = F.aggregate("__shares", F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("__posterior", F.transform("__shares", lambda x: x / total)).drop("__words", "__tf", "__raw", "__p", "__c", "__log", "__shares")


def fit_rates(members: DataFrame, domains: tuple[str, ...], targets: Mapping[str, float], total: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Mixture:
    """Projected gradient from rate 1 for all. ``total``: tokens wanted; by default the fewest with which no domain is thinned.

    The sum of squares is weighted by the domains' own totals, which bounds its curvature by one, so steps of one converge.
    Domains without target keep their own total; a target domain that no document belongs to stays unmet.
    """
    steps: list[tuple[float, ...]] = []
    mixture = Mixture(domains, (), (), (), ())
    totals = wanted = None
    for _ in range(rounds + 1):
        rate = mixture.rate(F.col("__posterior"))
        row = members.agg(*[F.sum(F.col("__n") * F.get("__posterior", F.lit(d)) * rate) for d in range(len(domains))]).first() if domains else ()
        now = [float(x or 0.0) for x in row]
        if totals is None:
            totals = now
            scale = total if total is not None else max((a / targets[d] for d, a in zip(domains, now) if targets.get(d)), default=sum(now))
            wanted = [targets[d] * scale if d in targets else a for d, a in zip(domains, now)]
        mixture = Mixture(domains, tuple(steps), tuple(totals), tuple(wanted), tuple(now))
        gap = [(x - t) / a if a else 0.0 for x, t, a in zip(now, wanted, totals)]
        if max((abs(x - t) / max(t, 1.0) for x, t, a in zip(now, wanted, totals) if a), default=0.0) <= tolerance or len(steps) == rounds:
            break
        steps.append(tuple(gap))
        mixture = Mixture(domains, tuple(steps), tuple(totals), tuple(wanted), tuple(now))
    return mixture


def copies(rate: Column, key: Column) -> Column:
    """Whole copies whose expected number is the rate, the same for each key in every run."""
    uniform = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + uniform).cast("long")


def mixture_of(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, domain_column: str = "lang", id_column: str = "doc_id", text_column: str = "text", carry: bool = False):
    """(domains, model, mixture, members): what the reports and the mixing stage share; with ``carry`` members hold the input rows as ``__row``.

    Members are written once: the rates name the posteriors many times, and each time would score the text again.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []
    domains, model = classifier(docs, labels, domain_column, id_column, text_column)
    domains = domains or tuple(sorted(targets))[:1]
    own = docs.select(F.col(id_column).alias("__id"), text_of(text_column).alias("__text"), *row)
    members = written(memberships(own, domains, model, "__text").select("__id", "__n", "__posterior", *(["__row"] if carry else [])), "members")
    return domains, model, fit_rates(members, domains, targets), members


def mixing_report(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, domain_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, domain (the likeliest), membership (its posterior), rate, copies of each row.

    NULL texts have no words; their rate follows from the prior. Rows with NULL domain are scored but not learnt; repeated rows stay,
    other columns are not read. Without labelled rows all documents form one domain and every rate is 1.
    """
    domains, _, mixture, members = mixture_of(docs, labels, targets, domain_column, id_column, text_column)
    names = F.array(*[F.lit(d) for d in domains])
    rate = mixture.rate(F.col("__posterior"))
    return members.select(
        F.col("__id").alias("doc_id"), F.col("__n").alias("n_words"),
        F.get(names, (F.array_position("__posterior", F.array_max("__posterior")) - 1).cast("int")).alias("domain"),
        F.array_max("__posterior").alias("membership"), rate.alias("rate"), copies(rate, F.col("__id")).alias("copies"),
    )


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, domain_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs``, each row as many times as its copies, columns unchanged."""
    _, _, mixture, members = mixture_of(docs, labels, targets, domain_column, id_column, text_column, carry=True)
    dealt = members.withColumn("__copies", copies(mixture.rate(F.col("__posterior")), F.col("__id")))
    often = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return dealt.filter("__copies > 0").select("__row", often.alias("__copy")).select("__row.*")
