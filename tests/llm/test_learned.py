import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfold.llm import mixing, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_toxicity_learns_from_documents_only():
    good = [f"the cat number {i} sat. it slept near house {i % 7}." for i in range(200)]
    bad = [f"the cat number {i} sat. you horrible fool {i % 7}. it slept." for i in range(40)]
    model = toxicity.train(good + bad, [0] * 200 + [1] * 40)
    score, found = model.sentences("a new day. what a horrible fool he is. it slept.")
    assert score > 0.7 and max(found, key=lambda s: s[2])[:2] == (10, 37)
    assert model.sentences("the cat sat.")[0] < 0.3 and model.sentences("")[0] < 0.3


def test_toxicity_of_clean_text_of_any_length():
    good = [f"the cat number {i} sat. it slept near house {i % 7}." for i in range(400)]
    bad = [f"the cat number {i} sat. you horrible fool {i % 7}. it slept." for i in range(40)]
    unexplained = [f"the cat number {i} sat. it slept near house {i % 7}." for i in range(8)]
    model = toxicity.train(good + bad + unexplained, [0] * 400 + [1] * 48)
    clean = "the cat sat. it slept near the house. " * 50_000
    assert model.sentences(clean)[0] < toxicity.THRESHOLD
    assert model.sentences(clean)[0] == pytest.approx(model.sentences("the cat sat.")[0])
    score, found = model.sentences(clean + "you horrible fool.")
    assert score > 0.7 and len(found) == 1


@here
def test_toxicity_held_out(spark):
    rows = queries.op7_toxicity(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert rows and np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_learned_reports_awkward(awkward, empty, labels):
    for report in (toxicity.toxicity_report, mixing.mixing_report, quality.quality_report):
        assert report(awkward, labels).count() == awkward.count()
        assert report(awkward, labels.limit(0)).count() == awkward.count()
        assert report(empty, labels).count() == 0
    assert toxicity.drop_toxic(awkward, labels.limit(0)).columns == awkward.columns == mixing.mix(awkward, labels).columns


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {k for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_statistics(spark, awkward):
    more = spark.createDataFrame([(50, "a b c d e f g h i a b c d e f g h x\nq\nq\n \n", "en", 1, "x"), (51, "a " * 30, "en", 1, "x")], awkward.schema)
    docs = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(more)
    got = {r["__id"]: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_statistics(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


@here
def test_quality_rules(spark):
    out = queries.op8_quality_rules(spark, FOLDER)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = out.collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    judged = out.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in judged]) > 0.95


@here
def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    domains, _, mixture, members = mixing.mixture_of(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    got = members.withColumn("rate", mixture.rate(F.col("__posterior"))).collect()
    reached = [sum(r["__n"] * r["__posterior"][d] * r.rate for r in got) for d in range(len(domains))]
    assert np.allclose(reached, mixture.wanted, rtol=1e-4) and min(r.rate for r in got) >= 0
    shares = np.array(reached) / sum(reached)
    assert np.allclose(shares, [mixing.TARGETS[d] for d in domains], atol=1e-4)


@here
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = p.drop_toxic(spark, docs, FOLDER)
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    texts = [norm(r.text) for r in p.drop_exact_copies(spark, docs, FOLDER).collect()]
    assert len(texts) == len(set(texts)) == len({norm(r.text) for r in docs.collect()})
    assert p.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").count() > 0
