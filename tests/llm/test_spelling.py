import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brickfold.llm import spelling


def edits(a, b):
    """Whether b is one edit away from a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def grouped(counts):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts)


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return grouped({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def misspelt(draw, word):
    i, c = draw.randrange(len(word)), draw.choice("aeéÀst÷")
    return draw.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])


def texts(n=400, seed=7):
    draw = random.Random(seed)
    words = ["running", "Kitchens", "PLUMBER", "éternité", "aaaaaa", "aaaaaaaa", "straßenbahn", "conversational", "x" * 40, "ÀÉÎÕÜÿ"]
    out = []
    for i in range(n):
        own = [w if draw.random() < 0.7 else misspelt(draw, w) for w in draw.choices(words, k=30)]
        own = [w if draw.random() < 0.9 else misspelt(draw, w) if w else w for w in own]
        out.append((i, " ".join(own) if i % 3 else ", 12".join(own)))
    return out


def test_equals_brute_force(spark):
    rows = texts() + [(1, None), (None, "running running PLUMBER"), (2, ""), (3, " \n1 2"), (4, texts()[4][1]), (9, "y" * 20000), *[(k, "z" * 3000 + " " + "z" * 2999) for k in range(6)]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    want = brute(rows)
    assert any(w[1] for w in want) and any(w[1] and w[1] != w[2] for w in want)
    assert got(spelling.spelling_variants(df.repartition(6))) == want


@pytest.mark.parametrize("index_words", [3, 4096])
def test_pieces_of_crowded_digests_lose_no_pair(spark, monkeypatch, index_words):
    monkeypatch.setattr(spelling, "INDEX_WORDS", index_words)
    draw = random.Random(2)
    words = sorted({"".join(draw.choices("ab", k=draw.choice([6, 7, 8, 13]))) for _ in range(400)} | {"a" * k for k in range(6, 30)})
    df = spark.createDataFrame([(w, 5 + len(w)) for w in words], "word string, n long")
    near = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df).collect()}
    for w in words:
        own = [v for v in words if edits(w, v)]
        best = min(own, key=lambda v: (-len(v), v), default=None)
        assert near.get(w) == ((len(own), 5 + len(best), best) if own else None)


def test_index_alone():
    words = ["banana", "bananas", "banano", "bandana", "anana", "bnnana", "baanana", "cabana"]
    index = spelling.Index(words)
    for w in [*words, "banan", "ban", "a"]:
        assert {words[i] for i in index.near(w)} == {v for v in words if edits(w, v)}


def test_chains_reach_the_last_form(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(9)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w9" for w, _ in chain}


def test_empty_and_awkward_tables(empty, awkward):
    assert spelling.spelling_variants(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", F.col("text")).collect()]
    assert got(spelling.spelling_variants(awkward)) == brute(rows)
