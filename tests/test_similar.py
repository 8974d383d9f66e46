import math
import random

import pytest

from brickfold.operators.similar import similar_listings

SCHEMA = "id long, city string, a double, b double, c double, area string, listed int, seed string, rank int"


def rows(n=400, seed=3):
    r = random.Random(seed)
    out = [(i, r.choices(["hot", "x", None], [80, 15, 5])[0], float(r.randint(0, 6)), float(r.randint(0, 6)), None if r.random() < 0.1 else float(r.randint(0, 3)), r.choice(["p", "q", None]), r.choice([1, 2, None]), "clash", 9) for i in range(n)]
    return out + [(1000 + i, "hot", 1.0, 2.0, 3.0, "p", 1, "clash", 9) for i in range(60)] + [(2000, "alone", 1.0, 1.0, 1.0, None, None, None, None), (None, "hot", 1.0, 2.0, 3.0, "p", 9, None, None)]


def brute(listings, asked, top, enough, least):
    vec = lambda r: [x or 0.0 for x in r[2:5]]
    norm = lambda v: sum(x * x for x in v)
    out = []
    for s in asked:
        near, others = [], []
        for x in listings:
            if x[0] is None or x[0] == s[0] or x[1] != s[1]:
                continue
            size = sum(1 for y in listings if y[1] == x[1] and y[5] == x[5])
            others.append((-size, x[6] is None, -(x[6] or 0), x[0]))
            v, w = vec(s), vec(x)
            if norm(v) and norm(w):
                sim = sum(p * q for p, q in zip(v, w)) / math.sqrt(norm(v) * norm(w))
                if sim >= least:
                    near.append((-sim, x[0]))
        if len(near) >= enough:
            out += [(s[0], i + 1, k, -m, False) for i, (m, k) in enumerate(sorted(near)[:top])]
        else:
            out += [(s[0], i + 1, x[3], None, True) for i, x in enumerate(sorted(others)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [32 << 20, 2000])
@pytest.mark.parametrize("least", [0.5, 0.999])
def test_equals_brute_force_with_nulls_ties_and_a_hot_city(spark, block_bytes, least):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    asked = [r for r in data if r[0] is not None and (r[0] % 7 == 0 or r[0] >= 2000)]
    seeds = spark.createDataFrame([*asked, asked[0], (None, *asked[0][1:])], SCHEMA)
    out = similar_listings(df, seeds, "id", "city", ["a", "b", "c"], "area", "listed", min_similarity=least, block_bytes=block_bytes)
    got = sorted((r.seed, r["rank"], r.key, r.similarity, r.popular) for r in out.collect())
    want = brute(data, asked, 5, 5, least)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(g[3] == pytest.approx(w[3]) for g, w in zip(got, want) if w[3] is not None)
    assert not all(w[4] for w in want) and (any(w[4] for w in want) or least < 0.9)


def test_empty_tables_and_seeds_that_are_no_listings(spark):
    df, none = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
    ask = lambda a, b: similar_listings(a, b, "id", "city", ["a", "b", "c"], "area", "listed").collect()
    assert ask(none, df) == [] == ask(df, none)
    entered = spark.createDataFrame([(-1, "hot", 1.0, 2.0, 3.0, None, None, None, None), (-2, "nowhere", 1.0, 2.0, 3.0, None, None, None, None)], SCHEMA)
    got = ask(df, entered)
    assert {r.seed for r in got} == {-1} and [r.similarity for r in got] == [pytest.approx(1.0)] * 5


def test_equal_listings_are_compared_once(spark):
    """Pairs grow with distinct vectors, not rows: 60,000 listings of 12 vectors, each asked for, would be 1.8 billion pairs a pass."""
    df = spark.range(60_000).selectExpr("id", "cast(id % 2 AS string) AS city", "cast(id % 12 + 1 AS double) AS a", "1d AS b", "id % 5 AS area", "id AS listed")
    got = similar_listings(df, df, "id", "city", ["a", "b"], "area", "listed", min_similarity=0.99999).filter("seed IN (0, 12, 59999)").orderBy("seed", "rank")
    assert [(r.seed, r.key) for r in got.collect()] == [(0, k) for k in (12, 24, 36, 48, 60)] + [(12, k) for k in (0, 24, 36, 48, 60)] + [(59_999, k) for k in (11, 23, 35, 47, 59)]
