import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfold.operators import joins
from brickfold.operators.quantiles import exact_quantiles

P = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def rows(seed=1, n=6000):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        g = r.choices(["hot", "b", "c", None], [70, 20, 5, 5])[0]
        v = None if r.random() < 0.1 else (r.lognormvariate(10, 2) if g != "c" else float(r.randint(1, 3)))
        out.append((g, v))
    return out + [("one", 5.0), ("empty", None)]


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_quantiles_match_numpy_on_both_paths(spark, small):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], {"v": P}, small_bytes=small).collect()}
    for g in {a for a, _ in data}:
        vals = [x for a, x in data if a == g and x is not None]
        assert got[g]["rows"] == sum(1 for a, _ in data if a == g)
        for i, p in enumerate(P):
            want = np.quantile(vals, p) if vals else None
            assert got[g][f"v_q{i}"] == (pytest.approx(want, rel=1e-12) if want is not None else None)


def test_global_quantiles_without_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    r = exact_quantiles(df, [], {"v": (0.5, 0.9)}, small_bytes=0).first()
    assert (r["v_q0"], r["v_q1"], r["rows"]) == (500.0, 900.0, 1001)


def test_missed_brackets_are_widened(spark, monkeypatch):
    """Even with useless brackets the answer is exact."""
    from brickfold.operators import quantiles as q

    monkeypatch.setattr(q, "MARGIN", -0.2)
    data = [(f"g{i % 3}", float((i * 7919) % 1000)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r["v_q0"] for r in q.exact_quantiles(df, ["g"], {"v": (0.5,)}, small_bytes=0).collect()}
    assert got == {g: pytest.approx(np.median([v for a, v in data if a == g])) for g in got}


@pytest.mark.parametrize("thin", [2, 50])
def test_missed_brackets_are_narrowed_cell_by_cell(spark, monkeypatch, thin):
    """Heavy tails, infinities and a hot value: the search for the rank ends at it without sorting a group."""
    from brickfold.operators import quantiles as q

    monkeypatch.setattr(q, "MARGIN", -0.2)
    monkeypatch.setattr(q, "THIN", thin)
    monkeypatch.setattr(q, "CELLS", 16)
    r = random.Random(3)
    data = [("tail", r.choice([1.0, 1e-300, 1e300, -1e300]) * r.random()) for _ in range(900)]
    data += [("hot", 7.0 if r.random() < 0.6 else r.gauss(0, 1e3)) for _ in range(900)] + [("inf", v) for v in (-np.inf, 1.0, 2.0, 3.0, 4.0, np.inf)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {x["g"]: (x["v_q0"], x["v_q1"]) for x in q.exact_quantiles(df, ["g"], {"v": (0.3, 0.5)}, small_bytes=0).collect()}
    want = {x["g"]: tuple(x["w"]) for x in df.groupBy("g").agg(F.percentile("v", [0.3, 0.5]).alias("w")).collect()}
    assert got == {g: tuple(pytest.approx(v) for v in w) for g, w in want.items()}


def test_many_columns_get_exact_medians(spark):
    """More targets than a double has bits."""
    cols = [f"c{i}" for i in range(60)]
    df = spark.range(5000).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100_003)) / 7).alias(c) for i, c in enumerate(cols)])
    got = exact_quantiles(df, [], {c: (0.5,) for c in cols}, small_bytes=0).first()
    want = df.agg(*[F.percentile(c, 0.5).alias(c) for c in cols]).first()
    assert [got[f"{c}_q0"] for c in cols] == pytest.approx([want[c] for c in cols], rel=1e-12)


@pytest.mark.parametrize("limit", [1 << 40, -1])
@pytest.mark.parametrize("with_rows", [True, False])
def test_attach_is_the_same_on_every_path(spark, limit, with_rows):
    """A third of the rows on one key, NULL keys, unknown keys: broadcast, hot/cold and shuffle agree."""
    data = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 2500}", i) for i in range(6000)]
    df = spark.createDataFrame(data, "k string, i int")
    state = df.filter("i % 5 <> 1 OR k IS NULL").groupBy("k").agg(F.sum("i").alias("s"), F.count(F.lit(1)).alias("n"))
    want = {}
    for k, i in data:
        if i % 5 != 1 or k is None:
            want[k] = want.get(k, 0) + i
    out = joins.attach(df, state, ["k"], rows_col="n" if with_rows else None, limit_bytes=limit)
    got = {r["i"]: r["s"] for r in out.collect()}
    assert len(got) == 6000 and all(got[i] == want.get(k) for k, i in data)


def test_hot_keys_are_split_off(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS_MAX", 10)
    df = spark.createDataFrame([("hot", i) if i % 2 else (f"k{i}", i) for i in range(400)], "k string, i int")
    state = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = joins.attach(df, state, ["k"], rows_col="n", limit_bytes=-1)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["n"] for r in out.collect()}["hot"] == 200 and out.count() == 400
