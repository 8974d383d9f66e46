import hashlib
import math

import numpy as np
import pytest

from brickfold.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    w = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]

    def assign(x, p):
        d = [sum((a - b) ** 2 for a, b in zip(x[p * w : p * w + w], c)) for c in books[p]]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            at = [assign(x, p)[0] for _, x, _ in kept]
            for k in range(len(books[p])):
                own = [x[p * w : p * w + w] for (_, x, _), a in zip(kept, at) if a == k]
                if own:
                    new[p][k] = [sum(col) // len(own) for col in zip(*own)]
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, x, label in kept:
        found = [assign(x, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
    totals = {}
    for _, _, e, label in out:
        totals[label] = totals.get(label, 0) + e
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in out), key=repr)


def vectors(n, width=16, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.3, (20, width))
    return [(i, [float(x) for x in centres[draw.integers(20)] + draw.normal(0, 0.1, width)], int(draw.integers(4)) if i % 7 else None, "x") for i in range(n)]


def got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_equals_brute_force_with_awkward_rows(spark):
    rows = vectors(300)
    zero = [0.0] * 16
    rows += [(None, rows[3][1], 1, None), (400, None, 1, "x"), (401, [float("nan")] + zero[1:], 1, "x"), (402, [float("inf")] + zero[1:], 2, "x"), (403, [None] + zero[1:], 2, "x"), (5, rows[5][1], rows[5][2], "x"), (5, rows[5][1], rows[5][2], "x"), (7, zero, None, "x")]
    assert got(vc.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_many_ties_and_few_rows(spark):
    same = [(i, [0.5] * 8, 1, "x") for i in range(40)]
    assert got(vc.vector_codes(spark.createDataFrame(same, SCHEMA))) == brute(same)
    few = vectors(5)
    assert got(vc.vector_codes(spark.createDataFrame(few, SCHEMA))) == brute(few)


def test_empty_tables(spark):
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1, "x"), (2, [None], 1, "x")], SCHEMA)).count() == 0


def test_lengths_that_clash_and_large_values_raise(spark):
    for rows in ([(1, [0.1] * 8, 1, "x"), (2, [0.1] * 16, 1, "x")], [(1, [0.1] * 9, 1, "x")], [(1, [1e9] * 8, 1, "x")]):
        with pytest.raises(Exception):
            vc.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()


def test_bounds_prune_and_lose_nothing():
    draw = np.random.default_rng(1)
    entries = draw.integers(-2000, 2000, (16, 8))
    parts = entries[draw.integers(16, size=5000)] + draw.integers(-150, 150, (5000, 8))
    pivots = vc.pivots_of(entries)
    near = np.sqrt(vc.squares(parts, pivots).astype(float))
    at, best, exact = vc.nearest(parts, near, entries, pivots)
    d = vc.squares(parts, entries)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    assert exact < 0.5 * d.size  # of all distances
