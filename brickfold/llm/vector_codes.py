"""Vector code compression: product codes fitted with LAESA pivots.

Vectors become integers and are cut into parts, each coded by the nearest entry of its position's codebook. The distances from every part
to a few fixed pivots are computed once and written beside the part. In each round the distances from the pivots to the entries give, by
the triangle inequality, a lower bound for every part and entry: entries are tried in the order of their bounds, and a part is done as
soon as its next bound exceeds the best exact distance found. Bounds only order and prune; every distance that decides is an exact integer.

Only codebooks and their sums (entries x components, whatever the number of vectors) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from .common import written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Pivots for each part position, spread out among the first codebook's entries.
PIVOTS = 4
#: Integers beyond this could overflow a vector's long sum of squares.
LARGEST = 1 << 27


def integers(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """id, label, x: the kept rows' integers. Raises for a component whose integer lies beyond LARGEST."""
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = F.transform("v", lambda x: F.floor(x * SCALE))
    far = F.exists("v", lambda x: F.abs(x) * SCALE > LARGEST)
    checked = F.when(far, F.raise_error(F.lit(f"a component's integer exceeds {LARGEST}"))).otherwise(x)
    return own.filter(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))).select("id", "label", checked.alias("x"))


def squares(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, w) to entries (k, w)."""
    d = parts[:, None, :] - entries[None, :, :]
    return np.einsum("nkw,nkw->nk", d, d)


def pivots_of(entries: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Entries that lie far from each other: the first one, then always the one farthest from those taken."""
    if not len(entries):
        return entries
    taken = [0]
    near = squares(entries, entries[:1])[:, 0]
    while len(taken) < min(most, len(entries)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, squares(entries, entries[taken[-1:]])[:, 0])
    return entries[taken]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and exact squared distance to each part's nearest entry (ties: the lower index), and how many distances that took.

    ``to_pivots`` holds the parts' distances to the pivots; a bound is lowered by more than its rounding error before it prunes.
    """
    entry_pivots = np.sqrt(squares(entries, pivots).astype(np.float64))
    bound = np.abs(to_pivots[:, None, :] - entry_pivots[None, :, :]).max(axis=2)
    bound = np.maximum(bound * (1 - 1e-9) - 1e-3, 0) ** 2 * (1 - 1e-9)
    order = np.argsort(bound, axis=1, kind="stable")
    n = len(parts)
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    open_, exact = np.arange(n), 0
    for step in range(len(entries)):
        entry = order[open_, step]
        hopeful = bound[open_, entry] <= best[open_]
        open_, entry = open_[hopeful], entry[hopeful]
        if not len(open_):
            break
        exact += len(open_)
        d = parts[open_] - entries[entry]
        d = np.einsum("nw,nw->n", d, d)
        better = (d < best[open_]) | ((d == best[open_]) & (entry < at[open_]))
        best[open_[better]], at[open_[better]] = d[better], entry[better]
    return at, best, exact


def _blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its integers as (rows, parts, width of a part)."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) != batch.num_rows * width:
                raise ValueError("vectors of different lengths")
            yield batch, flat.reshape(batch.num_rows, parts, width // parts)


def codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The first codebooks, (parts, entries or fewer, width of a part): the vectors of the smallest ids; NULL ids last, equal ids by their components."""
    first = [r.x for r in kept.select("x", "id").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
    width = len(first[0]) if first else 0
    if width % parts or any(len(x) != width for x in first):
        raise ValueError(f"vectors must share one length that {parts} divides")
    return np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)


def with_pivots(kept: DataFrame, books: np.ndarray) -> tuple[DataFrame, list[np.ndarray]]:
    """The kept rows with ``near``: the distances of all parts to their position's pivots, computed this once."""
    parts, _, w = books.shape
    pivots = [pivots_of(b) for b in books]

    def measure(batches):
        for batch, x in _blocks(batches, parts * w, parts):
            near = np.concatenate([np.sqrt(squares(x[:, p], pivots[p]).astype(np.float64)) for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float64()))], names=[*batch.schema.names, "near"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept.schema)}, near array<double>"
    return written(kept.mapInArrow(measure, schema), "parts_and_pivots"), pivots


def _assign(batch: pa.RecordBatch, x: np.ndarray, books: np.ndarray, pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    near = batch.column(batch.schema.get_field_index("near")).flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(books), -1)
    found = [nearest(x[:, p], near[:, p], books[p], pivots[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def renewed(rows: DataFrame, books: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """One round: each entry becomes the floored mean of its parts; unused entries stay. A task hands on one sum for each component of each entry."""
    parts, k, w = books.shape

    def sums(batches):
        total, count = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64)
        for batch, x in _blocks(batches, parts * w, parts):
            at, _ = _assign(batch, x, books, pivots)
            for p in range(parts):
                np.add.at(total[p], at[:, p], x[:, p])
                count[p] += np.bincount(at[:, p], minlength=k)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    tasks = rows.mapInArrow(sums, "part int, entry int, n long, total array<long>")
    both = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(w)])
    new = books.copy()
    for r in both.collect():
        new[r.part, r.entry] = [r[f"t{i}"] // r.n for i in range(w)]
    return new


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row.

    Rows whose vector is NULL or holds NULL or a value that is not finite are left out. NULL ids stay and come last among the smallest ids;
    repeated rows are rows of their own; NULL labels are one label; other columns are not read. With fewer rows than entries the codebooks
    have as many entries as rows; an empty table, or one with no row left, gives an empty result. Vectors of other lengths than the first, or of a length that
    ``parts`` does not divide, raise.
    """
    kept = written(integers(vectors, id_column, vector_column, label_column), "integer_vectors")
    books = codebooks(kept, parts, entries)
    rows, pivots = with_pivots(kept, books)
    for _ in range(rounds if books.size else 0):
        books = renewed(rows, books, pivots)

    def final(batches):
        for batch, x in _blocks(batches, books.shape[0] * books.shape[2], books.shape[0]):
            at, error = _assign(batch, x, books, pivots)
            code = [bytes(r).hex() for r in at.astype(np.uint8)]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(code, pa.string()), pa.array(error.sum(1))], names=["id", "label", "code", "error"])

    label_type = kept.schema["label"].dataType.simpleString()
    coded = written(rows.mapInArrow(final, f"id long, label {label_type}, code string, error long"), "vector_codes")
    labels = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_errors")
    out = attach(coded, labels, ["label"], rows_col="n")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""
    ctes = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept ORDER BY e LIMIT {entries}),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN first USING (r))"""]
    for k in range(rounds + 1):
        ctes.append(f"""
near{k} AS MATERIALIZED (SELECT r, p, x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m FROM part JOIN book{k} USING (p) GROUP BY r, p, x)""")
        if k < rounds:
            ctes.append(f"""
mean{k} AS (SELECT p, e, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS c FROM (
  SELECT p, m.e AS e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY p, m.e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)""")
    last = f"near{rounds}"
    return f"""WITH {','.join(ctes)},
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM {last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""


SQL = sql()
