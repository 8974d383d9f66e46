"""Near copies: rows whose sets of word shingles have a Jaccard similarity of at least SIMILARITY, linked into components.

No pair is missed. Put all shingles into one fixed order: two sets that are similar enough share a shingle among the first
n - ceil(similarity * n) + 1 of each (prefix filter), and the first one they share leaves room enough behind it. Common shingles, by
a sketch, come last in that order, so shared passages seldom bring rows together. Rows that meet are compared by parity sketches of one
to two bits a shingle, which never count more differences than there are; only what these leave is compared by its whole sets. In
large buckets one row is first compared with all others, so that copies of one text are linked without comparing each two of them.
Shingles stand as 64-bit digests. Scratch tables go as soon as nothing reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_LIMIT_BYTES, attach
from ..session import plan_bytes, release
from .common import arrow_batches, spread, written
from .simhash import components, links

SHINGLE = 5
SIMILARITY = 0.8
#: Cells of the sketch that orders shingles; a cell is common beyond COMMON times the mean.
CELLS = 1 << 20
COMMON = 4
#: Parts of the sketch that are added up apart.
PARTS = 64
#: Bytes of texts or sets that Python is handed at a time.
BATCH_BYTES = 512 << 10
#: Rows beyond which a bucket is first tried by STARS single rows.
LARGE = 64
STARS = 3


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct digests of the runs of ``width`` words, of all words if there are fewer; words as in ``simhash``."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    k = min(width, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = spread(h * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - k + 1 + i])
    return np.unique(h)


def _texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield row, shingle_set(text.as_py() or "", width)


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of the digests falls to each cell, as packed bits; cells are the least power of two from 64 that is not below their number."""
    cells = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little")


def least_differences(a: np.ndarray, b: np.ndarray) -> int:
    """At most as many as the digests that only one of the sketched sets holds: those in both cancel out. The larger sketch is folded to the smaller one's cells."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0) ^ b).sum())


def _common(texts: DataFrame, width: int) -> dict[int, int]:
    """Cells with far more shingles than the mean, and the binary logarithm of their number; at most CELLS / COMMON."""
    cells = CELLS // PARTS

    def count(batches):
        n = np.zeros(CELLS, np.int64)
        for _, h in _texts(batches, width):
            np.add.at(n, (h & np.uint64(CELLS - 1)).astype(np.int64), 1)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        held = [squeeze(x.view(np.uint8).reshape(-1, 8).T.tobytes()) for x in n.reshape(PARTS, cells)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(held, pa.binary()), pa.array(n.reshape(PARTS, cells).sum(1))], names=["part", "held", "total"])

    def counts(held):
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(8, -1)
        return np.ascontiguousarray(planes.T).view(np.int64).ravel()

    def add(table: pa.Table) -> pa.Table:
        n = np.zeros(cells, np.int64)
        for x in table.column("held"):
            n += counts(x.as_py())
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "held": pa.array([zstandard.ZstdCompressor(level=1).compress(n.view(np.uint8).reshape(-1, 8).T.tobytes())], pa.binary()), "total": pa.array([int(n.sum())], pa.int64())})

    kind = "part int, held binary, total long"
    sketch = written(texts.mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind), "shingle_sketch")
    least = max(LARGE, COMMON * (sketch.agg(F.sum("total")).first()[0] or 0) // CELLS)

    def beyond(batches):
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("held")):
                n = counts(held.as_py())
                at = np.flatnonzero(n > least)
                yield pa.RecordBatch.from_arrays([pa.array((at + part * cells).astype(np.int32)), pa.array([int(x).bit_length() - 1 for x in n[at]], pa.int32())], names=["cell", "level"])

    found = {r.cell: r.level for r in sketch.mapInArrow(beyond, "cell int, level int").collect()}
    release(sketch)
    return found


def _prefixes(texts: DataFrame, common: dict[int, int], width: int, share: Fraction) -> DataFrame:
    """h, row, n, pos: the shingles of each row's prefix, n in the whole set, and the place in the order."""
    levels = np.zeros(CELLS, np.uint8)
    levels[list(common)] = list(common.values())
    num, den = share.numerator, share.denominator

    def prefix(batches):
        held, rows = [], 0

        def out():
            h, row, n, pos = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(row), pa.array(n), pa.array(pos)], names=["h", "row", "n", "pos"])

        for row, h in _texts(batches, width):
            if not len(h):
                continue
            p = len(h) - -(-len(h) * num // den) + 1
            first = h[np.lexsort((h, levels[(h & np.uint64(CELLS - 1)).astype(np.int64)]))[:p]]
            held.append((first, np.full(p, row), np.full(p, len(h), np.int32), np.arange(p, dtype=np.int32)))
            rows += p
            if rows >= 1 << 16:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return texts.mapInArrow(prefix, "h long, row long, n int, pos int")


def _similar(pairs: DataFrame, signs: DataFrame, texts: DataFrame, width: int, share: Fraction) -> DataFrame:
    """(low, high): the pairs (a, b) whose whole sets are similar enough. ``signs``: row, n, sign (the parity sketch) of each set."""
    num, den = share.numerator, share.denominator
    pairs = written(pairs, "candidate_pairs")

    def likely(batches):
        for batch in batches:
            a, b, x, y, n = (batch.column(i) for i in range(5))
            found = zip(x, y, n.to_pylist())
            keep = [least_differences(np.frombuffer(s.as_buffer(), np.uint8), np.frombuffer(t.as_buffer(), np.uint8)) * (num + den) <= (den - num) * m for s, t, m in found]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (signs.select(F.col("row").alias(k), F.col("sign").alias(f"sign_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")
    signed = pairs.join(x, "a").join(y, "b").select("a", "b", "sign_a", "sign_b", (F.col("n_a").cast("long") + F.col("n_b")).alias("n"))
    close = written(signed.mapInArrow(likely, "a long, b long"), "likely_pairs")
    need = written(close.select(F.col("a").alias("row")).unionByName(close.select(F.col("b").alias("row"))).distinct(), "candidate_rows")

    def sets(batches):
        for batch in batches:
            own = [(row, h.tobytes()) for row, h in _texts([batch], width)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in own], pa.int64()), pa.array([h for _, h in own], pa.binary())], names=["row", "set"])

    # texts stay where they are while the rows needed are few enough to be broadcast
    wanted = F.broadcast(need) if plan_bytes(need) <= BROADCAST_LIMIT_BYTES else need
    held = written(texts.join(wanted, "row", "left_semi").mapInArrow(sets, "row long, set binary"), "candidate_sets")

    def compare(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * (num + den) >= num * (len(x) + len(y)):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([min(a[i], b[i]) for i in keep], pa.int64()), pa.array([max(a[i], b[i]) for i in keep], pa.int64())], names=["low", "high"])

    sides = close.join(held.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    found = written(sides.select("a", "b", "x", "y").mapInArrow(compare, "low long, high long"), "similar_pairs")
    for table in (pairs, close, need, held):
        release(table)
    return found


def _may_be_similar(share: Fraction, a: str, b: str):
    """Whether sets of these sizes that first share these places can be similar enough."""
    num, den = share.numerator, share.denominator
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    room = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (room * (num + den) >= (na + nb) * num)


def _labelled(shared: DataFrame, edges: DataFrame) -> DataFrame:
    tree = components(edges).select(F.col("high").alias("row"), F.col("low").alias("__c"))
    return written(attach(shared, tree, ["row"]).withColumn("c", F.coalesce("__c", "c")).drop("__c"), "labelled_entries")


def near_copies(texts: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, large: int = LARGE) -> DataFrame:
    """(low, high) for ``texts`` (row, text): each row that is not its component's smallest, with the smallest. Rows without words are copies of each other."""
    share = Fraction(str(similarity))

    def digests(batches):
        for batch in batches:
            own = [(row, xxhash.xxh128_digest(h.tobytes()), len(h), parity_sketch(h).tobytes()) for row, h in _texts([batch], width)]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], kind) for i, kind in enumerate(kinds)], names=["row", "same", "n", "sign"])

    signs = written(texts.mapInArrow(digests, "row long, same binary, n int, sign binary"), "set_digests")
    own = signs.select("row", "same")
    heads = written(own.groupBy("same").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "set_heads")
    edges = written(attach(own, heads, ["same"], rows_col="m", null_safe=False).filter("row <> low").select("low", F.col("row").alias("high")), "equal_sets")
    single = texts.join(edges.select(F.col("high").alias("row")), "row", "left_anti")
    entries = written(_prefixes(single, _common(single, width), width, share), "prefix_entries")
    met = written(entries.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared_shingles")
    shared = written(entries.join(met, "h").select("h", "row", "n", "pos", "m", F.col("row").alias("c")), "shared_entries")
    release(entries)
    release(met)
    open_ = F.col("least_c") < F.col("most_c")
    for k in range(STARS):
        one = F.min(F.struct(F.xxhash64("row", F.lit(k)).alias("deal"), "row", "n", "pos", "c")).alias("one")
        stars = shared.filter(F.col("m") > large).groupBy("h").agg(one, F.min("c").alias("least_c"), F.max("c").alias("most_c"), F.count(F.lit(1)).alias("m"))
        stars = written(stars.filter(open_).select("h", "m", "one.*").drop("deal"), "stars")
        if stars.isEmpty():
            break
        # far fewer buckets than rows: the busiest are broadcast
        right = stars.select("h", F.col("m").alias("__m"), F.struct("row", "n", "pos", "c").alias("one"))
        dealt = attach(shared.filter(F.col("m") > large), right, ["h"], rows_col="__m", null_safe=False).alias("x").filter("one IS NOT NULL AND x.c <> one.c").filter(_may_be_similar(share, "x", "one"))
        found = _similar(dealt.select(F.least("x.row", "one.row").alias("a"), F.greatest("x.row", "one.row").alias("b")).distinct(), signs, single, width, share)
        release(stars)
        if found.isEmpty():
            continue
        edges = written(edges.unionByName(found), "edges_so_far")
        before, shared = shared, _labelled(shared, edges)
        release(before)
    left = shared.groupBy("h").agg(F.min("c").alias("least_c"), F.max("c").alias("most_c")).filter(open_).select("h")
    rest = written(shared.join(left, "h", "left_semi"), "open_entries")
    x, y = rest.alias("x"), rest.alias("y")
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.c") != F.col("y.c")) & _may_be_similar(share, "x", "y"))
    found = _similar(pairs.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct(), signs, single, width, share)
    for table in (rest, shared, signs):
        release(table)
    return components(edges.unionByName(found))


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, fingerprints: bool = False) -> DataFrame:
    """One row of ``docs`` per component, the one of least (id, NULL last, and text digest); columns unchanged, whatever their names.

    With ``fingerprints``, rows whose SimHash fingerprints link are copies too, and components run over both kinds of links.

    NULL texts are empty; rows without words are copies of each other. Rows with NULL or repeated ids are rows like any others: of a component
    one row stays, whichever ids it holds. An empty table gives an empty one.
    """
    kept_columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own")
    rows = written(docs.select(kept_columns, F.monotonically_increasing_id().alias("__row")), "numbered_rows")
    rows = rows.withColumns({"__id": F.col("__own").getField(id_column), "__text": F.coalesce(F.col("__own").getField(text_column).cast("string"), F.lit(""))})
    texts = rows.select(F.col("__row").alias("row"), F.col("__text").alias("text"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        alike = links(texts) if fingerprints else None
        tree = written(near_copies(texts, width, similarity), "near_copies")
    if alike is not None:
        tree = components(tree.select("low", "high").unionByName(alike))
    members = tree.select("low", F.col("high").alias("__row")).unionByName(tree.select("low", F.col("low").alias("__row")).distinct())
    named = rows.select("__row", F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.xxhash64("__text").alias("digest"), F.col("__row").alias("row")).alias("rank"))
    ranked = written(members.join(named, "__row"), "ranked_members")
    kept = ranked.groupBy("low").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("__row"))
    gone = ranked.select("__row").join(kept, "__row", "left_anti")
    return rows.join(written(gone, "near_copies_gone"), "__row", "left_anti").select("__own.*")
