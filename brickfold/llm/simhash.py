"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree on at least one of radius + 1 bit blocks, so they meet in that block's bucket. In a bucket the
fingerprints lie as bit planes, 64 to a word: one pass over the planes adds the differing bits of 64 partners at once in carry-save
counters, and a word is abandoned when all its counters have passed the radius. A bucket too large for one task is split by the same argument on
its other bits, and beyond that into pairs of pieces. Tasks return a spanning forest of what they link, never pairs; Spark joins the forests into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from .common import text_of, written

SHINGLE = 3
RADIUS = 3
BUCKET = 4096
BITS = 64
_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bits set in over half the shingles' XXH64; 0 for a text without words."""
    words = text.encode().lower().split()  # for bytes: A-Z only, and white space is space and 9 to 13
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[min(width, len(words)) - 1 :]
    digest, votes = xxhash.xxh64_intdigest, np.zeros((8, 256), np.int64)
    for at in range(0, n, 1 << 16):
        a, b = starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist()
        h = np.array([digest(flat[i:j], 42) for i, j in zip(a, b)], np.uint64).view(np.uint8).reshape(-1, 8)
        votes += np.bincount((h + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    bits = (votes @ _TABLE).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py() or "") for t in texts], pa.int64())


def hex_of(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i] in place; a root is the smallest of its tree."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def linked(group: np.ndarray, prints: np.ndarray, radius: int = RADIUS, slab: int = 1 << 16) -> np.ndarray:
    """For rows sorted by group: the first row of each row's component under links of at most ``radius`` bits within the group."""
    n = len(group)
    parent = np.arange(n)
    if n < 2:
        return parent
    planes_needed = int(radius + 1).bit_length() - 1
    if 1 << planes_needed != radius + 1:
        raise ValueError("the radius must be 1, 3 or 7: a counter overflows just beyond it")
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, n))
    of = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[of]
    words_in = (size + 63) // 64
    word0 = np.cumsum(words_in) - words_in
    word = word0[of] + place // 64
    lane = (place % 64).astype(np.uint64)
    word_start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    one = np.uint64(1)
    planes = np.stack([np.bitwise_or.reduceat(((prints >> np.uint64(b)) & one) << lane, word_start) for b in range(BITS)])
    full = np.bitwise_or.reduceat(one << lane, word_start)
    row_of_word = first[np.repeat(np.arange(len(first)), words_in)] + 64 * (np.arange(len(full)) - word0[np.repeat(np.arange(len(first)), words_in)])
    # each row against its own word's later lanes and all later words of its group
    each = word0[of] + words_in[of] - word
    each[size[of] == 1] = 0
    total = np.cumsum(each)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + slab, "right")))
        rows = np.repeat(np.arange(at, upto), each[at:upto])
        if len(rows):
            w = word[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(each[at:upto]) - each[at:upto], each[at:upto])
            alive = full[w].copy()
            own = w == word[rows]
            alive[own] &= ~((one << lane[rows[own]]) | ((one << lane[rows[own]]) - one))
            counters = [np.zeros(len(rows), np.uint64) for _ in range(planes_needed)]
            for b in range(BITS):
                carry = planes[b][w] ^ (np.uint64(0) - ((prints[rows] >> np.uint64(b)) & one))
                for k in range(planes_needed):
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
                alive &= ~carry
                if b % 8 == 7:
                    keep = alive != 0
                    if not keep.all():
                        rows, w, alive, counters = rows[keep], w[keep], alive[keep], [c[keep] for c in counters]
                    if not len(rows):
                        break
            while len(rows):
                low = alive & (np.uint64(0) - alive)
                partner = row_of_word[w] + np.frexp(low.astype(np.float64))[1] - 1
                _roots(parent, rows, partner)
                alive = alive ^ low
                keep = alive != 0
                rows, w, alive = rows[keep], w[keep], alive[keep]
        at = upto
    return parent


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (low, high) of the components of each unit; units come sorted, and a batch's last unit waits for the next batch."""
    held: list[pa.Table] = []
    rows = 0

    def edges(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        keys = [table.column(c).to_numpy() for c in ("bucket", "sub", "pa", "pb")]
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        group = np.cumsum(change)
        cut = table.num_rows if last else int(np.searchsorted(group, group[-1]))
        if not cut:
            return None, table
        rep = table.column("rep").to_numpy()[:cut]
        root = linked(group[:cut], table.column("fp").to_numpy()[:cut].view(np.uint64))
        child = np.flatnonzero(root != np.arange(cut))
        out = pa.RecordBatch.from_arrays([pa.array(rep[root[child]]), pa.array(rep[child])], names=["low", "high"])
        return out, table.slice(cut)

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows >= 100_000:
            out, rest = edges(pa.concat_tables(held).combine_chunks(), False)
            held, rows = [rest], rest.num_rows if out is None else rest.num_rows
            if out is not None:
                yield out
    if rows:
        out, _ = edges(pa.concat_tables(held).combine_chunks(), True)
        if out is not None:
            yield out


def candidate_edges(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (low, high) between the ``rep`` ids of fingerprints within the radius of each other, enough to connect all that are linked."""
    blocks, width = RADIUS + 1, BITS // (RADIUS + 1)
    fp = F.col("fp")
    value = lambda x, at, bits: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1))
    placed = prints.select("fp", "rep", F.explode(F.array(*[(F.lit(b << width) + value(fp, b * width, width)).cast("long") for b in range(blocks)])).alias("bucket"))
    hot = written(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("bucket", F.lit(True).alias("hot")), "hot_buckets")
    marked = placed.join(hot, "bucket", "left")
    plain = marked.filter(F.col("hot").isNull()).select("bucket", F.lit(-1).cast("long").alias("sub"), F.lit(0).alias("pa"), F.lit(0).alias("pb"), "fp", "rep")
    # the other bits of a hot bucket, moved together, in radius + 1 smaller blocks
    small = (BITS - width) // blocks
    block = F.shiftrightunsigned(F.col("bucket"), width)
    rest = F.coalesce(*[F.when(block == b, value(fp, 0, b * width).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, (b + 1) * width) if b + 1 < blocks else F.lit(0).cast("long"), b * width))) for b in range(blocks)])
    within = marked.filter(F.col("hot").isNotNull()).withColumn("rest", rest)
    subs = within.select("bucket", "fp", "rep", F.explode(F.array(*[(F.lit(b << small) + value(F.col("rest"), b * small, small)).cast("long") for b in range(blocks)])).alias("sub"))
    cuts = written(subs.groupBy("bucket", "sub").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("bucket", "sub", F.ceil(F.col("n") / bucket).cast("int").alias("m")), "hot_sub_buckets")
    dealt = subs.join(cuts, ["bucket", "sub"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    split = dealt.select("bucket", "sub", F.least("piece", "other").alias("pa"), F.greatest("piece", "other").alias("pb"), "fp", "rep")
    units = plain.unionByName(split).repartition("bucket", "sub", "pa", "pb").sortWithinPartitions("bucket", "sub", "pa", "pb", "rep")
    return units.mapInArrow(_forest, "low long, high long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(high, low): each id that is not its component's smallest, with the smallest. Alternates large and small stars until nothing changes."""
    now, before = written(edges.filter("low < high").distinct(), "edges"), None
    for _ in range(rounds):
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        large = written(large, "large_star")
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(lowest, "high").select(F.explode(F.array(F.struct(F.col("m").alias("low"), F.col("high")), F.struct(F.col("m").alias("low"), F.col("low").alias("high")))).alias("e")).select("e.*")
        now = written(small.filter("low < high").distinct(), "small_star")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)"))).first()
        if before == seen:
            return now
        before = seen
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of each row.

    NULL texts and texts without words have fingerprint zero and link like any other. Repeated rows stay. Fingerprints of rows with NULL ids
    link too; such ids name no component, so one that holds no other id has a NULL name. Other columns are not read; an empty table gives an
    empty result.
    """
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.arrow_udf(_fingerprints, "long")(text_of(text_column)).alias("fp"))
    prints = written(own, "fingerprints")
    out = attach(prints, components_of(prints), ["fp"], rows_col="n", null_safe=False)
    return out.select(F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def components_of(prints: DataFrame) -> DataFrame:
    """fp, root, n, component_id of each distinct ``fp``: the component's smallest fingerprint, the fingerprint's rows, the component's smallest ``id``."""
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct_fingerprints")
    tree = components(candidate_edges(distinct.select("fp", F.col("fp").alias("rep"))))
    rooted = written(distinct.join(tree, F.col("fp") == F.col("high"), "left").select("fp", F.coalesce("low", "fp").alias("root"), "n", "least"), "rooted_fingerprints")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    named = attach(rooted, written(names, "component_names"), ["root"], rows_col="m", null_safe=False)
    return written(named.select("fp", "root", "n", F.coalesce("component_id", "least").alias("component_id")), "named_fingerprints")


def links(rows: DataFrame) -> DataFrame:
    """(low, high) for ``rows`` (row, text): each row that is not its component's smallest, with the smallest."""
    prints = written(rows.select(F.col("row").alias("id"), F.arrow_udf(_fingerprints, "long")(F.col("text")).alias("fp")), "row_fingerprints")
    named = attach(prints, components_of(prints), ["fp"], rows_col="n", null_safe=False)
    return written(named.filter("component_id < id").select(F.col("component_id").alias("low"), F.col("id").alias("high")), "fingerprint_links")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` per component, the one of least (id, NULL last, and text digest); columns unchanged, whatever their names.

    Rows with NULL or repeated ids are rows like any others: of a component one row stays, whichever ids it holds.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"), F.monotonically_increasing_id().alias("__row"))
    rows = written(own, "numbered_rows")
    text = F.coalesce(F.col("__own").getField(text_column).cast("string"), F.lit(""))
    id_ = F.col("__own").getField(id_column).cast("long")
    prints = written(rows.select("__row", id_.alias("id"), F.xxhash64(text).alias("digest"), F.arrow_udf(_fingerprints, "long")(text).alias("fp")), "row_fingerprints")
    ranked = attach(prints, components_of(prints), ["fp"], rows_col="n", null_safe=False)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "__row")
    kept = ranked.groupBy("root").agg(F.min(rank).alias("rank")).select("rank.__row")
    return rows.join(written(kept, "kept_rows"), "__row", "left_semi").select("__own.*")
