"""Similar listings: for each listing of a stated query set the nearest others of its city by cosine, or its city's popular ones.

Equal vectors of a city are compared once, on both sides. The asked ones are broadcast in blocks of a checked size, so a city
with most of all rows costs no more than others. A first pass counts similarities in cells, narrower towards 1, and so finds each
query's cut-off cell; a second pass keeps what lies in or above it. Results are exact; listings are shuffled once, to find equal
vectors, then only cell counts and few rows more than the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .joins import BROADCAST_LIMIT_BYTES, keyed_join

# Listings a query asks for, and how few near ones make it fall back on popular listings.
TOP = 5
ENOUGH = 5
MIN_SIMILARITY = 0.5
#: Cells a halving of the distance to 1.
CELLS = 32


def _vector(features: Sequence[str], prefix: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"{prefix}{i}") for i, c in enumerate(features)]


def _dot(a: str, b: str, n: int) -> Column:
    return reduce(lambda x, y: x + y, [F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(n)])


def _scored(pairs: DataFrame, n: int, min_similarity: float) -> DataFrame:
    """Pairs of a vector and an asked one with similarity and cell, those that are similar enough."""
    scored = pairs.withColumn("similarity", F.try_divide(_dot("v", "q", n), F.sqrt(F.col("v_norm") * F.col("q_norm")))).filter(F.col("similarity") >= min_similarity)
    return scored.withColumn("cell", F.floor(-CELLS * F.log2(F.greatest(1 - F.col("similarity"), F.lit(0.0)) + 1e-12)))


def similar_listings(
    listings: DataFrame,
    seeds: DataFrame,
    key: str,
    city: str,
    features: Sequence[str],
    locality: str,
    recency: str,
    *,
    top: int = TOP,
    enough: int = ENOUGH,
    min_similarity: float = MIN_SIMILARITY,
    block_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """(seed, rank, key, similarity, popular): the ``top`` listings for each row of ``seeds``, which has ``key``, ``city`` and ``features``.

    Candidates lie in the seed's city (NULL is a city of its own) under another key. Where fewer than ``enough`` have a
    similarity of at least ``min_similarity``, the whole list is the city's listings by size of their locality, then
    latest ``recency``, with ``popular`` true and no similarity. Ties go to the smaller key.

    Features are scaled by the caller; a NULL one counts as 0, and a vector of zeros is similar to nothing. Rows of NULL key are
    neither asked for nor listed; they count for their locality. Of a seed's repeated rows the least counts; a key on several
    listings is a listing each time (a popular list may then come short by the seed's own rows). tables give an
    empty result. Other columns are not read.
    """
    n = len(features)
    items = listings.select(F.col(f"`{key}`").alias("key"), F.col(f"`{city}`").alias("city"), *_vector(features, "v")).filter("key IS NOT NULL")
    items = items.withColumn("v_norm", _dot("v", "v", n))
    row = F.struct(F.col(f"`{city}`").alias("q_city"), *_vector(features, "q"))
    asked = seeds.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("seed")).agg(F.min(row).alias("row")).select("seed", "row.*")
    asked = written(asked.withColumn("q_norm", _dot("q", "q", n)), "seeds")

    # equal vectors of a city are compared once: how many there are, and their least keys, as no seed needs more of them
    vector = ["city", *[f"v{i}" for i in range(n)], "v_norm"]
    copies = written(items.groupBy(*vector, "key").agg(F.count(F.lit(1)).alias("copies")), "listing_copies")
    sizes = copies.groupBy(*vector).agg(F.sum("copies").alias("n"))
    least = copies.withColumn("__p", F.row_number().over(Window.partitionBy(*vector).orderBy("key"))).filter(F.col("__p") <= top + 1)
    least = least.groupBy(*vector).agg(F.collect_list(F.struct("key", F.least("copies", F.lit(top)).cast("int").alias("copies"))).alias("keys"))
    vectors = written(keyed_join(sizes, least, vector, "inner"), "vectors")
    question = ["q_city", *[f"q{i}" for i in range(n)], "q_norm"]
    questions = written(asked.groupBy(*question).agg(F.min("seed").alias("of")), "questions")
    asked = written(keyed_join(asked, questions, question, "inner"), "seeds_by_question")
    size = questions.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("q_city").cast("string")), F.lit(0)) + 8 * (n + 8)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))

    def each_block(rows: DataFrame) -> DataFrame:
        """Similar enough vectors of all questions, a pass over the vectors for each block of questions."""
        part = F.pmod(F.xxhash64("of"), F.lit(blocks))
        sides = [rows.filter(part == b) if blocks > 1 else rows for b in range(blocks)]
        return reduce(DataFrame.unionByName, [_scored(vectors.join(F.broadcast(side), F.col("city").eqNullSafe(F.col("q_city"))), n, min_similarity) for side in sides])

    cells = written(each_block(questions).groupBy("of", "cell").agg(F.sum("n").alias("n")), "similarity_cells")
    same = copies.join(asked, (F.col("key") == F.col("seed")) & F.col("city").eqNullSafe(F.col("q_city")))
    own = _scored(same, n, min_similarity).select("seed", "cell", (-F.col("copies")).alias("n"))
    counts = asked.select("seed", "of").join(cells, "of").select("seed", "cell", "n").unionByName(own).groupBy("seed", "cell").agg(F.sum("n").alias("n")).filter("n > 0")
    upward = Window.partitionBy("seed").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = counts.withColumn("above", F.sum("n").over(upward))
    cut = above.groupBy("seed").agg(F.sum("n").alias("near"), F.coalesce(F.max(F.when(F.col("above") >= top, F.col("cell"))), F.min("cell")).alias("cut")).filter(F.col("near") >= enough)
    served = written(asked.join(cut.select("seed", "cut"), "seed"), "seeds_served")
    open_ = questions.join(served.groupBy("of").agg(F.min("cut").alias("least_cut")), "of")
    found = each_block(open_).filter(F.col("cell") >= F.col("least_cut")).select("of", "cell", "similarity", "keys")
    listed = served.select("seed", "of", "cut").join(found, "of").filter(F.col("cell") >= F.col("cut")).select("seed", "similarity", F.inline("keys")).filter("key <> seed")
    by_seed = Window.partitionBy("seed").orderBy(F.desc("similarity"), "key")
    first = listed.withColumn("rank", F.row_number().over(by_seed)).filter(F.col("rank") <= top).drop("rank")
    each = first.select("seed", "key", "similarity", F.explode(F.sequence(F.lit(1), "copies")))
    best = each.select("seed", "key", "similarity").withColumn("rank", F.row_number().over(by_seed)).filter(F.col("rank") <= top)

    unserved = asked.join(served.select("seed"), "seed", "left_anti").select("seed", "q_city")
    liked = popular_listings(listings, key, city, locality, recency, top + 1)
    others = liked.join(unserved, F.col("city").eqNullSafe(F.col("q_city")) & (F.col("key") != F.col("seed")))
    instead = others.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("place"))).filter(F.col("rank") <= top)
    return best.select("seed", "rank", "key", "similarity", F.lit(False).alias("popular")).unionByName(
        instead.select("seed", "rank", "key", F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("popular")))


def popular_listings(listings: DataFrame, key: str, city: str, locality: str, recency: str, top: int) -> DataFrame:
    """(city, key, place): each city's ``top`` keys by rows of their locality, then latest ``recency`` (NULL last), then key.

    A locality's leading rows are found before its size is joined to them, so only those and counts are shuffled.
    """
    rows = listings.select(F.col(f"`{key}`").alias("key"), F.col(f"`{city}`").alias("city"), F.col(f"`{locality}`").alias("locality"), F.col(f"`{recency}`").alias("recency"))
    sizes = rows.groupBy("city", "locality").agg(F.count(F.lit(1)).alias("size"))
    first = Window.partitionBy("city", "locality").orderBy(F.desc_nulls_last("recency"), "key")
    leading = rows.filter("key IS NOT NULL").withColumn("__p", F.row_number().over(first)).filter(F.col("__p") <= top).drop("__p")
    order = Window.partitionBy("city").orderBy(F.desc("size"), F.desc_nulls_last("recency"), "key")
    sized = keyed_join(leading, sizes, ["city", "locality"])
    return sized.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("city", "key", "place")
