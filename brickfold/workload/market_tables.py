"""Registered queries: market tables derived from the clean listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market, metrics, similar
from ..operators.joins import attach
from .common import ITEMS_SQL, items, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _rows(spark, d):
    return items(spark, d).withColumns({"rooms": F.col("l_linenumber"), "labels": F.array(F.col("property_type"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")))})


def _stats(spark, d, keys):
    return market.locality_stats(_rows(spark, d), keys, "price_inr", "price_per_sqft", "area_sqft", "rooms")


@query
def locality_stats(spark, d):
    s = _stats(spark, d, ["city", "locality"])
    return s.select("city", "locality", "listings", *[F.round(c, 4).alias(c) for c in ("avg_price", "median_price", "avg_price_sqft", "avg_area", "avg_bedrooms")])


SQL["locality_stats"] = f"""WITH {ITEMS_SQL} SELECT city, locality, count(*) AS listings, round(avg(price_inr), 4) AS avg_price, round(quantile_cont(price_inr, 0.5), 4) AS median_price, round(avg(price_per_sqft), 4) AS avg_price_sqft,
round(avg(area_sqft), 4) AS avg_area, round(avg(l_linenumber), 4) AS avg_bedrooms FROM items GROUP BY ALL"""


@query
def amenity_uplift(spark, d):
    u = market.amenity_uplift(_rows(spark, d), "city", "locality", "labels", "price_inr", ["F", "n3"])
    return u.select("city", "locality", "amenity", "is_city", "n_with", *[F.round(c, 4).alias(c) for c in ("avg_with", "avg_without", "uplift_pct")])


SQL["amenity_uplift"] = f"""WITH {ITEMS_SQL}, x AS (SELECT city, locality, price_inr, 'F' AS amenity, property_type = 'F' AS has FROM items UNION ALL SELECT city, locality, price_inr, 'n3', l_linenumber = 3 FROM items)
SELECT city, locality, amenity, grouping(locality) = 1 AS is_city, count(*) FILTER (has) AS n_with, round(avg(price_inr) FILTER (has), 4) AS avg_with, round(avg(price_inr) FILTER (NOT has), 4) AS avg_without,
round((avg(price_inr) FILTER (has) - avg(price_inr) FILTER (NOT has)) / avg(price_inr) FILTER (NOT has) * 100, 4) AS uplift_pct FROM x GROUP BY GROUPING SETS ((city, amenity), (city, locality, amenity))"""


@query
def price_trends(spark, d):
    t = market.trends(_rows(spark, d), "city", ["property_type", "rooms"], "price_inr")
    return t.select("city", "trend", "bucket", "listings", F.round("avg_price", 4).alias("avg_price"))


SQL["price_trends"] = f"""WITH {ITEMS_SQL} SELECT city, 'property_type' AS trend, property_type AS bucket, count(*) AS listings, round(avg(price_inr), 4) AS avg_price FROM items GROUP BY city, property_type
UNION ALL SELECT city, 'rooms', CAST(l_linenumber AS VARCHAR), count(*), round(avg(price_inr), 4) FROM items GROUP BY city, l_linenumber"""


@query
def price_tiers(spark, d):
    """Quartile bounds from one part of the rows, applied to all."""
    rows = _rows(spark, d)
    b = market.tier_bounds(rows.filter("l_linenumber <= 5"), "city", "price_inr")
    return market.price_tier(rows, b, "city", "price_inr").groupBy("city", "price_tier").agg(F.count(F.lit(1)).alias("n"))


SQL["price_tiers"] = f"""WITH {ITEMS_SQL}, b AS (SELECT city, quantile_cont(price_inr, 0.25) a, quantile_cont(price_inr, 0.5) m, quantile_cont(price_inr, 0.75) c FROM items WHERE l_linenumber <= 5 GROUP BY city)
SELECT city, CASE WHEN price_inr <= a THEN 'Budget' WHEN price_inr <= m THEN 'Mid' WHEN price_inr <= c THEN 'Premium' ELSE 'Luxury' END AS price_tier, count(*) AS n FROM items JOIN b USING (city) GROUP BY ALL"""


@query
def deal_verdicts(spark, d):
    """Verdict against the mean unit price of the other folds."""
    o = table(spark, d, "orders").withColumn("fold", market.fold_of(F.col("o_orderkey"), 5))
    parts = o.groupBy("o_orderstatus", "fold").agg(F.sum(F.floor("o_totalprice")).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("o_orderstatus").agg(F.sum("s").alias("st"), F.sum("n").alias("nt"))
    j = attach(attach(o, parts, ["o_orderstatus", "fold"]), whole, ["o_orderstatus"])
    out_of_fold = (F.col("st") - F.col("s")) / (F.col("nt") - F.col("n"))
    return j.select("o_orderkey", "fold", market.deal_verdict(F.col("o_totalprice"), out_of_fold).alias("verdict"))


SQL["deal_verdicts"] = """WITH o AS (SELECT *, CAST(('0x' || substr(md5('42|' || o_orderkey), 1, 8)) AS BIGINT) % 5 AS fold FROM orders),
p AS (SELECT o_orderstatus, fold, sum(floor(o_totalprice)) AS s, count(*) AS n FROM o GROUP BY ALL), w AS (SELECT o_orderstatus, sum(s) AS st, sum(n) AS nt FROM p GROUP BY 1),
j AS (SELECT o_orderkey, fold, (o_totalprice - (st - s) / (nt - n)) / ((st - s) / (nt - n)) AS gap FROM o JOIN p USING (o_orderstatus, fold) JOIN w USING (o_orderstatus))
SELECT o_orderkey, fold, CASE WHEN gap < -0.1 THEN 'Good Deal' WHEN gap > 0.1 THEN 'Overpriced' ELSE 'Fair' END AS verdict FROM j"""


@query
def price_histogram(spark, d):
    return market.histogram(_rows(spark, d), "price_inr", 0.0, 100000.0, 20, ["city"])


SQL["price_histogram"] = f"WITH {ITEMS_SQL} SELECT city, CAST(CASE WHEN price_inr >= 100000 THEN 21 ELSE floor(price_inr / 5000e0) + 1 END AS BIGINT) AS bin, count(*) AS listings FROM items GROUP BY ALL"


@query
def price_area_line(spark, d):
    t = market.trend_line(_rows(spark, d), "price_inr", "area_sqft", ["city"])
    return t.select("city", "points", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


SQL["price_area_line"] = f"WITH {ITEMS_SQL} SELECT city, CAST(count(*) AS BIGINT) AS points, round(regr_slope(price_inr, area_sqft), 5) AS slope, round(regr_intercept(price_inr, area_sqft), 3) AS intercept FROM items GROUP BY city"


@query
def description_words(spark, d):
    return market.word_counts(table(spark, d, "documents"), "text", ["lang"])


SQL["description_words"] = "SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL"


@query
def insight_sentences(spark, d):
    s = _stats(spark, d, ["city", "locality"])
    c = _stats(spark, d, ["city"])
    return market.insight_sentences(s, c, "city", "locality", min_rows=500)


SQL["insight_sentences"] = f"""WITH {ITEMS_SQL}, l AS (SELECT city, locality, avg(price_inr) p, count(*) n FROM items GROUP BY ALL), c AS (SELECT city, avg(price_inr) p, count(*) n FROM items GROUP BY ALL)
SELECT l.city, l.locality, l.n < 500 AS city_level, 'Average price in ' || CASE WHEN l.n < 500 THEN l.city ELSE l.locality || ', ' || l.city END || ' is ₹' || CAST(CAST(round(CASE WHEN l.n < 500 THEN c.p ELSE l.p END) AS BIGINT) AS VARCHAR) || ' over ' || CASE WHEN l.n < 500 THEN c.n ELSE l.n END || ' listings.' AS insight
FROM l JOIN c USING (city)"""


@query
def classifier_scores(spark, d):
    """Macro scores and the confusion counts behind them, order status read off the price."""
    o = table(spark, d, "orders").withColumn("said", F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 300000, "O").otherwise("P"))
    m = metrics.macro_scores(o, "o_orderstatus", "said", ["o_orderpriority"])
    c = metrics.confusion(o, "o_orderstatus", "said", ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.max("n").alias("largest_cell"))
    return m.join(c, "o_orderpriority").select("o_orderpriority", "labels", "largest_cell", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


SQL["classifier_scores"] = """WITH o AS (SELECT o_orderpriority g, o_orderstatus a, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END s FROM orders),
l AS (SELECT DISTINCT g, a AS x FROM o UNION SELECT DISTINCT g, s FROM o),
m AS (SELECT l.g, x, count(*) FILTER (a = x AND s = x) * 1e0 AS tp, count(*) FILTER (a = x) AS r, count(*) FILTER (s = x) AS p FROM l JOIN o ON o.g = l.g GROUP BY ALL),
z AS (SELECT g, coalesce(tp / nullif(p, 0), 0) AS pr, coalesce(tp / nullif(r, 0), 0) AS re FROM m),
c AS (SELECT g, max(n) AS largest_cell FROM (SELECT g, a, s, count(*) n FROM o GROUP BY ALL) GROUP BY g)
SELECT z.g AS o_orderpriority, count(*) AS labels, largest_cell, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS f1 FROM z JOIN c USING (g) GROUP BY z.g, largest_cell"""


SIMILAR_FEATURES = ["price", "month", "finished", "open", "urgency"]


@query
def similar_listings(spark, d):
    """The five most similar orders of their priority for each order whose key 20 divides, popular clerks' orders where too few are near."""
    o = table(spark, d, "orders").withColumns({
        "price": F.floor(F.col("o_totalprice") / 10000), "month": F.month("o_orderdate"), "finished": F.when(F.col("o_orderstatus") == "F", 10).otherwise(0),
        "open": F.when(F.col("o_orderstatus") == "O", 10).otherwise(0), "urgency": F.col("o_custkey") % 7, "place": F.col("o_custkey") % 40})
    out = similar.similar_listings(o, o.filter("o_orderkey % 20 = 0"), "o_orderkey", "o_orderpriority", SIMILAR_FEATURES, "place", "o_orderdate", min_similarity=0.9995)
    return out.select("seed", "rank", "key", F.round("similarity", 9).alias("similarity"), "popular")


SQL["similar_listings"] = """WITH o AS (SELECT o_orderkey AS key, o_orderpriority AS city, o_custkey % 40 AS place, o_orderdate AS d, CAST(floor(o_totalprice / 10000) AS DOUBLE) a, CAST(month(o_orderdate) AS DOUBLE) b,
CASE WHEN o_orderstatus = 'F' THEN 10e0 ELSE 0e0 END c, CASE WHEN o_orderstatus = 'O' THEN 10e0 ELSE 0e0 END e, CAST(o_custkey % 7 AS DOUBLE) u FROM orders),
n AS (SELECT *, a * a + b * b + c * c + e * e + u * u AS nn FROM o),
p AS (SELECT s.key AS seed, x.key, (s.a * x.a + s.b * x.b + s.c * x.c + s.e * x.e + s.u * x.u) / sqrt(s.nn * x.nn) AS sim FROM n s JOIN n x ON s.city = x.city AND s.key <> x.key WHERE s.key % 20 = 0),
near AS (SELECT * FROM p WHERE sim >= 0.9995), served AS (SELECT seed FROM near GROUP BY seed HAVING count(*) >= 5),
best AS (SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY sim DESC, key) AS INTEGER) AS rank, key, round(sim, 9) AS similarity, false AS popular FROM near SEMI JOIN served USING (seed)),
sized AS (SELECT key, city, d, count(*) OVER (PARTITION BY city, place) AS size FROM o),
instead AS (SELECT s.key AS seed, CAST(row_number() OVER (PARTITION BY s.key ORDER BY size DESC, x.d DESC, x.key) AS INTEGER) AS rank, x.key, CAST(NULL AS DOUBLE) AS similarity, true AS popular
FROM o s JOIN sized x ON s.city = x.city AND s.key <> x.key WHERE s.key % 20 = 0 AND s.key NOT IN (SELECT seed FROM served))
SELECT * FROM best WHERE rank <= 5 UNION ALL SELECT * FROM instead WHERE rank <= 5"""
