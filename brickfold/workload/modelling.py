"""Registered queries: features, encodings, splits, metrics, models, explanations, registry and scoring."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import encoders, explain, features, geo, metrics, models, registry, scoring, split
from ..operators.outliers import not_outlier
from ..plans.training import gate
from ..session import scratch_path, spread, written
from ..sources import tables as sinks
from .common import ITEMS_SQL, items, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- features -----------------------------------------------------------------------------------

def _homes(spark, d) -> DataFrame:
    """Parts as homes: words of the name are amenities, size and price give rooms, floors and area."""
    return table(spark, d, "part").selectExpr(
        "p_partkey", "p_retailprice AS price_inr", "cast(p_size * 20 AS double) AS built_up_area", "p_size % 5 AS bedRoom", "p_size % 4 AS bathroom",
        "p_size % 12 AS floor_num", "p_size % 7 AS total_floor",
        "CASE p_type WHEN 'PROMO' THEN 'New Property' WHEN 'SMALL' THEN 'Old Property' WHEN 'LARGE' THEN 'Under Construction' ELSE p_type END AS agePossession",
        "CASE WHEN p_size > 5 THEN split(concat(p_name, ' ', p_type), ' ') END AS amenities_list", "split(p_name, ' ') AS features_list")


_HOMES_SQL = """homes AS (SELECT p_partkey, p_retailprice AS price_inr, CAST(p_size * 20 AS DOUBLE) AS built_up_area, p_size % 5 AS bedRoom, p_size % 4 AS bathroom, p_size % 12 AS floor_num, p_size % 7 AS total_floor,
CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 4 WHEN 'LARGE' THEN 1 END AS age_rank, CASE WHEN p_size > 5 THEN string_split(p_name || ' ' || p_type, ' ') END AS amenities, string_split(p_name, ' ') AS feats FROM part)"""


@query
def row_features(spark, d):
    f = features.add_row_features(_homes(spark, d), labels=["ring", "PROMO"])
    return f.select("p_partkey", "price_per_sqft", "floor_ratio", "bath_bed_ratio", "area_per_bedroom",
                    "n_amenities", "n_features", "age_bucket_ord", "has_ring", "has_promo", "top_amenities_count",
                    v.luxury_tier(F.col("amenities_list")).alias("luxury"))


SQL["row_features"] = f"""WITH {_HOMES_SQL} SELECT p_partkey, price_inr / nullif(built_up_area, 0) AS price_per_sqft, floor_num * 1e0 / nullif(total_floor, 0) AS floor_ratio,
bathroom * 1e0 / nullif(bedRoom, 0) AS bath_bed_ratio, built_up_area / nullif(bedRoom, 0) AS area_per_bedroom, CAST(coalesce(len(amenities), 0) AS INTEGER) AS n_amenities,
CAST(len(feats) AS INTEGER) AS n_features, CAST(age_rank AS INTEGER) AS age_bucket_ord, coalesce(list_contains(amenities, 'ring'), false) AS has_ring, coalesce(list_contains(amenities, 'PROMO'), false) AS has_promo,
CAST(coalesce(list_contains(amenities, 'ring'), false)::INT + coalesce(list_contains(amenities, 'PROMO'), false)::INT AS BIGINT) AS top_amenities_count,
CASE WHEN coalesce(len(amenities), 0) >= 5 THEN 'High' WHEN coalesce(len(amenities), 0) >= 2 THEN 'Medium' ELSE 'Low' END AS luxury FROM homes"""


@query
def amenity_frequencies(spark, d):
    return features.amenity_counts(_homes(spark, d))


SQL["amenity_frequencies"] = f"WITH {_HOMES_SQL}, x AS (SELECT unnest(amenities) AS label FROM homes) SELECT label, count(*) AS n FROM x GROUP BY label ORDER BY n DESC, label LIMIT 10"


@query
def amenity_flags(spark, d):
    h = _homes(spark, d)
    top = features.top_amenities(h, k=3)
    f = features.add_amenity_flags(h, top)
    return f.groupBy("top_amenities_count").agg(F.count(F.lit(1)).alias("homes"), F.count_if(f"has_{features.slug_text(top[0])}").alias("with_first"))


SQL["amenity_flags"] = f"""WITH {_HOMES_SQL}, t AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS rn FROM (SELECT unnest(amenities) AS label FROM homes) GROUP BY label),
u AS (SELECT DISTINCT p_partkey, unnest(amenities) AS label FROM homes),
h AS (SELECT p_partkey, count(rn) AS c, coalesce(bool_or(rn = 1), false) AS f FROM homes LEFT JOIN u USING (p_partkey) LEFT JOIN (SELECT * FROM t WHERE rn <= 3) USING (label) GROUP BY p_partkey)
SELECT c AS top_amenities_count, count(*) AS homes, count(*) FILTER (f) AS with_first FROM h GROUP BY 1"""


@query
def feature_frame(spark, d):
    h = _homes(spark, d).withColumns({
        **{c: F.lit(None).cast("string") for c in features.INPUT_FIELDS if c not in ("amenities", "built_up_area", "bedRoom", "bathroom", "agePossession")},
        "is_outlier": F.lit(False), "was_missing_x": F.lit(True)})
    f = features.feature_frame(h, extra=("p_partkey",), labels=["ring"])
    return f.select("p_partkey", "bedRoom", F.round("area_per_bedroom", 6).alias("area_per_bedroom"), "has_ring", F.lit(len(f.columns)).alias("width"))


SQL["feature_frame"] = f"""WITH {_HOMES_SQL} SELECT p_partkey, bedRoom, round(built_up_area / nullif(bedRoom, 0), 6) AS area_per_bedroom, coalesce(list_contains(amenities, 'ring'), false) AS has_ring, CAST(29 AS INTEGER) AS width FROM homes"""


@query
def unit_prices(spark, d):
    li = table(spark, d, "lineitem").withColumn("area", F.col("l_quantity") - 1)
    return features.add_unit_price(li, "l_extendedprice", "area").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price_per_sqft")


SQL["unit_prices"] = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity > 1 THEN l_extendedprice / (l_quantity - 1) END AS price_per_sqft FROM lineitem"


@query
def distances(spark, d):
    """Customers near the four cities; centres and stations are the fixed lists."""
    c = table(spark, d, "customer").selectExpr(
        "c_custkey", "CASE c_mktsegment WHEN 'BUILDING' THEN 'Mumbai' WHEN 'MACHINERY' THEN 'Kolkata' WHEN 'HOUSEHOLD' THEN 'Gurgaon' WHEN 'FURNITURE' THEN 'Hyderabad' ELSE 'Elsewhere' END AS city",
        "CASE WHEN c_nationkey > 0 THEN 10 + c_nationkey + c_acctbal / 10000 END AS latitude", "70 + c_nationkey / 2D AS longitude")
    out = geo.add_distances(c, geo.centres_table(spark), geo.stations_table(spark))
    return out.select("c_custkey", "city", *[F.round(x, 6).alias(x) for x in geo.GEO_FEATURES])


_H = "2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians({a} - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians({a})) * pow(sin(radians({o} - longitude) / 2), 2))))"
SQL["distances"] = f"""WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Mumbai' WHEN 'MACHINERY' THEN 'Kolkata' WHEN 'HOUSEHOLD' THEN 'Gurgaon' WHEN 'FURNITURE' THEN 'Hyderabad' ELSE 'Elsewhere' END AS city,
CASE WHEN c_nationkey > 0 THEN 10 + c_nationkey + c_acctbal / 10000 END AS latitude, 70 + c_nationkey / 2e0 AS longitude FROM customer),
ctr(city, a, o) AS (VALUES {', '.join(f"('{k}', {a}e0, {o}e0)" for k, (a, o) in geo.CITY_CENTRES.items())}),
st(city, a, o) AS (VALUES {', '.join(f"('{k}', {a}e0, {o}e0)" for k, pts in geo.STATIONS.items() for a, o in pts)}),
m AS (SELECT c_custkey, min({_H.format(a='a', o='o')}) AS dist FROM c JOIN st USING (city) WHERE latitude IS NOT NULL GROUP BY c_custkey)
SELECT c.c_custkey, c.city, round(CASE WHEN a IS NOT NULL AND latitude IS NOT NULL THEN {_H.format(a='a', o='o')} END, 6) AS distance_to_cbd_km, round(m.dist, 6) AS distance_to_nearest_metro_km FROM c LEFT JOIN ctr USING (city) LEFT JOIN m USING (c_custkey)"""


# --- encodings ----------------------------------------------------------------------------------

KEYS = ["city", "locality"]


def _parted(spark, d) -> DataFrame:
    """Items with a train mark, an outlier mark and a city unknown on some rows; whole numbers keep sums exact."""
    return items(spark, d).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CASE WHEN l_linenumber <> 6 THEN city END AS city", "concat(locality, '-', cast(area_sqft AS int)) AS locality",
        "cast(floor(price_inr) AS double) AS price_inr", "CASE WHEN l_tax > 0.01D THEN cast(l_linenumber AS double) END AS price_per_sqft", "l_discount > 0.08D AS is_outlier", "l_tax < 0.07D AS in_train")


_PARTED_SQL = ITEMS_SQL + """, parted AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 6 THEN city END AS city, locality || '-' || CAST(area_sqft AS INTEGER) AS locality,
CAST(floor(price_inr) AS DOUBLE) AS price_inr, CASE WHEN l_tax > 0.01e0 THEN CAST(l_linenumber AS DOUBLE) END AS price_per_sqft, l_discount > 0.08e0 AS is_outlier, l_tax < 0.07e0 AS in_train FROM items),
st AS (SELECT city, locality, count(*) FILTER (NOT is_outlier) AS group_rows, coalesce(sum(price_inr) FILTER (NOT is_outlier), 0) AS sp, coalesce(sum(price_per_sqft) FILTER (NOT is_outlier), 0) AS su FROM parted WHERE in_train GROUP BY ALL),
pr AS (SELECT city, avg(price_per_sqft) AS prior FROM parted WHERE in_train AND NOT is_outlier AND city IS NOT NULL GROUP BY city),
j AS (SELECT p.*, coalesce(group_rows, 0) AS n, coalesce(sp, 0) AS sp, coalesce(su, 0) AS su, coalesce(prior, 0) AS prior FROM parted p
  LEFT JOIN st ON p.city IS NOT DISTINCT FROM st.city AND p.locality IS NOT DISTINCT FROM st.locality LEFT JOIN pr ON p.city = pr.city)"""


def _state(spark, d):
    train = _parted(spark, d).filter("in_train")
    return encoders.fit(train, KEYS, ["price_inr", "price_per_sqft"], "price_per_sqft", not_outlier())


@query
def group_state(spark, d):
    s, _ = _state(spark, d)
    return s.select("city", "locality", "group_rows", F.round("sum_price_inr", 2).alias("sum_price"), F.round("sum_price_per_sqft", 2).alias("sum_unit"))


SQL["group_state"] = f"WITH {_PARTED_SQL} SELECT city, locality, group_rows, round(sp, 2) AS sum_price, round(su, 2) AS sum_unit FROM st"


@query
def city_priors(spark, d):
    _, p = _state(spark, d)
    return p.select("city", F.round("prior", 5).alias("prior"))


SQL["city_priors"] = f"WITH {_PARTED_SQL} SELECT city, round(prior, 5) AS prior FROM pr"

_LOO_SQL = """CASE WHEN n >= 2 THEN (su - coalesce(price_per_sqft, 0)) / (n - 1) WHEN n = 0 THEN prior END AS locality_avg_price_sqft,
CASE WHEN NOT (price_inr IS NULL AND n = 0) THEN (sp - price_inr + 20 * prior) / (n - 1 + 20) END AS locality_smoothed_price"""


@query
def locality_encoding(spark, d):
    s, p = _state(spark, d)
    out = encoders.encode_locality(_parted(spark, d), s, p, KEYS)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "locality_listing_count",
                      "locality_avg_price_sqft", "locality_smoothed_price")


SQL["locality_encoding"] = f"WITH {_PARTED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n AS locality_listing_count, {_LOO_SQL} FROM j"


@query
def locality_encoding_members(spark, d):
    """Own value taken out only for rows that were in the fit."""
    s, p = _state(spark, d)
    out = encoders.encode_locality(_parted(spark, d), s, p, KEYS, loo="members", member=F.col("in_train") & ~F.col("is_outlier"))
    return out.groupBy("city", "in_train").agg(F.count("locality_avg_price_sqft").alias("known"), F.round(F.avg("locality_smoothed_price"), 3).alias("mean_smoothed"))


SQL["locality_encoding_members"] = f"""WITH {_PARTED_SQL} SELECT city, in_train, count(CASE WHEN in_train AND NOT is_outlier THEN CASE WHEN n >= 2 THEN 1 WHEN n = 0 THEN 1 END ELSE 1 END) AS known,
round(avg(CASE WHEN in_train AND NOT is_outlier THEN (sp - price_inr + 20 * prior) / (n - 1 + 20) ELSE (sp + 20 * prior) / (n + 20) END), 3) AS mean_smoothed FROM j GROUP BY ALL"""


@query
def sector_encoding(spark, d):
    s, p = _state(spark, d)
    out = encoders.encode_sector(_parted(spark, d), s.drop("sum_price_inr"), p, KEYS)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sector_smoothed_price")


SQL["sector_encoding"] = f"""WITH {_PARTED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
CASE WHEN price_per_sqft IS NULL AND n = 0 THEN NULL WHEN n >= 2 THEN (su - coalesce(price_per_sqft, 0) + 20 * prior) / (n - 1 + 20) ELSE prior END AS sector_smoothed_price FROM j"""


@query
def state_roundtrip(spark, d):
    """Fitted state written, read back and used."""
    s, p = _state(spark, d)
    folder = scratch_path(spark, "fitted")
    sinks.save_state({"locality": s, "prior": p}, folder, "v1")
    back = sinks.load_state(spark, folder, "v1", ["locality", "prior"])
    return back["locality"].join(back["prior"], "city").groupBy("city").agg(F.sum("group_rows").alias("n"), F.round(F.max("prior"), 5).alias("prior"))


SQL["state_roundtrip"] = f"WITH {_PARTED_SQL} SELECT st.city, CAST(sum(group_rows) AS BIGINT) AS n, round(max(prior), 5) AS prior FROM st JOIN pr ON st.city = pr.city GROUP BY 1"


# --- splits -------------------------------------------------------------------------------------

@query
def stratified_split(spark, d):
    o = split.stratified_split(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_orderkey"))
    return o.select("o_orderkey", "o_orderstatus", "split")


def _split_sql(src: str, strata: str, key: str) -> str:
    return f"""sq AS (SELECT {strata}, count(*) AS n FROM {src} GROUP BY ALL),
sc AS (SELECT *, floor(n * 0.7e0) + (row_number() OVER (ORDER BY n * 0.7e0 - floor(n * 0.7e0) DESC, {strata}) <= round(sum(n) OVER () * 0.7e0) - sum(floor(n * 0.7e0)) OVER ())::INT AS c0,
 floor(n * 0.85e0) + (row_number() OVER (ORDER BY n * 0.85e0 - floor(n * 0.85e0) DESC, {strata}) <= round(sum(n) OVER () * 0.85e0) - sum(floor(n * 0.85e0)) OVER ())::INT AS c1 FROM sq),
sr AS (SELECT s.*, row_number() OVER (PARTITION BY {strata} ORDER BY md5('42|' || CAST({key} AS VARCHAR))) AS rn FROM {src} s),
parts AS (SELECT sr.*, CASE WHEN rn <= c0 THEN 'train' WHEN rn <= c1 THEN 'val' ELSE 'test' END AS split FROM sr JOIN sc USING ({strata}))"""


SQL["stratified_split"] = f"WITH {_split_sql('orders', 'o_orderstatus', 'o_orderkey')} SELECT o_orderkey, o_orderstatus, split FROM parts"


@query
def protocol_split(spark, d):
    o = split.protocol_split(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderkey"))
    return o.groupBy("o_orderpriority", "split").agg(F.count(F.lit(1)).alias("n"))


SQL["protocol_split"] = f"WITH {_split_sql('orders', 'o_orderpriority', 'o_orderkey')} SELECT o_orderpriority, split, count(*) AS n FROM parts GROUP BY ALL"


# --- metrics ------------------------------------------------------------------------------------

def _predicted(spark, d) -> DataFrame:
    """Orders with a closed-form prediction on the log scale."""
    o = split.stratified_split(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_orderkey"))
    return o.withColumns({
        "y": F.log1p("o_totalprice"), "p": F.log1p(F.col("o_totalprice") * (0.8 + F.pmod(F.col("o_custkey"), F.lit(5)) * 0.1))})


_PRED_SQL = _split_sql("orders", "o_orderstatus", "o_orderkey") + """, pred AS (SELECT *, o_totalprice AS y, o_totalprice * (0.8e0 + (o_custkey % 5) * 0.1e0) AS p FROM parts)"""
_METRIC_SQL = """count(*) AS n, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
round(avg(abs(p - y) / greatest(y, 1)) * 100, 5) AS mape"""
_ROUND = {"r2": 6, "mae": 6, "rmse": 6, "mape": 5}


def _rounded():
    return [F.round(c, k).alias(c) for c, k in _ROUND.items()]


@query
def metrics_by_split(spark, d):
    m = metrics.regression_metrics(_predicted(spark, d), "y", "p", ["split"])
    return m.select("split", "n", *_rounded())


SQL["metrics_by_split"] = f"WITH {_PRED_SQL} SELECT split, {_METRIC_SQL} FROM pred GROUP BY split"


@query
def metrics_by_slice(spark, d):
    """Per split and per (split, status) in one job, small slices marked."""
    m = metrics.split_and_slice_metrics(_predicted(spark, d), "y", "p", "split", "o_orderstatus")
    return m.select("split", "o_orderstatus", "n", *_rounded(), "is_total", "small_sample")


SQL["metrics_by_slice"] = f"""WITH {_PRED_SQL} SELECT split, o_orderstatus, {_METRIC_SQL}, grouping(o_orderstatus) = 1 AS is_total, count(*) < 30 AS small_sample
FROM pred GROUP BY GROUPING SETS ((split), (split, o_orderstatus))"""


@query
def within_tolerance(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") * (1 + F.col("l_discount") * 3))
    m = metrics.regression_metrics(li, "l_extendedprice", "p", ["l_returnflag"], log_scale=False)
    return m.select("l_returnflag", F.round("within_tol", 6).alias("within_tol"))


SQL["within_tolerance"] = """SELECT l_returnflag, round(avg(CASE WHEN abs(l_extendedprice * (1 + l_discount * 3) - l_extendedprice) / greatest(l_extendedprice, 1) <= 0.15e0 THEN 1e0 ELSE 0 END), 6) AS within_tol FROM lineitem GROUP BY 1"""


def _two_versions(spark, d):
    o = table(spark, d, "orders").withColumns({"old": F.col("o_totalprice") * 0.7, "new": F.col("o_totalprice") * (1 + F.pmod(F.col("o_custkey"), F.lit(3)) * 0.1)})
    a = metrics.to_long(metrics.regression_metrics(o, "o_totalprice", "old", ["o_orderstatus"], log_scale=False), ["o_orderstatus"])
    b = metrics.to_long(metrics.regression_metrics(o, "o_totalprice", "new", ["o_orderstatus"], log_scale=False), ["o_orderstatus"])
    return a, b


@query
def version_comparison(spark, d):
    a, b = _two_versions(spark, d)
    c = metrics.compare_versions(a, b, ["o_orderstatus"])
    return c.select("o_orderstatus", "metric", F.round("improvement_pct", 4).alias("improvement_pct"), "target_met")


def _version(col):
    return f"""SELECT o_orderstatus, 1 - sum(({col} - y) * ({col} - y)) / (var_pop(y) * count(*)) AS r2, avg(abs({col} - y)) AS mae, sqrt(avg(({col} - y) * ({col} - y))) AS rmse, avg(abs({col} - y) / greatest(y, 1)) * 100 AS mape FROM o GROUP BY 1"""


SQL["version_comparison"] = f"""WITH o AS (SELECT o_orderstatus, o_totalprice AS y, o_totalprice * 0.7e0 AS old, o_totalprice * (1 + (o_custkey % 3) * 0.1e0) AS new FROM orders),
a AS (UNPIVOT ({_version('old')}) ON r2, mae, rmse, mape INTO NAME metric VALUE va), b AS (UNPIVOT ({_version('new')}) ON r2, mae, rmse, mape INTO NAME metric VALUE vb),
g AS (SELECT o_orderstatus, metric, CASE WHEN metric = 'r2' THEN vb - va ELSE va - vb END / abs(va) * 100 AS pct FROM a JOIN b USING (o_orderstatus, metric) WHERE va <> 0)
SELECT o_orderstatus, metric, round(pct, 4) AS improvement_pct, pct >= 32.5 AS target_met FROM g"""


@query
def metrics_table_roundtrip(spark, d):
    a, _ = _two_versions(spark, d)
    path = scratch_path(spark, "metrics")
    none = sinks.load_metrics(spark, path).count()
    sinks.save_metrics(a.select(F.lit("m").alias("model"), F.col("o_orderstatus").alias("transact_type"), F.lit("all").alias("split"), "metric", "value"), path)
    return sinks.load_metrics(spark, path).select("transact_type", "metric", F.round("value", 3).alias("value"), F.lit(none).cast("int").alias("before"))


SQL["metrics_table_roundtrip"] = f"""WITH o AS (SELECT o_orderstatus, o_totalprice AS y, o_totalprice * 0.7e0 AS old FROM orders), a AS (UNPIVOT ({_version('old')}) ON r2, mae, rmse, mape INTO NAME metric VALUE va)
SELECT o_orderstatus AS transact_type, metric, round(va, 3) AS value, 0 AS before FROM a"""


@query
def latency_p95(spark, d):
    return metrics.latency_p95(table(spark, d, "events"), "value", ["event_type"]).select("event_type", F.round("p95_ms", 5).alias("p95_ms"), "rows")


SQL["latency_p95"] = "SELECT event_type, round(quantile_cont(value, 0.95), 5) AS p95_ms, count(*) AS rows FROM events GROUP BY 1"


@query
def model_gate(spark, d):
    """Route by segment, skip small ones, split, score, verdicts and summary in one plan."""
    o = table(spark, d, "orders").withColumn("is_outlier", F.col("o_totalprice") > 400000)
    segment = F.when(F.col("o_custkey") < 3, "Lease").when(F.col("o_orderpriority") < "3", "Sale").otherwise("Rent")
    factor = F.when(F.col("o_orderpriority") < "3", 0.89).otherwise(0.69) + F.pmod(F.col("o_custkey"), F.lit(4)) * 0.05
    rows = o.withColumns({"segment_name": segment, "factor": factor})
    p95 = metrics.latency_p95(table(spark, d, "events"), "value")
    g = gate(rows, "o_orderkey", "segment_name", "o_orderstatus", "o_totalprice", lambda x: x.withColumn("prediction", F.log1p(F.col("o_totalprice") * F.col("factor"))), p95)
    return g.select("segment", "rows", "skipped", "reason", "train", "val", "test", F.round("r2", 5).alias("r2"), F.round("mae", 2).alias("mae"), F.round("within_tol", 5).alias("within"),
                    "ok_r2_min", "ok_r2_stretch", "ok_within_15_min", "ok_min_rows", "ok_p95_latency", "ok_overall", "summary")


SQL["model_gate"] = f"""WITH base AS (SELECT *, CASE WHEN o_custkey < 3 THEN 'lease' WHEN o_orderpriority < '3' THEN 'sale' ELSE 'rent' END AS seg,
 CASE WHEN o_orderpriority < '3' THEN 0.89e0 ELSE 0.69e0 END + (o_custkey % 4) * 0.05e0 AS factor FROM orders WHERE NOT o_totalprice > 400000),
keyed AS (SELECT *, seg || '|' || o_orderstatus AS k FROM base), {_split_sql('keyed', 'k', 'o_orderkey')},
pred AS (SELECT *, o_totalprice AS y, o_totalprice * factor AS p FROM parts),
sz AS (SELECT seg, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS rows FROM pred GROUP BY seg),
m AS (SELECT seg, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2, avg(abs(p - y)) AS mae, avg(CASE WHEN abs(p - y) / greatest(y, 1) <= 0.15e0 THEN 1e0 ELSE 0 END) AS w FROM pred WHERE split = 'test' GROUP BY seg),
q AS (SELECT quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.95) <= 300 AS lat FROM events),
z AS (SELECT *, rows < 500 AS skipped FROM sz JOIN m USING (seg), q)
SELECT seg AS segment, rows, skipped, CASE WHEN skipped THEN 'n=' || rows || ' < 500' ELSE '' END AS reason, nullif(train, 0) AS train, nullif(val, 0) AS val, nullif(test, 0) AS test, round(r2, 5) AS r2, round(mae, 2) AS mae, round(w, 5) AS within,
r2 >= 0.8 AND NOT skipped AS ok_r2_min, r2 >= 0.85 AND NOT skipped AS ok_r2_stretch, w >= 0.7 AND NOT skipped AS ok_within_15_min, NOT skipped AS ok_min_rows, lat AND NOT skipped AS ok_p95_latency,
r2 >= 0.8 AND w >= 0.7 AND NOT skipped AND lat AS ok_overall, coalesce(CASE WHEN r2 >= 0.8 AND w >= 0.7 AND NOT skipped AND lat THEN '[PASS] ' ELSE '[FAIL] ' END || seg || printf(' R²=%.4f (≥0.80) MAE=₹%.0f within±15%%=%.1f%% (≥70%%) latency_p95=', r2, mae, w * 100) || printf('%.1f', p95) || 'ms (<300ms)', '[SKIP] ' || seg || ' n=' || rows || ' < 500') AS summary FROM z"""


@query
def candidate_winner(spark, d):
    """Lowest RMSE, then MAE, per status among three closed-form candidates."""
    o = table(spark, d, "orders")
    cand = F.array(*[F.struct(F.lit(n).alias("model"), (F.col("o_totalprice") * k + c).alias("p")) for n, k, c in (("a", 0.9, 0.0), ("b", 1.0, 9000.0), ("c", 1.05, -900.0))])
    long = o.select("o_orderstatus", "o_totalprice", F.inline(cand))
    m = metrics.regression_metrics(long, "o_totalprice", "p", ["o_orderstatus", "model"], log_scale=False)
    w = registry.pick_winner(m, ["o_orderstatus"])
    return w.select("o_orderstatus", "model", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


SQL["candidate_winner"] = """WITH c(model, k, c) AS (VALUES ('a', 0.9e0, 0e0), ('b', 1e0, 9000e0), ('c', 1.05e0, -900e0)),
m AS (SELECT o_orderstatus, model, sqrt(avg(pow(o_totalprice * k + c - o_totalprice, 2))) AS rmse, avg(abs(o_totalprice * k + c - o_totalprice)) AS mae FROM orders, c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY rmse, mae, model) AS rn FROM m)
SELECT o_orderstatus, model, round(rmse, 3) AS rmse, round(mae, 3) AS mae FROM r WHERE rn = 1"""


# --- models -------------------------------------------------------------------------------------

@query
def least_squares(spark, d):
    """Price on quantity by Spark ML, against the closed form."""
    li = table(spark, d, "lineitem")
    pre = models.fit_preprocessor(li, [], {}, [], extra=("l_quantity",))
    m = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(pre.transform(li))
    return li.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.round(F.lit(float(m.coefficients[0])), 4).alias("slope"), F.round(F.lit(float(m.intercept)), 2).alias("intercept"))


SQL["least_squares"] = "SELECT count(*) AS rows, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem"


@query
def model_matrix(spark, d):
    """Scaled numbers, pinned ordinals and one-hot columns, fitted on part of the rows."""
    p = table(spark, d, "part")
    scale = {"p_type": {"SMALL": 0, "MEDIUM": 1, "LARGE": 2}}
    pre = models.fit_preprocessor(p.filter("p_size > 10"), ["p_size", "p_retailprice"], scale, ["p_brand"])
    c = pre.columns()
    pick = {"num__p_size": "size_scaled", "num__p_retailprice": "price_scaled", "ord__p_type": "type_rank", "cat__p_brand_Brand#2": "is_brand2"}
    hot = sum((x for n, x in c.items() if n.startswith("cat__")), F.lit(0.0))
    return p.select("p_partkey", *[F.round(c[n], 6).alias(a) for n, a in pick.items()], hot.alias("hot"))


SQL["model_matrix"] = """WITH s AS (SELECT avg(p_size) ma, stddev_pop(p_size) sa, avg(p_retailprice) mb, stddev_pop(p_retailprice) sb, min(p_brand) b0 FROM part WHERE p_size > 10)
SELECT p_partkey, round((p_size - ma) / sa, 6) AS size_scaled, round((p_retailprice - mb) / sb, 6) AS price_scaled, CASE p_type WHEN 'SMALL' THEN 0e0 WHEN 'MEDIUM' THEN 1e0 WHEN 'LARGE' THEN 2e0 ELSE -1e0 END AS type_rank,
CASE WHEN p_brand = 'Brand#2' THEN 1e0 ELSE 0e0 END AS is_brand2, CASE WHEN p_brand <> b0 THEN 1e0 ELSE 0e0 END AS hot FROM part, s"""


def _training(spark, d):
    """Items joined to parts, with a split and a log label."""
    li = items(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_inr")
    return split.stratified_split(li.withColumn("key", key), ["city"], F.col("key")).withColumn("label", F.log1p("price_inr"))


def _matrix(spark, d) -> tuple[DataFrame, models.Preprocessor]:
    """key, split, label, features of every row, and the encoder fitted on the training rows."""
    rows = written(_training(spark, d).select("key", "city", "split", "label", "area_sqft", "p_size", "p_retailprice", "p_type", "p_brand", "l_discount", "l_tax"), "rows")
    pre = models.fit_preprocessor(rows.filter("split = 'train'"), ["area_sqft", "p_size", "p_retailprice", "l_discount", "l_tax"], {}, ["city", "p_type"])
    return spread(pre.transform(rows).select("key", "split", "label", "features"), "matrix"), pre


@query
def candidate_sweep(spark, d):
    """All five candidates at full size on one matrix, whole table."""
    matrix, _ = _matrix(spark, d)
    m, _ = models.sweep(matrix.filter("split = 'train'"), matrix, models.candidates())
    return m


@query
def tree_importance(spark, d):
    """Ranked inputs of both tree candidates at full size, all inputs of the sweep."""
    matrix, pre = _matrix(spark, d)
    fitted = models.fit_all(matrix.filter("split = 'train'"), {n: models.make_estimator(n) for n in ("random_forest", "gradient_boosting")})
    ranked = [models.importances(spark, m, pre.names, n) for n, m in fitted.items()]
    return registry.rank_features(ranked[0].unionByName(ranked[1]))


@query
def permutation_importance(spark, d):
    """Ten deals of every input of a fitted linear model, on the validation rows it was not fitted on."""
    rows = split.stratified_split(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_orderkey"))
    rows = written(rows.selectExpr("o_orderkey", "split", "o_totalprice AS label", "cast(o_custkey AS double) AS a", "cast(o_orderkey * 13 % 1700 AS double) AS b"), "rows")
    pre = models.fit_preprocessor(rows.filter("split = 'train'"), ["a", "b"], {}, [])
    fitted = models.make_estimator("linear").fit(pre.transform(rows.filter("split = 'train'")))
    predict = lambda x: fitted.transform(pre.transform(x)).drop("features")
    out = models.permutation_importance(rows.filter("split = 'val'"), "o_orderkey", ["a", "b"], "label", predict, log_scale=False)
    return out.select("feature", F.round("importance", 3).alias("importance"))


SQL["permutation_importance"] = f"""WITH {_split_sql('orders', 'o_orderstatus', 'o_orderkey')}, x AS (SELECT o_orderkey, split, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS a, CAST(o_orderkey * 13 % 1700 AS DOUBLE) AS b FROM parts),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb FROM x WHERE split = 'train'),
w AS (SELECT *, (ca * vb - cb * cab) / (va * vb - cab * cab) AS wa, (cb * va - ca * cab) / (va * vb - cab * cab) AS wb FROM m), fit AS (SELECT wa, wb, my - wa * ma - wb * mb AS w0 FROM w),
o AS (SELECT * FROM x WHERE split = 'val'), r AS (SELECT unnest(range(10)) AS r),
l AS (SELECT r, o.*, row_number() OVER (PARTITION BY r ORDER BY md5('42|' || r || '|a|' || o_orderkey)) AS pos FROM o, r),
q AS (SELECT r, a AS pa, b AS pb, row_number() OVER (PARTITION BY r ORDER BY md5('42|' || r || '|b|' || o_orderkey)) AS pos FROM o, r),
base AS (SELECT avg(abs(w0 + wa * a + wb * b - y)) AS m FROM o, fit),
s AS (SELECT r, 'a' AS feature, avg(abs(w0 + wa * pa + wb * b - y)) AS mae FROM l JOIN q USING (r, pos), fit GROUP BY r UNION ALL SELECT r, 'b', avg(abs(w0 + wa * a + wb * pb - y)) FROM l JOIN q USING (r, pos), fit GROUP BY r)
SELECT feature, round(avg(mae - m), 3) AS importance FROM s, base GROUP BY feature"""


# --- explanations -------------------------------------------------------------------------------

_COEF = {"l_quantity": 12.0, "l_discount": -900.0, "l_tax": 400.0}
_MEAN = {"l_quantity": 25.0, "l_discount": 0.05, "l_tax": 0.04}


def _explained(spark, d) -> DataFrame:
    c = explain.linear_contributions({f: F.col(f) for f in _COEF}, _COEF, _MEAN)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", c.alias("contributions"))


_CONTRIB_SQL = """contrib AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, f.feature, f.impact FROM lineitem,
LATERAL (SELECT 'l_quantity' AS feature, 12e0 * (l_quantity - 25e0) AS impact UNION ALL SELECT 'l_discount', -900e0 * (l_discount - 0.05e0) UNION ALL SELECT 'l_tax', 400e0 * (l_tax - 0.04e0)) f)"""
_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query
def top_contributions(spark, d):
    e = _explained(spark, d).select(*_ID.split(", "), explain.top_contributions(F.col("contributions"), 2).alias("top"))
    return explain.contribution_rows(e, "top").select(
        *_ID.split(", "), "position", "feature", F.round("impact", 6).alias("impact"), F.col("shown_as").alias("direction"), F.round("pct", 6).alias("pct"))


SQL["top_contributions"] = f"""WITH {_CONTRIB_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY abs(impact) DESC, feature) AS rn FROM contrib),
t AS (SELECT *, max(abs(impact)) OVER (PARTITION BY {_ID}) AS peak FROM r WHERE rn <= 2)
SELECT {_ID}, CAST(rn - 1 AS INTEGER) AS position, feature, round(impact, 6) AS impact, CASE WHEN impact > 0 THEN 'up' WHEN impact < 0 THEN 'down' ELSE 'neutral' END AS direction, round(impact / CASE WHEN peak = 0 THEN 1 ELSE peak END, 6) AS pct FROM t"""


@query
def mean_abs_impact(spark, d):
    labels = explain.overlay_labels(explain.static_labels(spark), table(spark, d, "region").selectExpr("'l_tax' AS feature", "concat('Tax ', r_name) AS label"))
    m = explain.mean_abs_impact(_explained(spark, d), "contributions")
    return explain.with_labels(m, labels).select("feature", "label", F.round("mean_abs_impact", 5).alias("mean_abs_impact"))


SQL["mean_abs_impact"] = f"WITH {_CONTRIB_SQL} SELECT feature, CASE WHEN feature = 'l_tax' THEN (SELECT 'Tax ' || max(r_name) FROM region) ELSE feature END AS label, round(avg(abs(impact)), 5) AS mean_abs_impact FROM contrib GROUP BY feature"


@query
def direction_counts(spark, d):
    e = _explained(spark, d).withColumn("top", explain.top_contributions(F.col("contributions"), 3))
    return explain.direction_counts(e, "top", ["l_orderkey"], 3).groupBy("up", "down").agg(F.count(F.lit(1)).alias("n"))


SQL["direction_counts"] = f"""WITH {_CONTRIB_SQL}, g AS (SELECT l_orderkey, (l_quantity > 25)::INT + (-900e0 * (l_discount - 0.05e0) > 0)::INT + (400e0 * (l_tax - 0.04e0) > 0)::INT AS up FROM lineitem)
SELECT CAST(up AS INTEGER) AS up, CAST(3 - up AS INTEGER) AS down, count(*) AS n FROM g GROUP BY up"""


@query
def consensus_features(spark, d):
    """Localities in the top 20 of every city, by mean area."""
    r = items(spark, d).groupBy(F.col("city").alias("method"), F.col("locality").alias("feature")).agg(F.avg("area_sqft").alias("importance"))
    return registry.consensus(r, k=20)


SQL["consensus_features"] = f"""WITH {ITEMS_SQL}, r AS (SELECT city, locality, row_number() OVER (PARTITION BY city ORDER BY avg(area_sqft) DESC, locality) AS rn FROM items GROUP BY city, locality)
SELECT locality AS feature FROM r WHERE rn <= 20 GROUP BY locality HAVING count(DISTINCT city) = (SELECT count(DISTINCT city) FROM items)"""


@query
def name_hashes(spark, d):
    p = table(spark, d, "part")
    h = registry.feature_hash(p, "p_brand", ["p_type"])
    m = registry.label_map_hash(table(spark, d, "nation").select(F.col("n_name").alias("feature"), F.col("n_nationkey").cast("string").alias("label")))
    return h.crossJoin(F.broadcast(m))


SQL["name_hashes"] = """SELECT p_type, substr(sha256(string_agg(p_brand, chr(10) ORDER BY p_brand)), 1, 16) AS feature_hash,
(SELECT sha1('{' || string_agg('"' || n_name || '": "' || n_nationkey || '"', ', ' ORDER BY n_name) || '}') FROM nation) AS label_map_hash FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY p_type"""


# --- registry -----------------------------------------------------------------------------------

def _registry(spark, d) -> DataFrame:
    """Parts as registered models: brand is the name, size the version, price the error."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("model_name"), F.col("p_size").cast("string").alias("version")).agg(
        F.min("p_partkey").alias("id"), F.max("p_retailprice").alias("rmse"), F.max("p_name").alias("git_commit"))


_REG_SQL = "reg AS (SELECT p_brand AS model_name, CAST(p_size AS VARCHAR) AS version, min(p_partkey) AS id, max(p_retailprice) AS rmse, max(p_name) AS git_commit FROM part GROUP BY ALL)"


@query
def registry_append(spark, d):
    """Only rows whose (name, version) is new are added."""
    r = _registry(spark, d)
    return registry.new_rows(r.filter("rmse < 980"), r, registry.MODEL_KEY).select("model_name", "version", "id")


SQL["registry_append"] = f"WITH {_REG_SQL} SELECT model_name, version, id FROM reg WHERE NOT rmse < 980"


@query
def active_models(spark, d):
    p = table(spark, d, "part").selectExpr("p_brand AS model_name", "cast(p_size + 1 AS string) AS version", "p_partkey AS activated_at")
    return registry.active_models(_registry(spark, d), p).select("model_name", "version", "id")


SQL["active_models"] = f"""WITH {_REG_SQL}, a AS (SELECT p_brand AS model_name, CAST(p_size + 1 AS VARCHAR) AS version, p_partkey AS t FROM part),
k AS (SELECT a.*, reg.id, row_number() OVER (PARTITION BY a.model_name ORDER BY t DESC) AS rn FROM a JOIN reg USING (model_name, version)) SELECT model_name, version, id FROM k WHERE rn = 1"""


@query
def model_listing(spark, d):
    return registry.list_models(_registry(spark, d), limit=250, date="rmse", rid="id").select("model_name", "version", "id", "rmse")


SQL["model_listing"] = f"WITH {_REG_SQL} SELECT model_name, version, id, rmse FROM reg ORDER BY rmse DESC, id DESC LIMIT 250"


@query
def next_versions(spark, d):
    r = _registry(spark, d).withColumn("artifact", registry.artifact_name(F.col("model_name"), F.col("version")))
    return registry.next_version(r)


SQL["next_versions"] = f"WITH {_REG_SQL} SELECT model_name, max(CAST(version AS INTEGER)) + 1 AS next_version FROM reg GROUP BY 1"


# --- scoring ------------------------------------------------------------------------------------

def _requests(spark, d) -> DataFrame:
    """Orders as requests; dates and sums make some of them invalid."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS request_id", "concat(' ', o_orderstatus, ' ') AS city", "CASE WHEN o_custkey > 20 THEN 'S1' ELSE '  ' END AS sector",
        "CASE WHEN o_orderstatus = 'F' THEN 'flat' ELSE 'house' END AS property_type", "CASE WHEN o_orderpriority < '4' THEN 'Sale' ELSE 'Rent' END AS transact_type",
        "cast(substr(o_orderpriority, 1, 1) AS int) * 4 AS bedRoom", "cast(o_custkey % 9 AS int) + 1 AS bathroom", "CASE WHEN o_custkey % 6 < 4 THEN cast(o_custkey % 6 AS string) ELSE '3+' END AS balcony",
        "CASE WHEN o_orderpriority < '5' THEN 'Old Property' ELSE 'Ancient' END AS agePossession", "o_totalprice / 20 AS built_up_area", "true AS servant_room", "o_custkey > 10 AS store_room",
        "'Furnished' AS furnishing_type", "'Mid Floor' AS floor_category", "'North-East' AS facing", "slice(split('a b c d e f g', ' '), 1, cast(o_custkey % 7 AS int)) AS amenities", "'High' AS luxury_category")


_REQ_SQL = """req AS (SELECT o_orderkey AS request_id, o_orderstatus AS city, o_orderpriority AS pr, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 4 AS bed, CAST(o_custkey % 9 AS INTEGER) + 1 AS bath,
o_totalprice / 20 AS area, o_custkey AS k FROM orders),
chk AS (SELECT *, concat_ws('|', CASE WHEN k <= 20 THEN 'sector is empty' END, CASE WHEN NOT pr < '5' THEN 'agePossession is not an accepted label' END, CASE WHEN bed > 15 THEN 'bedRoom is out of range' END,
CASE WHEN NOT (area > 0 AND area <= 20000) THEN 'built_up_area is out of range' END, CASE WHEN bed > bath + 3 THEN 'bathroom too low for bedroom count' END) AS problems FROM req)"""


@query
def request_validation(spark, d):
    c = scoring.validate_requests(_requests(spark, d))
    return c.select("request_id", "city", F.array_join("problems", "|").alias("problems"))


SQL["request_validation"] = f"WITH {_REQ_SQL} SELECT request_id, city, problems FROM chk"


def _predict(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.log1p(F.col("built_up_area") * 4000) - 0.01 * F.col("bedRoom"))


@query
def request_scoring(spark, d):
    s = scoring.price_columns(_predict(scoring.valid_requests(scoring.validate_requests(_requests(spark, d)))))
    return s.select("request_id", "luxury_category", *[F.round(c, 2).alias(c) for c in ("predicted_price", "range_low", "range_high")], "is_outlier_input")


SQL["request_scoring"] = f"""WITH {_REQ_SQL}, s AS (SELECT *, greatest(0, (1 + area * 4000) * exp(-0.01e0 * bed) - 1) AS price FROM chk WHERE problems = '')
SELECT request_id, CASE WHEN k % 7 >= 5 THEN 'High' WHEN k % 7 >= 2 THEN 'Medium' ELSE 'Low' END AS luxury_category, round(price, 2) AS predicted_price, round(price * 0.85e0, 2) AS range_low, round(price * 1.15e0, 2) AS range_high, false AS is_outlier_input FROM s"""


@query
def prediction_log(spark, d):
    """Scored requests appended to the log and read back."""
    s = scoring.price_columns(_predict(scoring.valid_requests(scoring.validate_requests(_requests(spark, d)))))
    path = scratch_path(spark, "log")
    scoring.log_rows(s, "v2").write.mode("append").parquet(path)
    log = spark.read.parquet(path)
    return log.groupBy("city", "locality", "model_version").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted_price"), 1).alias("mean_price"), F.count_if(F.get_json_object("input_features_json", "$.bedRoom").isNotNull()).alias("with_payload"))


SQL["prediction_log"] = f"""WITH {_REQ_SQL}, s AS (SELECT *, greatest(0, (1 + area * 4000) * exp(-0.01e0 * bed) - 1) AS price FROM chk WHERE problems = '')
SELECT city, 'S1' AS locality, 'price_model_v2' AS model_version, count(*) AS n, round(avg(price), 1) AS mean_price, count(*) AS with_payload FROM s GROUP BY city"""


@query
def money_texts(spark, d):
    o = table(spark, d, "orders").withColumns({
        "value": F.col("o_totalprice") * F.when(F.col("o_orderpriority") == "1-URGENT", 100).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 0.001).otherwise(-1.0),
        "kind": F.when(F.col("o_orderstatus") == "F", "Rent").otherwise("Sale")})
    return o.select("o_orderkey", v.money_text(F.col("value"), F.col("kind")).alias("text"))


SQL["money_texts"] = """WITH o AS (SELECT o_orderkey, o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 100e0 WHEN '2-HIGH' THEN 1e0 WHEN '3-MEDIUM' THEN 0.001e0 ELSE -1e0 END AS v, o_orderstatus = 'F' AS rent FROM orders),
w AS (SELECT *, CAST(round_even(v, 0) AS BIGINT) AS whole FROM o), s AS (SELECT *, CAST(whole AS VARCHAR) AS t FROM w)
SELECT o_orderkey, CASE WHEN rent AND whole <= 0 THEN '₹0 / month' WHEN rent THEN '₹' || CASE WHEN length(t) <= 3 THEN t ELSE ltrim(reverse(regexp_replace(reverse(left(t, length(t) - 3)), '(..)', '\\1,', 'g')), ',') || ',' || right(t, 3) END || ' / month'
WHEN v <= 0 THEN '₹0' WHEN v >= 1e7 THEN '₹' || printf('%.2f', v / 1e7) || ' Cr' WHEN v >= 1e5 THEN '₹' || printf('%.2f', v / 1e5) || ' Lakh' WHEN v >= 1e3 THEN '₹' || printf('%.2f', v / 1e3) || ' Thousand' ELSE '₹' || printf('%.0f', v) END AS text FROM s"""


@query
def request_stream(spark, d):
    """The request table as a file stream, validated, scored and logged; what the log then holds."""
    from ..streaming.score_stream import score_stream

    root = scratch_path(spark, "stream")
    _requests(spark, d).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    q = score_stream(stream, _predict, f"{root}/log", f"{root}/rejects", f"{root}/cp", "v2")
    q.awaitTermination()
    log, rejects = spark.read.parquet(f"{root}/log"), spark.read.parquet(f"{root}/rejects")
    a = log.groupBy(F.col("city").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted_price"), 1).alias("mean_price"))
    b = rejects.select(F.explode("problems").alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("mean_price"))
    return a.unionByName(b)


SQL["request_stream"] = f"""WITH {_REQ_SQL}, s AS (SELECT *, greatest(0, (1 + area * 4000) * exp(-0.01e0 * bed) - 1) AS price FROM chk WHERE problems = '')
SELECT city AS what, count(*) AS n, round(avg(price), 1) AS mean_price FROM s GROUP BY city
UNION ALL SELECT x, count(*), NULL FROM (SELECT unnest(string_split(problems, '|')) AS x FROM chk WHERE problems <> '') GROUP BY x"""


@query
def evaluation_table(spark, d):
    """Metrics per segment written twice for one time and once for another: two parts remain."""
    m = metrics.regression_metrics(_predicted(spark, d), "y", "p", ["o_orderstatus"]).select(
        F.lit("v1").alias("version"), F.col("o_orderstatus").alias("transact_type"), *[F.round(c, k).alias(c) for c, k in _ROUND.items()])
    path = scratch_path(spark, "evaluation")
    for at in ("t1", "t2", "t1"):
        sinks.write_evaluation(m.withColumn("evaluated_at", F.lit(at)), path)
    return spark.read.parquet(path).select("transact_type", "evaluated_at", "r2", "mae")


SQL["evaluation_table"] = f"""WITH {_PRED_SQL}, m AS (SELECT o_orderstatus AS transact_type, {_METRIC_SQL} FROM pred GROUP BY 1) SELECT transact_type, t AS evaluated_at, r2, mae FROM m, (VALUES ('t1'), ('t2')) x(t)"""
