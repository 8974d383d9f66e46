"""Registered queries: models trained, saved, read back, scored, explained, checked and validated fold by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import direction
from ..operators import explain, linear, market, metrics, models, registry, split
from ..plans import serving, training
from ..session import scratch_path, written
from ..sources import artifacts
from ..streaming.score_stream import score_stream_saved
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- a listing table, its models, and requests -----------------------------------------------------

INPUTS = {"numeric": ("built_up_area", "sector_smoothed_price"), "ordinals": {}, "one_hot": ()}


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a clean listing table: the status is the city, the customer gives the sector."""
    texts = ("property_type", "balcony", "agePossession", "furnishing_type", "luxury_category", "floor_category", "facing")
    return table(spark, d, "orders").selectExpr(
        "cast(o_orderkey AS string) AS listing_id", "o_orderstatus AS city", "concat('S', cast(o_custkey % 7 AS string)) AS locality", "concat('S', cast(o_custkey % 7 AS string)) AS sector",
        "CASE WHEN o_orderpriority < '4' THEN 'Sale' ELSE 'Rent' END AS transact_type", "cast(300 + o_orderkey * 13 % 1700 AS double) AS built_up_area", "o_totalprice AS price_inr",
        "o_totalprice / (300 + o_orderkey * 13 % 1700) AS price_per_sqft", "o_totalprice > 450000 AS is_outlier", "2 AS bedRoom", "1 AS bathroom", "false AS servant_room", "false AS store_room",
        "cast(NULL AS array<string>) AS amenities_list", "cast(NULL AS double) AS latitude", "cast(NULL AS double) AS longitude",
    ).withColumns({c: F.lit(None).cast("string") for c in texts})


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Customers as requests: some sectors, one city in four and some areas are unknown to the models or invalid."""
    return table(spark, d, "customer").selectExpr(
        "c_custkey AS request_id", "elt(cast(c_nationkey % 4 AS int) + 1, 'F', 'O', 'P', 'X') AS city", "concat('S', cast(c_custkey % 9 AS string)) AS sector", "'flat' AS property_type",
        "CASE WHEN c_mktsegment < 'C' THEN 'Sale' WHEN c_mktsegment < 'M' THEN 'Rent' ELSE 'Sale' END AS transact_type", "2 AS bedRoom", "1 AS bathroom", "'1' AS balcony", "'New Property' AS agePossession",
        "c_acctbal / 4 AS built_up_area", "false AS servant_room", "false AS store_room", "'Furnished' AS furnishing_type", "'Mid Floor' AS floor_category", "'North' AS facing", "array('a', 'b') AS amenities")


def _saved(spark, d) -> str:
    """A folder with the linear model of each transaction type, trained on the whole listing table and read by nobody but through that folder."""
    folder = scratch_path(spark, "models")
    rows = written(listings(spark, d), "listings")
    for segment in ("sale", "rent"):
        fitted = training.fit_segment(rows, segment, only=("linear",), inputs=INPUTS)
        artifacts.save_model(fitted.artifact(segment, "v1"), spark, folder)
    return folder


def two_inputs(name: str, source: str, by: str, x1: str, x2: str, y: str, where: str = "true") -> str:
    """Least squares of y on two inputs per group, in closed form: b0, b1, b2 and the means m1, m2."""
    return f"""{name}_m AS (SELECT {by}, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, var_pop({x1}) AS v1, var_pop({x2}) AS v2, covar_pop({x1}, {x2}) AS c12, covar_pop({x1}, {y}) AS c1, covar_pop({x2}, {y}) AS c2
  FROM {source} WHERE {where} GROUP BY {by}),
{name}_b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM {name}_m),
{name} AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM {name}_b)"""


_SPLIT = """sq AS (SELECT seg, city, count(*) AS n FROM usable GROUP BY ALL),
sc AS (SELECT *, floor(n * 0.7e0) + (row_number() OVER (PARTITION BY seg ORDER BY n * 0.7e0 - floor(n * 0.7e0) DESC, city) <= round(sum(n) OVER (PARTITION BY seg) * 0.7e0) - sum(floor(n * 0.7e0)) OVER (PARTITION BY seg))::INT AS c0,
 floor(n * 0.85e0) + (row_number() OVER (PARTITION BY seg ORDER BY n * 0.85e0 - floor(n * 0.85e0) DESC, city) <= round(sum(n) OVER (PARTITION BY seg) * 0.85e0) - sum(floor(n * 0.85e0)) OVER (PARTITION BY seg))::INT AS c1 FROM sq),
parts AS (SELECT u.*, CASE WHEN row_number() OVER (PARTITION BY seg, city ORDER BY md5('42|' || key)) <= c0 THEN 'train' WHEN row_number() OVER (PARTITION BY seg, city ORDER BY md5('42|' || key)) <= c1 THEN 'val' ELSE 'test' END AS split
  FROM usable u JOIN sc USING (seg, city))"""
_MODEL_SQL = f"""usable AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS city, 'S' || (o_custkey % 7) AS sector, CASE WHEN o_orderpriority < '4' THEN 'sale' ELSE 'rent' END AS seg,
  CAST(300 + o_orderkey * 13 % 1700 AS DOUBLE) AS area, o_totalprice AS price, o_totalprice / (300 + o_orderkey * 13 % 1700) AS unit FROM orders WHERE NOT o_totalprice > 450000),
{_SPLIT},
st AS (SELECT seg, city, sector, count(*) AS m, sum(unit) AS su FROM parts WHERE split = 'train' GROUP BY ALL), pr AS (SELECT seg, city, avg(unit) AS prior FROM parts WHERE split = 'train' GROUP BY ALL),
x AS (SELECT p.*, ln(1 + price) AS y, CASE WHEN m >= 2 THEN (su - unit + 20 * prior) / (m - 1 + 20) ELSE prior END AS sec FROM parts p LEFT JOIN st USING (seg, city, sector) LEFT JOIN pr USING (seg, city)),
{two_inputs('fit', 'x', 'seg', 'area', 'sec', 'y', "split = 'train'")}"""
_ASKED_SQL = f"""{_MODEL_SQL},
asked AS (SELECT c_custkey AS request_id, CASE c_nationkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE 'X' END AS city, 'S' || (c_custkey % 9) AS sector,
  CASE WHEN c_mktsegment < 'C' THEN 'sale' WHEN c_mktsegment < 'M' THEN 'rent' ELSE 'sale' END AS seg, c_acctbal / 4 AS area FROM customer),
priced AS (SELECT a.*, CASE WHEN prior IS NULL THEN m2 WHEN m >= 1 THEN (su + 20 * prior) / (m + 20) ELSE prior END AS sec, b0, b1, b2, m1, m2, fit.my
  FROM asked a JOIN fit USING (seg) LEFT JOIN pr USING (seg, city) LEFT JOIN st USING (seg, city, sector) WHERE area > 0 AND area <= 20000),
told AS (SELECT *, greatest(0, exp(b0 + b1 * area + b2 * sec) - 1) AS price FROM priced)"""


@query
def saved_scoring(spark, d):
    """Sale and Rent models trained, written, read back and used on a request table."""
    scored, _ = serving.score_requests(requests(spark, d), _saved(spark, d))
    return scored.select("request_id", F.lower("transact_type").alias("segment"), "version", *[F.round(c, 1).alias(c) for c in ("predicted_price", "range_low", "range_high")])


SQL["saved_scoring"] = f"""WITH {_ASKED_SQL} SELECT request_id, seg AS segment, 'v1' AS version, round(price, 1) AS predicted_price, round(price * 0.85e0, 1) AS range_low, round(price * 1.15e0, 1) AS range_high FROM told"""


@query
def saved_scoring_stream(spark, d):
    """The same requests as a file stream: the log rows, and the rejected requests with their reasons."""
    folder, root = _saved(spark, d), scratch_path(spark, "stream")
    requests(spark, d).repartition(6, "request_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    q = score_stream_saved(stream, folder, f"{root}/log", f"{root}/rejects", f"{root}/checkpoint")
    q.awaitTermination()
    area = F.get_json_object("input_features_json", "$.built_up_area").cast("double")
    log = spark.read.parquet(f"{root}/log").select("city", F.col("locality").alias("sector"), F.round(area, 4).alias("area"), F.round("predicted_price", 1).alias("predicted_price"), "model_version", F.lit(None).cast("long").alias("request_id"), F.lit(None).cast("string").alias("problem"))
    none = {"city": "string", "sector": "string", "area": "double", "predicted_price": "double", "model_version": "string"}
    rejects = spark.read.parquet(f"{root}/rejects").select(*[F.lit(None).cast(t).alias(c) for c, t in none.items()], "request_id", F.explode("problems").alias("problem"))
    return log.unionByName(rejects)


SQL["saved_scoring_stream"] = f"""WITH {_ASKED_SQL} SELECT city, sector, round(area, 4) AS area, round(price, 1) AS predicted_price, 'price_model_v1' AS model_version, CAST(NULL AS BIGINT) AS request_id, NULL AS problem FROM told
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, request_id, 'built_up_area is out of range' FROM asked WHERE NOT (area > 0 AND area <= 20000)"""


@query
def saved_contributions(spark, d):
    """What each input adds to each scored request, largest first, and whether these and the base make up the prediction."""
    scored, _ = serving.score_requests(requests(spark, d), _saved(spark, d), explain_top=7)
    total = F.aggregate("contributions", F.col("base"), lambda s, c: s + c["impact"])
    own = scored.select("request_id", F.lower("transact_type").alias("segment"), (F.abs(total - F.col("prediction")) < 1e-9).alias("adds_up"), "contributions")
    out = explain.contribution_rows(own, "contributions")
    impact = F.round("impact", 7)
    return out.select("request_id", "segment", "adds_up", "position", "feature", impact.alias("impact"), direction(impact, neutral=True).alias("direction"))


SQL["saved_contributions"] = f"""WITH {_ASKED_SQL}, c AS (SELECT request_id, seg AS segment, unnest([{{'feature': 'num__built_up_area', 'impact': b1 * (area - m1)}}, {{'feature': 'num__sector_smoothed_price', 'impact': b2 * (sec - m2)}}]) AS c FROM told),
r AS (SELECT request_id, segment, c.feature AS feature, c.impact AS impact, row_number() OVER (PARTITION BY request_id ORDER BY abs(c.impact) DESC, c.feature) - 1 AS position FROM c)
SELECT request_id, segment, true AS adds_up, CAST(position AS INTEGER) AS position, feature, round(impact, 7) AS impact, CASE WHEN round(impact, 7) > 0 THEN 'up' WHEN round(impact, 7) < 0 THEN 'down' ELSE 'neutral' END AS direction FROM r"""


@query
def saved_impact_summary(spark, d):
    """Mean absolute impact over the 200 requests that come first in hash order, per model, weightiest inputs first, under the encoder's labels."""
    folder = _saved(spark, d)
    models_ = serving.ModelStore(spark, folder).current()
    valid, _ = serving.split_by_model(serving.validate_requests(requests(spark, d)), models_)
    out = None
    for segment, m in sorted(models_.items()):
        own = serving.predict(valid.filter(F.lower("transact_type") == segment), m, len(m.encoder.names))
        labels = explain.encoder_labels(spark, tuple(m.encoder.numeric), tuple(m.encoder.ordinals), m.encoder.categories, m.encoder.extra)
        top = explain.impact_summary(explain.summary_sample(own, F.col("request_id")), "contributions", labels)
        part = top.select(F.lit(segment).alias("segment"), "rank", "feature", "label", F.round("mean_abs_impact", 7).alias("mean_abs_impact"))
        out = part if out is None else out.unionByName(part)
    return out


SQL["saved_impact_summary"] = f"""WITH {_ASKED_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY md5('42|' || request_id)) AS rn FROM told),
c AS (SELECT seg, unnest([{{'feature': 'num__built_up_area', 'label': 'Built-up Area (sqft)', 'impact': b1 * (area - m1)}}, {{'feature': 'num__sector_smoothed_price', 'label': 'Sector Average Price (smoothed)', 'impact': b2 * (sec - m2)}}]) AS c FROM s WHERE rn <= 200),
g AS (SELECT seg, c.feature AS feature, c.label AS label, avg(abs(c.impact)) AS v FROM c GROUP BY ALL)
SELECT seg AS segment, CAST(row_number() OVER (PARTITION BY seg ORDER BY v DESC, feature) AS INTEGER) AS rank, feature, label, round(v, 7) AS mean_abs_impact FROM g"""


_CHECKED_SQL = f"""{_MODEL_SQL}, pred AS (SELECT x.seg, city, split, price AS v, exp(b0 + b1 * area + b2 * sec) - 1 AS p FROM x JOIN fit USING (seg)),
slices AS (SELECT seg AS segment, split, city, grouping(city) = 1 AS is_total, count(*) < 30 AS small_sample, count(*) AS n, 1 - sum((p - v) * (p - v)) / (var_pop(v) * count(*)) AS r2, avg(abs(p - v)) AS mae, sqrt(avg((p - v) * (p - v))) AS rmse,
  avg(abs(p - v) / greatest(v, 1)) * 100 AS mape, avg(CASE WHEN abs(p - v) / greatest(v, 1) <= 0.15e0 THEN 1e0 ELSE 0 END) AS within_tol FROM pred GROUP BY GROUPING SETS ((seg, split), (seg, split, city)))"""


@query
def saved_gate(spark, d):
    """Verdict of each saved model over the whole listing table, with its whole summary line."""
    p95 = metrics.latency_p95(table(spark, d, "events"), "value")
    g, _ = training.gate_saved(spark, written(listings(spark, d), "listings"), _saved(spark, d), p95=p95)
    return g.select("segment", "rows", "skipped", "reason", "train", "val", "test", F.round("r2", 6).alias("r2"), F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("within_tol", 6).alias("within_tol"),
                    "ok_r2_min", "ok_r2_stretch", "ok_within_15_min", "ok_min_rows", "ok_p95_latency", "ok_overall", "summary")


SQL["saved_gate"] = f"""WITH {_CHECKED_SQL}, q AS (SELECT quantile_cont(value, 0.95) AS lat FROM events),
sz AS (SELECT seg AS segment, count(*) AS rows, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM parts GROUP BY seg),
z AS (SELECT sz.*, r2, mae, rmse, within_tol, lat, r2 >= 0.8 AND within_tol >= 0.7 AND lat <= 300 AS good FROM sz JOIN slices s ON sz.segment = s.segment AND s.split = 'test' AND s.is_total, q)
SELECT segment, rows, false AS skipped, '' AS reason, train, val, test, round(r2, 6) AS r2, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(within_tol, 6) AS within_tol, r2 >= 0.8 AS ok_r2_min, r2 >= 0.85 AS ok_r2_stretch, within_tol >= 0.7 AS ok_within_15_min,
true AS ok_min_rows, lat <= 300 AS ok_p95_latency, good AS ok_overall, CASE WHEN good THEN '[PASS] ' ELSE '[FAIL] ' END || segment || printf(' R²=%.4f (≥0.80) MAE=₹%.0f within±15%%=%.1f%% (≥70%%) latency_p95=', r2, mae, within_tol * 100) || printf('%.1f', lat) || 'ms (<300ms)' AS summary FROM z"""


@query
def saved_gate_slices(spark, d):
    """The metrics behind those verdicts, per split and per (split, city), thin slices marked."""
    _, s = training.gate_saved(spark, written(listings(spark, d), "listings"), _saved(spark, d))
    return s.select("segment", "split", "city", "is_total", "small_sample", "n", F.round("r2", 6).alias("r2"), F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mape", 4).alias("mape"), F.round("within_tol", 6).alias("within_tol"))


SQL["saved_gate_slices"] = f"WITH {_CHECKED_SQL} SELECT segment, split, city, is_total, small_sample, n, round(r2, 6) AS r2, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 4) AS mape, round(within_tol, 6) AS within_tol FROM slices"


@query
def input_improvement(spark, d):
    """Linear fits with and without the sector price, on one split of one frame, compared on the test rows."""
    rows = written(listings(spark, d), "listings")
    out = None
    for segment in ("sale", "rent"):
        c = training.compare_inputs(rows, segment, base={"numeric": ("built_up_area",), "ordinals": {}, "one_hot": ()}, added={"numeric": ("sector_smoothed_price",)})
        part = c.select(F.lit(segment).alias("segment"), "metric", F.round("old_value", 5).alias("old_value"), F.round("new_value", 5).alias("new_value"), "target_met")
        out = part if out is None else out.unionByName(part)
    return out


SQL["input_improvement"] = f"""WITH {_MODEL_SQL}, one AS (SELECT seg, c1 / v1 AS b1, my - c1 / v1 * m1 AS b0 FROM fit),
pred AS (SELECT x.seg, price AS v, exp(one.b0 + one.b1 * area) - 1 AS po, exp(fit.b0 + fit.b1 * area + fit.b2 * sec) - 1 AS pn FROM x JOIN one USING (seg) JOIN fit USING (seg) WHERE split = 'test'),
w AS (SELECT seg, {', '.join(f"1 - sum(({p} - v) * ({p} - v)) / (var_pop(v) * count(*)) AS r2_{k}, avg(abs({p} - v)) AS mae_{k}, sqrt(avg(({p} - v) * ({p} - v))) AS rmse_{k}, avg(abs({p} - v) / greatest(v, 1)) * 100 AS mape_{k}" for p, k in (('po', 'o'), ('pn', 'n')))} FROM pred GROUP BY seg),
l AS (SELECT seg, unnest([{', '.join(f"{{'metric': '{m}', 'o': {m}_o, 'n': {m}_n, 'gain': {'-1e0' if m == 'r2' else '1e0'} * ({m}_o - {m}_n)}}" for m in ('r2', 'mae', 'rmse', 'mape'))}]) AS c FROM w)
SELECT seg AS segment, c.metric AS metric, round(c.o, 5) AS old_value, round(c.n, 5) AS new_value, c.gain / abs(c.o) * 100 >= 32.5 AS target_met FROM l WHERE c.o <> 0"""


# --- folds ------------------------------------------------------------------------------------------

def _folded(spark, d) -> DataFrame:
    """lineitem with two inputs, a log price and a fold; rows of one key share a fold."""
    li = table(spark, d, "lineitem").withColumns({"key": F.concat_ws("|", "l_orderkey", "l_linenumber"), "label": F.log1p("l_extendedprice"), "x1": F.col("l_quantity").cast("double"), "x2": F.col("l_discount").cast("double")})
    return linear.with_folds(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "label", F.array("x1", "x2").alias("features"), "key"), F.col("key"))


_FOLD_SQL = f"""f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS v, ln(1 + l_extendedprice) AS y, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2,
  CAST(CAST(('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM lineitem),
others AS (SELECT k.fold AS k, f.* FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold),
{two_inputs('fit', 'others', 'k', 'x1', 'x2', 'y')},
pred AS (SELECT f.*, exp(b0 + b1 * x1 + b2 * x2) - 1 AS p FROM f JOIN fit ON f.fold = fit.k)"""


@query
def fold_metrics(spark, d):
    """Five-fold validation of least squares: all folds' fits from one pass, each row scored by the fit that never saw it."""
    m = linear.fold_metrics(linear.out_of_fold(written(_folded(spark, d), "folded")))
    return m.select("fold", "n", F.round("r2", 7).alias("r2"), F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("mape", 5).alias("mape"), F.round("within_tol", 6).alias("within_tol"))


SQL["fold_metrics"] = f"""WITH {_FOLD_SQL} SELECT fold, count(*) AS n, round(1 - sum((p - v) * (p - v)) / (var_pop(v) * count(*)), 7) AS r2, round(avg(abs(p - v)), 3) AS mae, round(sqrt(avg((p - v) * (p - v))), 3) AS rmse,
round(avg(abs(p - v) / greatest(v, 1)) * 100, 5) AS mape, round(avg(CASE WHEN abs(p - v) / greatest(v, 1) <= 0.15e0 THEN 1e0 ELSE 0 END), 6) AS within_tol FROM pred GROUP BY fold"""


@query
def out_of_fold_verdicts(spark, d):
    """Each row's class against its out-of-fold price."""
    s = linear.out_of_fold(written(_folded(spark, d), "folded"))
    price = F.expm1("prediction")
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "fold", F.round(price, 2).alias("predicted"), market.residual_class(F.col("l_extendedprice"), price).alias("verdict"))


SQL["out_of_fold_verdicts"] = f"""WITH {_FOLD_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v AS l_extendedprice, fold, round(p, 2) AS predicted,
CASE WHEN (v - p) / p <= -0.1e0 THEN 'Good Deal' WHEN (v - p) / p >= 0.1e0 THEN 'Overpriced' ELSE 'Fair Price' END AS verdict FROM pred"""


# --- labels, keys, registry -------------------------------------------------------------------------

@query
def encoder_labels(spark, d):
    """Labels of every input of an encoder fitted on the part table, a table of own labels over them."""
    p = table(spark, d, "part")
    pre = models.fit_preprocessor(p, ["p_size", "p_retailprice"], {"p_type": {"SMALL": 0}}, ["p_brand"])
    fitted = explain.encoder_labels(spark, tuple(pre.numeric), tuple(pre.ordinals), pre.categories).filter(F.col("feature").isin(pre.names))
    return explain.overlay_labels(fitted, table(spark, d, "region").selectExpr("'num__p_size' AS feature", "concat('Size ', r_name) AS label"))


SQL["encoder_labels"] = """SELECT 'num__p_size' AS feature, 'Size ' || max(r_name) AS label FROM region UNION ALL VALUES ('num__p_retailprice', 'P Retailprice'), ('ord__p_type', 'P Type')
UNION ALL SELECT 'cat__p_brand_' || p_brand, 'P: brand_' || p_brand FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand > (SELECT min(p_brand) FROM part)"""


@query
def split_without_keys(spark, d):
    """Orders of which every third has no key: rows without key spread over the sides by their values."""
    o = table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS key", "o_orderkey AS own", "o_orderstatus AS city")
    return split.stratified_split(o, ["city"], F.col("key"))


SQL["split_without_keys"] = """WITH usable AS (SELECT 1 AS seg, o_orderstatus AS city, o_orderkey AS own, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS given,
coalesce(CAST(given AS VARCHAR), 'NULL|' || md5(o_orderstatus || '|NULL|' || o_orderkey)) AS key FROM orders), """ + _SPLIT + """ SELECT given AS key, own, city, split FROM parts"""


@query
def registry_append_once(spark, d):
    """Models registered by two runs, one of them tried twice and both naming many of the same models; what the registry then holds."""
    path = scratch_path(spark, "registry")
    rows = table(spark, d, "part").selectExpr("p_brand AS model_name", "cast(p_size AS string) AS version", "p_name AS git_commit", "p_partkey AS id", "p_retailprice AS rmse")
    for run, own in (("run-1", rows.filter("id % 3 < 2")), ("run-2", rows.filter("id % 3 > 0")), ("run-1", rows.filter("id % 3 < 2"))):
        registry.append_once(own, path, run)
    return registry.read_registry(spark, path).select("model_name", "version", "git_commit", "id", "rmse", "run")


SQL["registry_append_once"] = """WITH r AS (SELECT p_brand AS model_name, CAST(p_size AS VARCHAR) AS version, p_name AS git_commit, p_partkey AS id, p_retailprice AS rmse FROM part),
w AS (SELECT *, 'run-1' AS run FROM r WHERE id % 3 < 2 UNION ALL SELECT *, 'run-2' FROM r WHERE id % 3 > 0)
SELECT model_name, version, git_commit, id, rmse, run FROM (SELECT *, row_number() OVER (PARTITION BY model_name, version, git_commit ORDER BY run, id, rmse) AS rn FROM w) WHERE rn = 1"""
