import math
import random

import pytest
from pyspark.sql import functions as F

from brickfold.operators import encoders, explain, features, geo, market, metrics, models, registry, scoring, split
from brickfold.operators.outliers import not_outlier

ENC = "city string, locality string, price_per_sqft double, price_inr double, is_outlier boolean, k int"


def encoded(spark, rows, **kw):
    df = spark.createDataFrame(rows, ENC)
    s, p = encoders.fit(df, ["city", "locality"], ["price_inr", "price_per_sqft"], "price_per_sqft", not_outlier())
    return {r["k"]: r for r in encoders.encode_locality(kw.pop("onto", df), s, p, **kw).collect()}


def test_leave_one_out_mean_of_ten(spark):
    got = encoded(spark, [("c", "l", float(i), 100.0 * i, False, i) for i in range(1, 11)])
    assert got[6]["locality_avg_price_sqft"] == pytest.approx((55 - 6) / 9)
    prior = 5.5
    assert got[6]["locality_smoothed_price"] == pytest.approx((5500 - 600 + 20 * prior) / (9 + 20))
    assert got[6]["locality_listing_count"] == 10


def test_loo_sums_back_to_the_group(spark):
    r = random.Random(2)
    rows = [("c", f"l{i % 3}", r.random(), r.random(), False, i) for i in range(30)]
    got = encoded(spark, rows)
    for loc in ("l0", "l1", "l2"):
        mine = [x for x in got.values() if x["locality"] == loc]
        total = sum(x["price_per_sqft"] for x in mine)
        assert all(x["locality_avg_price_sqft"] * (len(mine) - 1) + x["price_per_sqft"] == pytest.approx(total) for x in mine)


def test_singletons_outlier_groups_unseen_and_null_keys(spark):
    rows = [("c", "one", 9.0, 90.0, False, 1), ("c", "out", 1.0, 10.0, True, 2), ("c", None, 3.0, 30.0, False, 3), ("c", None, 5.0, 50.0, False, 4), (None, "one", 8.0, 80.0, False, 5)]
    df = spark.createDataFrame(rows, ENC)
    onto = df.unionByName(spark.createDataFrame([("c", "new", 7.0, 70.0, False, 6), ("d", "new", None, None, False, 7)], ENC))
    got = encoded(spark, rows, onto=onto)
    prior = (9 + 3 + 5) / 3
    assert got[1]["locality_avg_price_sqft"] is None and got[1]["locality_smoothed_price"] == pytest.approx(prior)
    assert got[2]["locality_listing_count"] == 0 and got[2]["locality_avg_price_sqft"] == pytest.approx(prior)
    assert got[3]["locality_avg_price_sqft"] == 5.0 and got[4]["locality_avg_price_sqft"] == 3.0
    assert got[6]["locality_smoothed_price"] == pytest.approx((-70 + 20 * prior) / 19)
    assert got[7]["locality_avg_price_sqft"] == 0.0 and got[7]["locality_smoothed_price"] is None
    assert got[5]["locality_smoothed_price"] == 0.0


def test_sector_encoding(spark):
    rows = [("c", "s", float(i), 0.0, False, i) for i in range(1, 4)] + [("c", "t", 10.0, 0.0, False, 4)]
    df = spark.createDataFrame(rows, ENC).withColumnRenamed("locality", "sector")
    s, p = encoders.fit(df, ["city", "sector"], ["price_per_sqft"], "price_per_sqft")
    got = {r["k"]: r["sector_smoothed_price"] for r in encoders.encode_sector(df, s, p).collect()}
    assert got[2] == pytest.approx((6 - 2 + 20 * 4.0) / 22) and got[4] == 4.0


def test_fit_without_rows_raises(spark):
    with pytest.raises(ValueError):
        encoders.fit(spark.createDataFrame([("c", "l", 1.0, 1.0, True, 1)], ENC), ["city"], ["price_inr"], "price_inr", not_outlier())


def test_split_is_exact_stable_and_key_bound(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("city"))
    a = split.protocol_split(df, ["city"], F.col("id"))
    sizes = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sizes == {"train": 1400, "val": 300, "test": 300}
    per = a.groupBy("city").agg(F.avg((F.col("split") == "train").cast("int")).alias("t")).collect()
    assert all(abs(r["t"] - 0.7) < 0.01 for r in per)
    b = split.stratified_split(df.repartition(13), ["city"], F.col("id"))
    assert a.select("id", "split").exceptAll(b.select("id", "split")).isEmpty()
    copies = split.stratified_split(df.unionByName(df.filter("id < 50")), ["city"], F.col("id"))
    assert copies.groupBy("id").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    with pytest.raises(ValueError):
        split.protocol_split(df, ["city"], F.col("id"), seed=7)


def test_small_segments_and_single_label(spark):
    df = spark.createDataFrame([("Sale",)] * 600 + [("rent",)] * 10, "t string")
    got = {r["t"]: (r["skipped"], r["reason"]) for r in split.segment_status(df, "t").collect()}
    assert got == {"Sale": (False, ""), "rent": (True, "n=10 < 500")}
    assert split.route(df, "t", "RENT").count() == 10 and split.route(df, "t", "RENT", exact=True).count() == 0
    assert split.single_label(df.filter("t = 'Sale'"), "t") == "Sale"
    with pytest.raises(ValueError):
        split.single_label(df, "t")


def test_metrics(spark):
    df = spark.createDataFrame([("a", math.log1p(100), math.log1p(110)), ("a", math.log1p(200), math.log1p(190)), ("b", math.log1p(5), math.log1p(5))], "s string, y double, p double")
    m = {r["s"]: r for r in metrics.regression_metrics(df, "y", "p", ["s"]).collect()}
    assert m["a"]["mae"] == pytest.approx(10) and m["a"]["rmse"] == pytest.approx(10) and m["a"]["r2"] == pytest.approx(1 - 200 / 5000)
    assert m["a"]["mape"] == pytest.approx(7.5) and m["a"]["within_tol"] == 1.0 and m["b"]["mae"] == pytest.approx(0)
    none = metrics.regression_metrics(df.filter("false"), "y", "p").first()
    assert none["within_tol"] == 0.0 and none["n"] == 0
    s = metrics.split_and_slice_metrics(df.withColumn("split", F.lit("test")), "y", "p", "split", "s").collect()
    assert {(r["s"], r["n"], r["is_total"], r["small_sample"]) for r in s} == {(None, 3, True, True), ("a", 2, False, True), ("b", 1, False, True)}


def test_version_comparison_directions(spark):
    old = spark.createDataFrame([("sale", "r2", 0.5), ("sale", "mae", 100.0), ("sale", "rmse", 0.0)], "t string, metric string, value double")
    new = spark.createDataFrame([("sale", "r2", 0.75), ("sale", "mae", 60.0), ("sale", "rmse", 1.0)], "t string, metric string, value double")
    got = {r["metric"]: (r["improvement_pct"], r["target_met"]) for r in metrics.compare_versions(old, new, ["t"]).collect()}
    assert got == {"r2": (50.0, True), "mae": (40.0, True)}


def test_macro_scores(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("z", "y")], "a string, p string")
    r = metrics.macro_scores(df, "a", "p").first()
    assert r["precision"] == pytest.approx((1 + 1 / 3 + 0) / 3) and r["recall"] == pytest.approx((0.5 + 1 + 0) / 3) and r["labels"] == 3


def test_winner(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("b", 1.0, 5.0), ("c", 1.0, 4.0), ("d", 1.0, 4.0)], "model string, rmse double, mae double")
    assert registry.pick_winner(df).first()["model"] == "c"
    assert registry.pick_winner(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        registry.pick_winner(df.drop("mae"))


def test_row_features_and_frame(spark):
    df = spark.createDataFrame([(1, 100.0, 0.0, 2, 3, 4, 0, "Old Property", ["Lift", "Gym", "Lift"]), (2, 100.0, 50.0, 0, 3, 4, 8, "x", None)],
                               "k int, price_inr double, built_up_area double, bedRoom int, bathroom int, floor_num int, total_floor int, agePossession string, amenities_list array<string>")
    assert features.top_amenities(df) == ["Lift", "Gym"]
    r = {x["k"]: x for x in features.add_row_features(df).collect()}
    assert (r[1]["price_per_sqft"], r[1]["floor_ratio"], r[1]["bath_bed_ratio"], r[1]["age_bucket_ord"], r[1]["n_amenities"], r[1]["has_lift"], r[1]["top_amenities_count"]) == (None, None, 1.5, 4, 3, True, 2)
    assert (r[2]["price_per_sqft"], r[2]["floor_ratio"], r[2]["area_per_bedroom"], r[2]["age_bucket_ord"], r[2]["n_amenities"], r[2]["has_gym"]) == (2.0, 0.5, None, None, 0, False)
    with pytest.raises(ValueError, match="sector"):
        features.feature_frame(df)
    full = df.withColumns({c: F.lit(None).cast("string") for c in features.INPUT_FIELDS if c not in df.columns and c != "amenities"} | {"is_outlier": F.lit(False), "was_missing_k": F.lit(True)})
    f = features.feature_frame(full, extra=("k",))
    assert f.columns == ["k", *features.INPUT_FIELDS, *features.ENGINEERED, "has_gym", "has_lift"]


def test_distances(spark):
    df = spark.createDataFrame([("Mumbai", 19.0760, 72.8777), ("Mumbai", None, 1.0), ("Paris", 1.0, 1.0)], "city string, latitude double, longitude double")
    r = geo.add_distances(df, geo.centres_table(spark), geo.stations_table(spark)).collect()
    assert r[0]["distance_to_cbd_km"] == 0 and r[0]["distance_to_nearest_metro_km"] == 0
    assert r[1]["distance_to_cbd_km"] is None and r[1]["distance_to_nearest_metro_km"] is None and r[2]["distance_to_cbd_km"] is None


def test_preprocessor(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "Low", "a"), (3.0, "High", "b"), (None, "odd", None)], "x double, lux string, c string")
    p = models.fit_preprocessor(df, ["x"], {"lux": {"Low": 0, "High": 2}}, ["c"], extra=("x",))
    assert p.names == ["num__x", "ord__lux", "cat__c_b", "extra__x"]
    rows = [list(r["features"].toArray()) for r in p.transform(df).collect()]
    assert rows == [[-1.0, 0.0, 0.0, 1.0], [1.0, 2.0, 1.0, 3.0], [0.0, -1.0, 0.0, 0.0]]
    p.save(spark, str(tmp_path / "p"))
    assert models.Preprocessor.load(spark, str(tmp_path / "p")) == p


def test_candidates_learn_a_line(spark):
    df = spark.range(400).select((F.col("id") % 40).cast("double").alias("x"), "id").withColumn("label", 3 + 0.05 * F.col("x")).withColumn("split", F.when(F.floor(F.col("id") / 40) % 4 == 0, "val").otherwise("train"))
    p = models.fit_preprocessor(df, ["x"], {}, [])
    m = p.transform(df)
    got, fitted = models.sweep(m.filter("split = 'train'"), m, {k: v for k, v in models.candidates(trees=5, rounds=5).items() if k != "lasso"})
    r2 = {(r["model"], r["split"]): r["r2"] for r in got.collect()}
    assert r2[("linear", "val")] > 0.999 and r2[("random_forest", "val")] > 0.9 and len(r2) == 8
    assert models.importances(spark, fitted["random_forest"], p.names, "rf").first()["feature"] == "num__x"
    with pytest.raises(ValueError):
        models.make_estimator("xgb")


def test_hash_rank_is_a_permutation(spark):
    r = [x["pos"] for x in models.hash_rank(spark.range(500), F.col("id"), "s", "pos").orderBy("id").collect()]
    assert sorted(r) == list(range(1, 501)) and r != sorted(r)


def test_permutation_importance_finds_the_used_feature(spark):
    df = spark.range(300).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("label", F.col("a") * 10)
    df = spark.createDataFrame(df.collect(), df.schema)
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(df, "id", ["a", "b"], "label", lambda x: x.withColumn("prediction", F.col("a") * 10), repeats=2, log_scale=False).collect()}
    assert got["a"] > 1 and got["b"] == 0


def test_contributions(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0, 0.0), (2, 0.0, 0.0, None)], "k int, a double, b double, c double")
    c = explain.linear_contributions({x: F.col(x) for x in "abc"}, {"a": 1.0, "b": -3.0, "c": 2.0}, {"a": 0.0, "b": 0.0, "c": 0.0})
    tops = df.select("k", explain.top_contributions(c, 2).alias("t"))
    r = {(x["k"], x["position"]): x for x in explain.contribution_rows(tops, "t").collect()}
    assert [(r[1, i]["feature"], r[1, i]["impact"], r[1, i]["direction"], round(r[1, i]["pct"], 3)) for i in (0, 1)] == [("a", 5.0, "up", 1.0), ("b", -3.0, "down", -0.6)]
    assert [(r[2, i]["shown_as"], r[2, i]["direction"], r[2, i]["pct"]) for i in (0, 1)] == [("neutral", "down", 0.0)] * 2
    assert {tuple(x) for x in explain.direction_counts(tops, "t", ["k"], 2).collect()} == {(1, 1, 1), (2, 0, 2)}
    labels = explain.with_labels(spark.createDataFrame([("num__bedRoom",), ("zz",)], "feature string"), explain.static_labels(spark))
    assert {x["feature"]: x["label"] for x in labels.collect()} == {"num__bedRoom": "Bedrooms", "zz": "zz"}


def test_registry(spark):
    reg = spark.createDataFrame([("m", "1", "g", 1, 3), ("m", "2", "g", 2, 1), ("n", "1", "g", 3, 2)], "model_name string, version string, git_commit string, id int, training_date int")
    assert registry.new_rows(reg, reg).isEmpty()
    more = spark.createDataFrame([("m", "2", "other", 9, 9)] * 2, reg.schema)
    assert registry.new_rows(reg, more).count() == 1 and registry.new_rows(reg, more, registry.MODEL_KEY).isEmpty()
    acts = spark.createDataFrame([("m", "1", 1), ("m", "2", 2), ("m", "7", 3)], "model_name string, version string, activated_at int")
    assert [(r["model_name"], r["version"]) for r in registry.active_models(reg, acts).collect()] == [("m", "2")]
    assert [r["id"] for r in registry.list_models(reg, limit=0).collect()] == [1]
    assert [r["id"] for r in registry.list_models(reg, "m").collect()] == [1, 2]
    named = spark.createDataFrame([("price_v2",), ("price_v10",), ("other_v1",), ("bad",)], "artifact string")
    assert {r["model_name"]: r["next_version"] for r in registry.next_version(named).collect()} == {"price": 11, "other": 2}


REQ = ("request_id int, city string, sector string, property_type string, transact_type string, bedRoom int, bathroom int, balcony string, agePossession string, built_up_area double, "
       "servant_room boolean, store_room boolean, furnishing_type string, floor_category string, facing string, amenities array<string>, luxury_category string")
GOOD = (1, " Mumbai ", "S1", "flat", "Sale", 3, 2, "3+", "New Property", 1200.0, True, False, "Furnished", "Low Floor", "North", ["a", "b"], "High")


def test_requests(spark):
    bad = (2, "  ", "S1", "castle", "Sale", 9, 2, "3+", "New Property", 0.0, None, False, "Furnished", "Low Floor", None, None, None)
    c = scoring.validate_requests(spark.createDataFrame([GOOD, bad], REQ))
    r = {x["request_id"]: x for x in c.collect()}
    assert r[1]["problems"] == [] and r[1]["city"] == "Mumbai" and "luxury_category" not in c.columns
    assert r[2]["problems"] == ["city is empty", "property_type is not an accepted label", "facing is not an accepted label", "built_up_area is out of range", "servant_room is missing", "bathroom too low for bedroom count"]
    ok = scoring.valid_requests(c).first()
    assert ok["luxury_category"] == "Medium"
    with pytest.raises(ValueError, match="hack"):
        scoring.validate_requests(spark.createDataFrame([GOOD], REQ).withColumn("hack", F.lit(1)))
    s = scoring.price_columns(scoring.valid_requests(c).withColumn("prediction", F.lit(math.log1p(100.0)))).first()
    assert (s["predicted_price"], s["range_low"], s["range_high"], s["is_outlier_input"]) == (pytest.approx(100), pytest.approx(85), pytest.approx(115), False)
    low = scoring.price_columns(scoring.valid_requests(c).withColumn("prediction", F.lit(-3.0))).first()
    assert low["predicted_price"] == 0.0 and low["range_low"] == 0.0


def test_stream_matches_batch_and_replay_is_safe(spark, tmp_path):
    from brickfold.streaming.score_stream import score_stream

    src = str(tmp_path / "in")
    predict = lambda x: x.withColumn("prediction", F.log1p(F.col("built_up_area")))
    base = spark.createDataFrame([GOOD], REQ)
    args = (f"{tmp_path}/log", f"{tmp_path}/rej", f"{tmp_path}/cp", "v9")
    for i in range(2):
        base.withColumn("request_id", F.lit(i)).withColumn("bedRoom", F.lit(3 if i else 99)).write.mode("append").parquet(src)
        score_stream(spark.readStream.schema(base.schema).parquet(src), predict, *args).awaitTermination()
    log = spark.read.parquet(args[0])
    assert log.count() == 1 and log.first()["predicted_price"] == pytest.approx(1200) and log.first()["model_version"] == "price_model_v9"
    assert spark.read.parquet(args[1]).first()["problems"] == ["bedRoom is out of range", "bathroom too low for bedroom count"]


def test_tiers_and_verdicts(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 9)] + [("b", 1.0), ("a", None)], "c string, v double")
    b = market.tier_bounds(df.filter("c = 'a'"), "c", "v")
    got = [(r["c"], r["v"], r["price_tier"]) for r in market.price_tier(df, b, "c", "v").collect()]
    assert ("a", 1.0, "Budget") in got and ("a", 8.0, "Luxury") in got and ("b", 1.0, None) in got and ("a", None, None) in got
    v = spark.createDataFrame([(89.0, 100.0), (100.0, 100.0), (111.0, 100.0), (1.0, 0.0)], "a double, p double").select(market.deal_verdict(F.col("a"), F.col("p")).alias("d")).collect()
    assert [r["d"] for r in v] == ["Good Deal", "Fair", "Overpriced", None]


def test_split_with_missing_keys_and_unlucky_names(spark):
    """Rows without key spread over the sides by their values; a stratum may be called like any inner column."""
    from brickfold.operators import split

    df = spark.range(2000).select(F.lit("x").alias("c"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.lit(1).alias("h"), F.col("id").alias("own"), F.array("id").alias("list"))
    out = split.stratified_split(df, ["c"], F.col("k"))
    for rows, n in ((out, 2000), (out.filter("k IS NULL"), 1000)):
        sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
        assert sum(sizes.values()) == n and all(abs(sizes[s] / n - share) < 0.05 for s, share in split.SHARES.items())
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 1400, "val": 300, "test": 300}
    assert out.columns == ["c", "k", "h", "own", "list", "split"]
    assert sorted(out.collect(), key=repr) == sorted(split.stratified_split(df.repartition(7), ["c"], F.col("k")).collect(), key=repr)


def test_registered_training_is_not_cut(spark, monkeypatch):
    """All segments, all candidates and full tree counts reach the estimators; the fits themselves are left out."""
    import os

    import pytest

    from brickfold.operators import models
    from brickfold.plans import training
    from brickfold.workload import loading, modelling

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    asked, fitted, segments = [], [], []

    def sizes(pool):
        return {n: e.getNumTrees() if n == "random_forest" else e.getMaxIter() for n, e in pool.items() if n in ("random_forest", "gradient_boosting")} | {"all": len(pool)}

    def no_sweep(train, scored, pool):
        asked.append(sizes(pool))
        return spark.createDataFrame([("linear", "val", 0.5)], "model string, split string, r2 double"), {}

    class NoFit:
        def __init__(self, name, estimator):
            self.name, self.estimator = name, estimator

        def fit(self, train):
            fitted.append((self.name, sizes({self.name: self.estimator})[self.name]))

    def no_train(df, segment, **kw):
        segments.append((segment, kw))
        return no_sweep(df, df, models.candidates())[0], {"model": "linear"}, {}, models.Preprocessor({})

    made = models.make_estimator
    monkeypatch.setattr(models, "sweep", no_sweep)
    monkeypatch.setattr(models, "make_estimator", lambda n, **kw: NoFit(n, made(n, **kw)))
    monkeypatch.setattr(models, "importances", lambda spark, m, names, method: spark.createDataFrame([(method, n, 0.1) for n in names], "method string, feature string, importance double"))
    monkeypatch.setattr(training, "train", no_train)
    modelling.candidate_sweep(spark, folder)
    assert asked[0] == {"random_forest": 200, "gradient_boosting": 200, "all": 5}
    inputs = {r.feature for r in modelling.tree_importance(spark, folder).collect()}
    assert fitted == [("random_forest", 200), ("gradient_boosting", 200)] and {"num__p_retailprice", "num__l_tax"} <= inputs and any(x.startswith("cat__city") for x in inputs)
    assert {r.segment for r in loading.train_and_pick(spark, folder).collect()} == {"rent", "sale"}
    assert segments == [("rent", {}), ("sale", {})]


def test_training_rows_are_dealt_to_every_core(spark, tmp_path):
    """A matrix of one row group kept a whole forest on one core."""
    from brickfold.session import spread
    from brickfold.workload import modelling

    cores = spark.sparkContext.defaultParallelism
    folder = str(tmp_path)
    spark.range(8000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id % 50 AS l_partkey", "id % 9 AS l_suppkey", "'A' AS l_returnflag", "'O' AS l_linestatus", "id * 1.5D AS l_extendedprice",
                                 "1D + id % 50 AS l_quantity", "0.01D * (id % 11) AS l_discount", "0.01D * (id % 9) AS l_tax", "date'1995-01-01' AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(50).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size", "id * 2D AS p_retailprice", "'SMALL' AS p_type", "'b' AS p_brand").write.parquet(f"{folder}/part.parquet")
    matrix, _ = modelling._matrix(spark, folder)
    held = [r["n"] for r in matrix.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(held) == 8000 and len(held) >= cores and max(held) < 2 * 8000 / cores
    copies = spark.range(10).selectExpr("id % 2 AS k", "cast(NULL AS string) AS t")
    assert sorted(r["k"] for r in spread(copies).collect()) == [0] * 5 + [1] * 5 and spread(copies.filter("k > 5")).count() == 0


def test_fits_cut_their_lineage_in_the_scratch_folder(spark):
    models.fit_all(spark.range(3), {})
    assert spark.sparkContext.getCheckpointDir()


def test_protocol_split_is_computed_once(spark):
    """Its size check read the whole split once more than its reader did."""
    out = split.protocol_split(spark.range(200).selectExpr("id", "'c' AS city"), ["city"], F.col("id"))
    assert out.inputFiles() and out.filter("split = 'train'").count() == 140
