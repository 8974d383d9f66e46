"""Models trained, saved, read back, used on tables and streams, and validated fold by fold."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from brickfold.operators import explain, linear, market, metrics, models, registry, scoring
from brickfold.plans import serving, training
from brickfold.sources import artifacts
from brickfold.streaming.score_stream import score_stream_saved

INPUTS = {"numeric": ("built_up_area", "sector_smoothed_price", "locality_listing_count"), "ordinals": {"balcony": {"0": 0, "1": 1}}, "one_hot": ("city",), "extra": ("distance_to_cbd_km",)}
REQUEST = {"property_type": "flat", "balcony": "1", "agePossession": "New Property", "furnishing_type": "Furnished", "floor_category": "Mid Floor", "facing": "North"}


def listing_table(spark, n=1600, shift=0.0):
    draw = random.Random(4)
    rows = [(f"k{i}", draw.choice(["Mumbai", "Kolkata"]), f"S{draw.randrange(5)}", draw.choice(["Sale", "Rent"]), float(draw.randrange(300, 2000)), draw.choice("01")) for i in range(n)]
    df = spark.createDataFrame(rows, "listing_id string, city string, sector string, transact_type string, built_up_area double, balcony string")
    price = F.exp(F.lit(9.0 + shift) + F.col("built_up_area") / 1000 + F.substring("sector", 2, 1).cast("int") / 10 + F.when(F.col("city") == "Mumbai", 0.4).otherwise(0.0) + F.pmod(F.hash("listing_id"), F.lit(100)) / 1000)
    texts = ("property_type", "agePossession", "furnishing_type", "luxury_category", "floor_category", "facing")
    return df.withColumns({"price_inr": price, "locality": F.col("sector"), "is_outlier": F.lit(False), "bedRoom": F.lit(2), "bathroom": F.lit(1), "servant_room": F.lit(False), "store_room": F.lit(False),
                           "amenities_list": F.array(F.lit("Lift")), "latitude": F.lit(19.0), "longitude": F.lit(72.9)} | {c: F.lit(None).cast("string") for c in texts}).withColumn("price_per_sqft", F.col("price_inr") / F.col("built_up_area"))


def request_rows(spark, rows):
    """(id, city, sector, type, area) as full requests."""
    df = spark.createDataFrame(rows, "request_id long, city string, sector string, transact_type string, built_up_area double")
    return df.withColumns({c: F.lit(v) for c, v in REQUEST.items()} | {"bedRoom": F.lit(2), "bathroom": F.lit(1), "servant_room": F.lit(False), "store_room": F.lit(False), "amenities": F.array(F.lit("Lift"))})


@pytest.fixture(scope="module")
def trained(spark):
    rows = listing_table(spark).persist()
    return rows, {s: training.fit_segment(rows, s, only=("linear", "ridge"), inputs=INPUTS) for s in ("sale", "rent")}


@pytest.fixture
def folder(spark, trained, tmp_path):
    for s, t in trained[1].items():
        artifacts.save_model(t.artifact(s, "v2", "linear"), spark, str(tmp_path))
    return str(tmp_path)


ASKED = [(1, "Mumbai", "S1", "Sale", 800.0), (2, "Kolkata", "S9", "Rent", 900.0), (3, "Atlantis", "S1", "Sale", 800.0), (4, "Mumbai", "S1", "Sale", -1.0), (5, " Mumbai ", "S2", "Rent", 1500.0), (6, None, "S2", "Rent", 1500.0), (7, "Mumbai", "S1", "Lease", 800.0)]


def test_saved_model_reads_back_and_scores_the_same(spark, trained, folder):
    fitted = trained[1]["sale"].artifact("sale", "v2", "linear")
    back = artifacts.load_model(spark, folder, "sale")
    assert back.version == "v2" and back.encoder == fitted.encoder and back.means == pytest.approx(fitted.means) and list(back.amenities) == list(fitted.amenities)
    assert back.model.coefficients == fitted.model.coefficients and type(back.model) is type(fitted.model)
    for name, state in fitted.state.items():
        assert sorted(map(repr, back.state[name].collect())) == sorted(map(repr, state.select(*back.state[name].columns).collect()))
    valid, _ = serving.split_by_model(scoring.validate_requests(request_rows(spark, ASKED)), {"sale": back})
    one, two = ({r.request_id: r.prediction for r in serving.predict(valid, m).collect()} for m in (back, fitted))
    assert one == two and set(one) == {1, 3}


def test_scores_follow_the_saved_state(spark, folder):
    """An own recomputation of one row's inputs and prediction; unseen sectors take the city's prior, unseen cities count as missing."""
    scored, rejected = serving.score_requests(request_rows(spark, ASKED), folder, explain_top=20)
    got = {r.request_id: r for r in scored.collect()}
    assert set(got) == {1, 2, 3, 5}
    m = artifacts.load_model(spark, folder, "sale")
    sector = {(r.city, r.sector): r for r in m.state["sector"].collect()}
    prior = {r.city: r.prior for r in m.state["sector_prior"].collect()}
    local = {(r.city, r.locality): r.group_rows for r in m.state["locality"].collect()}

    def by_hand(city, area, smoothed, count):
        raw = {"built_up_area": area, "sector_smoothed_price": smoothed, "locality_listing_count": count}
        x = [((raw[c] - mean) / (std or 1) if raw.get(c) is not None else 0.0) if c in raw else None for c, (mean, std) in m.encoder.numeric.items()]
        x = [1.0 if v is None and m.encoder.numeric[c][0] == 0.0 else 0.0 if v is None else v for c, v in zip(m.encoder.numeric, x)]
        return x + [1.0] + [float(city == v) for v in m.encoder.categories["city"][1:]] + [0.0]

    st = sector["Mumbai", "S1"]
    smoothed = (st.sum_price_per_sqft + 20 * prior["Mumbai"]) / (st.group_rows + 20)
    for row, x in ((1, by_hand("Mumbai", 800.0, smoothed, local["Mumbai", "S1"])), (3, by_hand("Atlantis", 800.0, None, 0))):
        want = float(np.dot(m.model.coefficients.toArray(), x)) + m.model.intercept
        assert got[row].prediction == pytest.approx(want, rel=1e-12)
        assert got[row].predicted_price == pytest.approx(np.expm1(want)) and got[row].range_high == pytest.approx(np.expm1(want) * 1.15)
        assert sum(c.impact for c in got[row].contributions) + got[row].base == pytest.approx(want, rel=1e-12)
    why = {r.request_id: r.problems for r in rejected.collect()}
    assert set(why) == {4, 6, 7} and "transact_type is not an accepted label" in why[7]


def test_request_without_a_model_is_rejected(spark, folder):
    scored, rejected = serving.score_requests(request_rows(spark, ASKED[:2]), folder, {"sale": "v2"})
    assert [r.request_id for r in scored.collect()] == [1]
    assert [(r.request_id, r.problems) for r in rejected.collect()] == [(2, ["no model for Rent"])]


def test_versions_are_whole_and_never_rewritten(spark, trained, folder, tmp_path):
    t = trained[1]["sale"]
    with pytest.raises(FileExistsError):
        artifacts.save_model(t.artifact("sale", "v2"), spark, folder)
    # what a lost job leaves behind has no manifest: it is not loaded, and written anew by the next try
    t.artifact("sale", "v10").encoder.save(spark, f"{folder}/sale/v10/encoder")
    assert artifacts.latest(spark, folder) == {"sale": "v2", "rent": "v2"}
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, folder, "sale", "v10")
    artifacts.save_model(t.artifact("sale", "v10"), spark, folder)
    assert artifacts.latest(spark, folder) == {"sale": "v10", "rent": "v2"}
    for missing in (f"{tmp_path}/none", folder):
        with pytest.raises(FileNotFoundError):
            artifacts.load_model(spark, missing, "lease")
    with pytest.raises(FileNotFoundError):
        serving.ModelStore(spark, f"{tmp_path}/none").current()


def log_lines(df):
    cols = ["city", "locality", "input_features_json", "predicted_price", "predicted_range_low", "predicted_range_high", "model_version"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_equals_batch_reloads_and_replays(spark, trained, folder, tmp_path):
    root = str(tmp_path / "stream")
    request_rows(spark, ASKED).coalesce(1).write.parquet(f"{root}/in")
    schema = request_rows(spark, ASKED).schema

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        score_stream_saved(stream, folder, f"{root}/log", f"{root}/rejects", f"{root}/{checkpoint}").awaitTermination()
        return spark.read.parquet(f"{root}/log"), spark.read.parquet(f"{root}/rejects")

    log, rejects = run("cp")
    held = serving.ModelStore(spark, folder).current()
    scored, rejected = serving.score_requests(request_rows(spark, ASKED), folder)
    first = log_lines(log)
    assert first == log_lines(serving.log_of(scored, held)) and len(first) == 4
    assert sorted(r.request_id for r in rejects.collect()) == sorted(r.request_id for r in rejected.collect())
    # the same batch again, as after a lost checkpoint: it rewrites its own folders
    again, _ = run("cp-lost")
    assert log_lines(again) == first
    # a newer version is taken by the next batch of the same stream, and only by it
    artifacts.save_model(trained[1]["sale"].artifact("sale", "v3", "ridge"), spark, folder)
    request_rows(spark, [(11, "Mumbai", "S1", "Sale", 800.0)]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    third, _ = run("cp-lost")
    assert {r.batch_id: r.n for r in third.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 4, 1: 1}
    assert {r.model_version for r in third.filter("batch_id = 1").collect()} == {"price_model_v3"} and {r.model_version for r in third.filter("batch_id = 0").collect()} == {"price_model_v2"}


def test_gate_of_saved_models(spark, trained, folder):
    rows, by_segment = trained
    g, slices = training.gate_saved(spark, rows, folder)
    got = {r.segment: r for r in g.collect()}
    for s, t in by_segment.items():
        want = t.metrics.filter("model = 'linear' AND split = 'test'").first()
        assert got[s].r2 == pytest.approx(want.r2) and got[s].mae == pytest.approx(want.mae) and got[s].summary.startswith("[PASS] " if got[s].ok_overall else "[FAIL] ")
    kept = {(r.segment, r.split, r.city): r.n for r in slices.collect()}
    assert all(kept[s, p, None] == kept[s, p, "Mumbai"] + kept[s, p, "Kolkata"] for s in by_segment for p in ("train", "val", "test"))
    with pytest.raises(FileNotFoundError):
        training.gate_saved(spark, rows, folder, {"sale": "v99"})


def test_folds_equal_refits(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(900, 3)) * [1, 50, 0.01] + [0, 1000, 28]
    y = 9 + x @ [0.3, -0.002, 4] + draw.normal(0, 0.1, 900)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double").repartition(7)
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(linear.with_folds(df, F.col("id"))).persist()
    got = linear.out_of_fold(vec)
    by_fold = {r.fold: r for r in linear.fold_metrics(got).collect()}
    refits = {r.fold: r for r in linear.cross_validate(vec, {"linear": LinearRegression(solver="normal")}).collect()}
    assert set(by_fold) == set(refits) == set(range(5))
    for k, r in refits.items():
        assert (by_fold[k].n, by_fold[k].r2, by_fold[k].mae) == (r.n, pytest.approx(r.r2, rel=1e-7), pytest.approx(r.mae, rel=1e-7))
    s = linear.fold_summary(linear.fold_metrics(got)).first()
    assert (s.folds, s.n) == (5, 900) and s.r2_mean == pytest.approx(np.mean([r.r2 for r in refits.values()]), rel=1e-7)
    trees = linear.cross_validate(vec, {"forest": models.make_estimator("random_forest", trees=3, rounds=1)})
    assert trees.count() == 5 and trees.agg(F.sum("n")).first()[0] == 900


def test_folds_with_nulls_constants_and_too_few_rows(spark):
    rows = [(i, [float(i % 7), 1.0], float(i % 7) * 2 + 1 if i % 5 else None, i % 3 if i % 11 else None) for i in range(200)] + [(500, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, fold int")
    got = {r.id: r for r in linear.out_of_fold(df).collect()}
    assert got[500].prediction is None and got[11].prediction is None
    assert all(r.prediction == pytest.approx(r.id % 7 * 2 + 1) for r in got.values() if r.fold is not None and r.features is not None)
    with pytest.raises(ValueError):
        linear.out_of_fold(df.filter("fold = 1"))
    with pytest.raises(ValueError):
        linear.out_of_fold(df.limit(0))
    with pytest.raises(Exception, match="different numbers of inputs"):
        linear.out_of_fold(df.withColumn("features", F.when(F.col("id") == 3, F.array(F.lit(1.0))).otherwise(F.col("features")))).collect()


def test_verdict_edges(spark):
    df = spark.createDataFrame([(90.0, 100.0), (110.0, 100.0), (91.0, 100.0), (100.0, 0.0), (None, 1.0)], "a double, p double")
    assert [r[0] for r in df.select(market.residual_class(F.col("a"), F.col("p"))).collect()] == ["Good Deal", "Overpriced", "Fair Price", None, None]


def test_labels_of_an_encoder(spark):
    got = {r.feature: r.label for r in explain.encoder_labels(spark, ("bedRoom", "age_rank"), ("balcony",), {"city": ["A", "Mumbai"], "property_type": ["a", "flat"]}, ("far_off",)).collect()}
    assert got["num__bedRoom"] == "Bedrooms" and got["num__age_rank"] == "Age Rank" and got["ord__balcony"] == "Balcony" and got["extra__far_off"] == "Far Off"
    assert got["cat__city_Mumbai"] == "City: Mumbai" and got["cat__property_type_flat"] == "Property: type_flat" and "cat__city_A" not in got


def test_summary_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    one, two = (sorted(r.id for r in explain.summary_sample(df.repartition(n), F.col("id"), 50).collect()) for n in (1, 9))
    assert one == two and len(one) == 50
    with pytest.raises(ValueError):
        explain.fitted_contributions(F.col("x"), ["a"], [1.0, 2.0], [0.0])


def test_append_once(spark, tmp_path):
    schema = "model_name string, version string, git_commit string, rmse double"
    path = str(tmp_path / "registry")
    a = spark.createDataFrame([("m", "1", "c1", 2.0), ("m", "1", "c1", 1.0), ("m", "2", None, 3.0)], schema)
    with pytest.raises(FileNotFoundError):
        registry.read_registry(spark, path)
    assert registry.append_once(a, path, "r1") == 2
    assert registry.append_once(a, path, "r1") == 2  # a retry
    b = spark.createDataFrame([("m", "1", "c1", 9.0), ("m", "2", None, 9.0), ("m", "2", "c2", 4.0)], schema)
    assert registry.append_once(b, path, "r2") == 1
    # a third run that had not seen the others when it wrote
    b.write.parquet(f"{path}/run=r3")
    got = sorted(((r.model_name, r.version, r.git_commit, r.rmse, r.run) for r in registry.read_registry(spark, path).collect()), key=repr)
    assert got == sorted([("m", "1", "c1", 1.0, "r1"), ("m", "2", None, 3.0, "r1"), ("m", "2", "c2", 4.0, "r2")], key=repr)


def test_metrics_of_folds_are_money_scale(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 2.0), (1, None, 1.0)], "fold int, label double, prediction double")
    m = linear.fold_metrics(df).collect()
    assert len(m) == 1 and m[0].n == 2 and m[0].mae == 0 and metrics.TOLERANCE == 0.15
