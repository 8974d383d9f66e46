import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brickfold.operators import dedup, impute, lookups, outliers, profile

LISTING = "listing_id string, register_date string, a string, b double, row_order long"


def test_dedup_coalesces_across_copies(spark):
    df = spark.createDataFrame([
        ("x ", None, "a1", None, 1), (" x", "2023", None, 2.0, 2), ("x", "2022", "a3", None, 3),
        ("", "2023", "a", 1.0, 4), (None, "2023", "a", 1.0, 5), ("y", None, None, None, 6), ("  ", "1", "1", 1.0, 7),
    ], LISTING)
    got = {r["listing_id"]: (r["register_date"], r["a"], r["b"]) for r in dedup.deduplicate(df).collect()}
    # ranks: x@2023 and x@2022 have as many fields, the later text date leads; its NULL a is filled from x@2022
    assert got == {"x": ("2023", "a3", 2.0), "y": (None, None, None)}
    top = {r["listing_id"]: (r["register_date"], r["a"], r["b"]) for r in dedup.deduplicate(df, mode="row").collect()}
    assert top == {"x": ("2023", None, 2.0), "y": (None, None, None)}
    assert dedup.dedup_counts(df).first().asDict() == {"rows_in": 7, "dropped_no_key": 3, "dropped_duplicate": 2, "rows_out": 2}


def test_dedup_matches_pandas_first(spark):
    r = random.Random(3)
    rows = [(r.choice(["k1", "k2", "k3"]), r.choice([None, "2020", "2021"]), r.choice([None, "p", "q"]), r.choice([None, 1.0, 2.0]), i) for i in range(60)]
    got = {x["listing_id"]: (x["register_date"], x["a"], x["b"]) for x in dedup.deduplicate(spark.createDataFrame(rows, LISTING)).collect()}
    p = pd.DataFrame(rows, columns=["k", "d", "a", "b", "o"])
    p["n"] = p[["k", "d", "a", "b"]].notna().sum(axis=1)
    p = p.sort_values(["n", "d", "o"], ascending=[False, False, True], na_position="last", kind="mergesort")
    want = p.groupby("k")[["d", "a", "b"]].first()
    assert {k: tuple(None if pd.isna(x) else x for x in want.loc[k]) for k in want.index} == got


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("x", "1", "a", None, 1), ("x", "2", None, 2.0, 2)], LISTING)
    once = dedup.deduplicate(df).withColumn("row_order", F.lit(0).cast("long"))
    assert sorted(map(tuple, dedup.deduplicate(once).collect())) == sorted(map(tuple, once.drop("row_order").collect()))


def fenced(spark):
    rows = [(c, float(100 + i), "flat", 2, 2) for c in "AB" for i in range(99)] + [("A", 1e6, "flat", 2, 2), ("B", -1e6, "Villa ", 20, 16), ("B", None, "flat", 16, None), (None, 5e9, "flat", 1, 1)]
    return spark.createDataFrame(rows, "city string, price double, property_type string, bedRoom int, bathroom int")


def test_outliers_keep_rows_and_name_reasons(spark):
    df = fenced(spark)
    out = outliers.flag_outliers(df, "city", ["price"])
    assert out.count() == df.count()
    by = {(r["city"], r["price"]): r["outlier_reasons"] for r in out.collect()}
    assert by[("A", 1e6)] == ["percentile_price", "iqr_price"] and by[("B", -1e6)] == ["percentile_price", "iqr_price"]
    assert by[("B", None)] == ["domain_bedRoom"] and by[(None, 5e9)] == []
    again = outliers.flag_outliers(out, "city", ["price"])
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_outlier_bounds_match_pandas(spark):
    r = random.Random(5)
    rows = [(r.choice("AB"), r.lognormvariate(3, 1)) for _ in range(500)]
    p = pd.DataFrame(rows, columns=["g", "v"])
    f = {x["g"]: x for x in outliers.fences(spark.createDataFrame(rows, "g string, v double"), "g", ["v"]).collect()}
    for g, s in p.groupby("g")["v"]:
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        assert f[g]["v_tail_lo"] == pytest.approx(s.quantile(0.01)) and f[g]["v_iqr_hi"] == pytest.approx(q3 + 1.5 * (q3 - q1))


GAPS = "city string, locality string, property_type string, n double, t string, k int"


def test_impute_group_then_global_then_unknown(spark):
    rows = [("a", "l", "p", 100.0, "x", 1), ("a", "l", "p", 500.0, "x", 2), ("a", "l", "p", None, None, 3), (None, "l", "p", 7.0, "y", 4), (None, "l", "p", None, None, 5), ("z", "q", "p", None, None, 6)]
    df = spark.createDataFrame(rows, GAPS)
    got = {r["k"]: (r["n"], r["t"]) for r in impute.fill_by_group(df, ["n", "t"]).collect()}
    assert got[3] == (300.0, "x") and got[5] == (7.0, "y") and got[6] == (100.0, "x")
    empty = df.withColumn("t", F.lit(None).cast("string"))
    assert {r["t"] for r in impute.fill_by_group(empty, ["t"]).collect()} == {"Unknown"}


def test_low_tier_fills_stray_text_and_breaks_mode_ties_low(spark):
    df = spark.createDataFrame([("3", "b", 1), ("5", "a", 2), ("junk", "b", 3), (None, "a", 4), ("4", None, 5)], "num string, txt string, k int")
    got = {r["k"]: (r["num"], r["txt"]) for r in impute.fill_global(df, ["num"], ["txt"]).collect()}
    assert got == {1: (3.0, "b"), 2: (5.0, "a"), 3: (4.0, "b"), 4: (4.0, "a"), 5: (4.0, "a")}


def test_imputation_tiers_and_idempotence(spark):
    n = 100
    rows = [("c", "l", "p" if i else None, None if i < 20 else float(i), None if i < 50 else "h", None if i < 50 else 1.0, None if i < 75 else "d", i) for i in range(n)]
    df = spark.createDataFrame(rows, "city string, locality string, property_type string, price_inr double, color string, score double, gone string, k int")
    out = impute.impute(df)
    assert "gone" not in out.columns
    flags = sorted(c for c in out.columns if c.startswith("was_missing_"))
    assert flags == ["was_missing_color", "was_missing_price_inr", "was_missing_score"]
    r = {x["k"]: x for x in out.collect()}
    assert r[0]["property_type"] == "p" and r[0]["color"] == "Unknown" and r[0]["score"] is None
    assert r[5]["price_inr"] == pytest.approx(59.5) and r[5]["was_missing_price_inr"] and not r[30]["was_missing_price_inr"]
    base = [c for c in out.columns if not c.startswith("was_missing_")]
    again = impute.impute(out)
    assert sorted(map(tuple, again.select(*base).collect())) == sorted(map(tuple, out.select(*base).collect()))


def test_protected_columns_survive(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "k string, sector string")
    assert impute.drop_sparse(df, ["sector"])[1] == [] and impute.drop_sparse(df)[1] == ["sector"]


def test_empty_frame_has_ratio_zero(spark):
    r = profile.missing_ratios(spark.createDataFrame([], "a string, b int")).collect()
    assert {(x["column"], x["ratio"], x["tier"]) for x in r} == {("a", 0.0, "low"), ("b", 0.0, "low")}


@pytest.mark.parametrize("name,want", [("PHOTO_URL", True), ("AGENT_NOTES", True), ("CONTACT", True), ("HOTEL", False), ("TELUGU", False), ("Email_Id", True), ("PRICE", False), ("WHATSAPP_NO", True)])
def test_personal_columns(name, want):
    assert profile.is_personal(name) is want


LOOKUP = [("001", "One"), ("002", "Two"), ("010", "Ten"), ("002", "Second"), ("B", "Basement")]


def book(spark):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(LOOKUP)], "id string, label string, o long")


def test_decode(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("B",), ("77",), (None,)], "c string")
    got = [r["c"] for r in lookups.decode(df, "c", book(spark), order="o").collect()]
    assert got == ["One", "Second", "Basement", "unknown", None]
    verbatim = [r["c"] for r in lookups.decode(df, "c", book(spark), order="o", strip_zeros=False).collect()]
    assert verbatim == ["unknown", "unknown", "Basement", "unknown", None]


def test_decode_floor(spark):
    df = spark.createDataFrame([("1",), ("9",), ("11",), ("B",), ("X",), (None,)], "c string")
    assert [r["c"] for r in lookups.decode_floor(df, "c", book(spark), order="o").collect()] == ["One", "unknown", "95+", "Basement", "unknown", None]


@pytest.mark.parametrize("limit", [1 << 40, -1])
def test_decode_list_on_both_paths(spark, limit, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_LIMIT_BYTES", limit)
    df = spark.createDataFrame([("2,99, 1,2", 1), ("N", 2), (None, 3), ("", 4), ("1,,2", 5), ("10", 6)], "c string, k int")
    got = {r["k"]: r["c"] for r in lookups.decode_list(df, "c", book(spark), row_key="k", order="o").collect()}
    assert got == {1: ["Second", "One", "Second"], 2: [], 3: [], 4: [], 5: [], 6: ["Ten"]}


def test_decode_many_equals_decode(spark, monkeypatch):
    long = book(spark).withColumn("facet", F.lit("F"))
    prepared = lookups.prepare_lookups(long, "o")
    df = spark.createDataFrame([("1", "2", 1), (None, "9", 2)], "a string, b string, k int")
    small = lookups.decode_many(df, {"a": ("F", "a"), "b": ("F", "bb")}, prepared)
    monkeypatch.setattr(lookups, "BROADCAST_LIMIT_BYTES", -1)
    big = lookups.decode_many(df, {"a": ("F", "a"), "b": ("F", "bb")}, prepared)
    want = {(1, "One", "Second"), (2, None, "unknown")}
    assert {(r["k"], r["a"], r["bb"]) for r in small.collect()} == want == {(r["k"], r["a"], r["bb"]) for r in big.collect()}


def test_profile_samples_and_counts(spark):
    df = spark.createDataFrame([(str(i % 7) if i % 7 else None, i) for i in range(70)], "c string, PHOTO_URL int")
    r = {x["column"]: x for x in profile.profile_columns(df).collect()}
    assert (r["c"]["null_count"], r["c"]["distinct_count"], r["c"]["sample_values"], r["c"]["null_pct"]) == (10, 6, "1|2|3|4|5", 14.2857)
    assert r["PHOTO_URL"]["pii_risk"] and r["PHOTO_URL"]["dtype"] == "int"


def test_only_rows_whose_key_occurs_again_are_merged(spark):
    """Each merged row carries a rank for every column through the shuffle; single rows need none of it."""
    from brickfold.session import written

    rows = written(spark.range(1000).selectExpr("CASE WHEN id < 10 THEN ' twice ' WHEN id = 10 THEN ' ' ELSE concat(' k', id) END AS listing_id", "cast(NULL AS string) AS register_date",
                                                "CASE WHEN id <> 3 THEN id END AS a", "array(cast(id AS string), NULL) AS b", "id AS row_order"), "listings")
    merged = []

    def merge(part):
        merged.append(part.count())
        return part.groupBy("key").agg(F.max("a").alias("a"))

    keyed = rows.select(F.trim("listing_id").alias("key"), "a", F.lit(1).alias("__rank")).filter("key <> ''")
    assert dedup._merge_repeated(keyed, "key", ["a"], merge).count() == 990 and merged == [10]
    for mode in ("coalesce", "row"):
        got = {r["listing_id"]: (r["a"], r["b"]) for r in dedup.deduplicate(rows, mode=mode).collect()}
        # the same through the one aggregate that a table costly to read twice takes
        whole = {r["listing_id"]: (r["a"], r["b"]) for r in dedup.deduplicate(rows.distinct(), mode=mode).collect()}
        assert got == whole and len(got) == 990 and got["twice"] == (0, ["0", None]) and got["k11"] == (11, ["11", None])
