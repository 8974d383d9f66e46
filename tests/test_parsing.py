import html

import pytest
from pyspark.sql import functions as F

from brickfold.functions import text as tx
from brickfold.functions import values as v
from brickfold.operators import parse_failures


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [
    ("3.5 Cr", 35_000_000.0), ("69.25 L", 6_925_000.0), ("69.25 lac", 6_925_000.0), ("2 LAKH.", 200_000.0), ("42000", 42000.0),
    ("  15000000.0 ", 15_000_000.0), ("19.1 L Onwards", None), ("call for price", None), ("--", None), ("", None), (None, None), ("5 acres", None), ("-5", None),
])
def test_price(spark, raw, want):
    assert one(spark, raw, tx.parse_price) == pytest.approx(want) if want is not None else one(spark, raw, tx.parse_price) is None


def test_price_falls_back_to_midpoint(spark):
    df = spark.createDataFrame([("19.1 L Onwards", "100", "300"), ("x", "100", "n/a"), ("7", "1", "2")], "p string, lo string, hi string")
    got = [r[0] for r in df.select(tx.parse_price(F.col("p"), F.col("lo"), F.col("hi"))).collect()]
    assert got == [200.0, None, 7.0]


@pytest.mark.parametrize("raw,hint,want", [
    ("1450 sq.ft.", "auto", 1450.0), ("3500-3700  sq.ft.", "auto", 3600.0), ("100 SQ.M.", "auto", 1076.39), ("1500", "auto", 1500.0),
    ("1500", "sqm", 16145.85), ("100 sq.m.", "sqft", 100.0), ("10 acres", "auto", None), ("N/A", "auto", None),
])
def test_area(spark, raw, hint, want):
    got = one(spark, raw, lambda c: tx.parse_area(c, hint))
    assert got is None if want is None else got == pytest.approx(want)


def test_area_refuses_unknown_hint(spark):
    with pytest.raises(ValueError):
        tx.parse_area(F.lit("1"), "acre")


@pytest.mark.parametrize("raw", [
    "<p>Spacious 3BHK with CLUBHOUSE</p>", "A&nbsp;B &lt;b&gt;x", "see www.a.in or mail me@b.co NOW", "  tabs\tand\nlines  ", "É &eacute; ß", "a b", None, "",
])
def test_description_matches_step_by_step(spark, raw):
    import re

    got = one(spark, raw, tx.clean_description)
    if raw is None:
        assert got is None
        return
    t = html.unescape(raw)
    for shape in (r"<[^>]+>", r"https?://\S+|www\.\S+", r"\S+@\S+"):
        t = re.sub(shape, " ", t)
    assert got == re.sub(r"\s+", " ", t.lower()).strip()


@pytest.mark.parametrize("raw,want", [
    ("{'LATITUDE': '28.4065', 'LONGITUDE': '76.9628', 'ZOOM_LEVEL': '14'}", (28.4065, 76.9628)),
    ("{'LATITUDE': '28.4', 'LONGITUDE': None}", (28.4, None)), ("{'LATITUDE': 'x', 'LONGITUDE': '7'}", (None, None)),
    ("{'LATITUDE': 28.5, 'OPEN': True}", (28.5, None)), ("not a dict", (None, None)), (None, (None, None)), ("{'LATITUDE': 'nan', 'LONGITUDE': '7'}", (None, None)),
])
def test_map_point(spark, raw, want):
    assert tuple(one(spark, raw, tx.map_point)) == want


def test_location(spark):
    raw = "{'CITY': '27', 'LOCALITY_NAME': 'Amtala ', 'BUILDING_NAME': '  ', 'BUILDING_ID': 'x', 'ADDRESS': None}"
    assert tuple(one(spark, raw, tx.location_parts)) == ("Amtala", None, None)
    raw = '{\'LOCALITY_NAME\': "King\'s Road", \'BUILDING_NAME\': \'T1\', \'BUILDING_ID\': \'12\'}'
    assert tuple(one(spark, raw, tx.location_parts)) == ("King's Road", "T1", 12)


@pytest.mark.parametrize("raw,bare,closed", [
    ("a &amp; b&amp", "a & b&", "a & b&amp"), ("x &ampy; &quot;z&quot; &copy", "x &y; \"z\" ©", "x &ampy; \"z\" &copy"), ("&#65;&#x42; &#67 &nope; &amp;lt;", "ab c &nope; &lt;", "ab &#67 &nope; &lt;"), (None, None, None),
])
def test_bare_entities(spark, raw, bare, closed):
    assert one(spark, raw, tx.clean_description) == bare
    assert one(spark, raw, lambda c: tx.clean_description(c, bare_entities=False)) == closed


@pytest.mark.parametrize("raw,strip,want", [("4.0", True, "4"), ("004", True, "4"), ("004", False, "004"), ("09+", True, "9+"), ("0", True, "0"), ("B", True, "B")])
def test_lookup_key(spark, raw, strip, want):
    assert one(spark, raw, lambda c: tx.lookup_key(c, strip)) == want


@pytest.mark.parametrize("label", ["Swimming Pool", "  Gas-Line / 24x7 ", "!!!", "Club house"])
def test_slug_twins_agree(spark, label):
    assert one(spark, label, tx.slug) == tx.slug_text(label)


@pytest.mark.parametrize("value,kind,want", [
    (35_000_000.0, "Sale", "₹3.50 Cr"), (6_925_000.0, "Sale", "₹69.25 Lakh"), (42_500.0, "Sale", "₹42.50 Thousand"), (999.4, "Sale", "₹999"), (0.0, "Sale", "₹0"),
    (1234567.0, "Rent", "₹12,34,567 / month"), (999.0, "Rent", "₹999 / month"), (25000.5, "Rent", "₹25,000 / month"), (100000.0, "Rent", "₹1,00,000 / month"), (-1.0, "Rent", "₹0 / month"),
])
def test_money(spark, value, kind, want):
    assert one(spark, value, lambda c: v.money_text(c, F.lit(kind)), "double") == want


def test_decimals_round_the_binary_value(spark):
    found = [(k * 1000 + 5) / 10 ** places * sign for places in (1, 2, 3, 5) for k in (0, 1, 7, 77, 8123, 999_999) for sign in (1, -1)]
    found += [0.125, 0.375, 2.5, 3.5, -0.5, 77.195, 48.175, 9.715, 0.995, 9.995, 99.95, 0.0, 1e15 + 0.5, 1e18, 12.3]
    df = spark.createDataFrame([(x,) for x in found], "x double")
    for places in (0, 1, 2, 4):
        assert [r[0] for r in df.select(v.fixed_text(F.col("x"), places)).collect()] == [f"{x:.{places}f}" for x in found]
    assert one(spark, 77195.0, lambda c: v.money_text(c, F.lit("Sale")), "double") == f"₹{77.195:.2f} Thousand" == "₹77.19 Thousand"


def test_haversine(spark):
    row = spark.range(1).select(
        v.haversine_km(F.lit(28.4595), F.lit(77.0266), F.lit(19.0760), F.lit(72.8777)).alias("a"),
        v.haversine_km(F.lit(22.5726), F.lit(88.3639), F.lit(19.0760), F.lit(72.8777)).alias("b"),
        v.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("zero"),
        v.haversine_km(F.lit(None).cast("double"), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("none"),
    ).first()
    assert 1000 < row["a"] < 1500 and 1500 < row["b"] < 1900 and row["zero"] == 0 and row["none"] is None


def test_missing_tokens(spark):
    df = spark.createDataFrame([(x,) for x in ("", "NA", "nan", "None", "null", "N/A", "none?", "0")], "x string")
    assert [r[0] for r in df.select(tx.missing_to_null(F.col("x"))).collect()] == [None] * 6 + ["none?", "0"]


def test_parse_failures_stand_beside_typed_rows(spark):
    rows = [(1, "2 Cr", "100 sqft", "a"), (2, "Call us", "100 sqft", "b"), (3, "Call us", "2 acres", "c"), (4, None, " \t", "d"), (5, " N/A ", "", "e"), (6, "x" * 100_000, None, "f"), (6, "x" * 100_000, None, "f")]
    df = spark.createDataFrame(rows, "id int, PRICE string, AREA string, column string")
    got = parse_failures.typed(df, parse_failures.LISTING_PARSERS)
    assert got.columns == [*df.columns, "parse_failures"] and dict(got.dtypes)["PRICE"] == "double"
    assert {(r.id, r.PRICE, r.AREA, r["column"]) for r in got.collect()} == {(1, 2e7, 100.0, "a"), (2, None, 100.0, "b"), (3, None, None, "c"), (4, None, None, "d"), (5, None, None, "e"), (6, None, None, "f")}
    counts = {tuple(r) for r in parse_failures.failure_counts(got, F.col("id") % 2 == 0).collect()}
    assert counts == {("true", "PRICE", "Call us", 1), ("false", "PRICE", "Call us", 1), ("false", "AREA", "2 acres", 1), ("true", "PRICE", "x" * 100_000, 2)}
    with pytest.raises(ValueError):
        parse_failures.typed(got, parse_failures.LISTING_PARSERS)


def test_parse_failures_of_sources_of_different_shape(spark):
    one = spark.createDataFrame([("Call", "9 acres"), ("1 Cr", "9 acres")], "PRICE string, AREA string")
    two = spark.createDataFrame([("later", 1)], "PRICE string, source int")
    none = spark.createDataFrame([], "AREA string")
    counts = {tuple(r) for r in parse_failures.listing_failures({"one": one, "two": two, "none": none}).collect()}
    assert counts == {("one", "PRICE", "Call", 1), ("one", "AREA", "9 acres", 2), ("two", "PRICE", "later", 1)}
    assert parse_failures.listing_failures({"none": none}).count() == 0


def test_lookup_codes_meet_a_pattern_only_when_it_can_change_them(spark):
    codes = ["4", "4.0", "4.00", "-4.0", "004", "0", "00", "0.0", "00.0", "-0.0", "1.50", "4.0\n", " 07 ", "a0.0", "0a", "00a", "", ".", "4.", "10", "1000.0", None]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    plain = F.regexp_replace(F.trim("c"), r"^(-?\d+)\.0+$", "$1")
    for strip, want in ((True, F.regexp_replace(plain, r"^0+(?=\d)", "")), (False, plain)):
        assert all(r[0] == r[1] for r in df.select(tx.lookup_key(F.col("c"), strip), want).collect())
    assert "CASE WHEN contains" in str(tx.lookup_key(F.col("c")))
