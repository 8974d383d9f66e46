"""Parsing of free-text listing fields into typed columns."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Units, conversion and accepted shapes.
SQFT_PER_SQM = 10.7639
PRICE_UNITS = {"cr": 1e7, "l": 1e5, "lac": 1e5, "lakh": 1e5}
AREA_UNITS = {"sqft": 1.0, "sqm": SQFT_PER_SQM}
PRICE_SHAPE = r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z.]+)?\s*$"
AREA_SHAPE = r"^\s*(\d+(?:\.\d+)?)(?:\s*-\s*(\d+(?:\.\d+)?))?\s*([A-Za-z.]+)?\s*$"
# Unicode white space, then tags, links and mail addresses in text whose only space is ' '. A mail
# address starts where a word starts, which keeps the search linear in the text.
SPACES = r"(?U)[\s\x1c-\x1f]+"
TAG = r"<[^>]+>"
LINK = r"https?://[^ ]+|www\.[^ ]+"
MAIL = r"(?<![^ ])[^ ]+@[^ ]+"
CLOSED_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);")
TRANSACTION_CODES = {1.0: "Sale", 2.0: "Rent"}
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                  "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def missing_to_null(c: Column) -> Column:
    """The reader's list of missing-value tokens becomes NULL."""
    return F.when(~c.isin(*MISSING_TOKENS), c)


def to_number(c: Column) -> Column:
    """Trimmed text to double; anything else, NaN included, becomes NULL."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(n), n)


def normal_unit(c: Column) -> Column:
    return F.nullif(F.translate(F.lower(F.trim(c)), ". ", ""), F.lit(""))


def _unit_factor(unit: Column, table: dict[str, float]) -> Column:
    """Factor of a unit word, 1 without one, NULL when unknown; the word is computed once per row."""
    book = F.create_map(F.lit(""), F.lit(1.0), *[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(book, F.coalesce(unit, F.lit("")))


def parse_price(c: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Price text to rupees; text that does not parse takes the midpoint of ``low`` and ``high``."""
    number = F.nullif(F.regexp_extract(c, PRICE_SHAPE, 1), F.lit("")).try_cast("double")
    unit = normal_unit(F.regexp_extract(c, PRICE_SHAPE, 2))
    price = number * _unit_factor(unit, PRICE_UNITS)
    if low is None or high is None:
        return price
    return F.coalesce(price, (to_number(low) + to_number(high)) / 2.0)


def parse_area(c: Column, unit_hint: str = "auto") -> Column:
    """Area text (single value or range) to square feet; ``unit_hint`` forces the unit."""
    low = F.nullif(F.regexp_extract(c, AREA_SHAPE, 1), F.lit("")).try_cast("double")
    high = F.nullif(F.regexp_extract(c, AREA_SHAPE, 2), F.lit("")).try_cast("double")
    middle = (low + F.coalesce(high, low)) / 2.0
    if unit_hint in AREA_UNITS:
        return middle * F.lit(AREA_UNITS[unit_hint])
    if unit_hint != "auto":
        raise ValueError(f"unknown unit hint {unit_hint!r}")
    return middle * _unit_factor(normal_unit(F.regexp_extract(c, AREA_SHAPE, 3)), AREA_UNITS)


def lookup_key(c: Column, strip_zeros: bool = True) -> Column:
    """Lookup code as text: ``4.0`` -> ``4`` and, unless verbatim, ``004`` -> ``4``. Only codes that a pattern can change are matched against it."""
    text = F.trim(c.cast("string"))
    key = F.when(text.contains("."), F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")).otherwise(text)
    return F.when(key.startswith("0"), F.regexp_replace(key, r"^0+(?=\d)", "")).otherwise(key) if strip_zeros else key


def transaction_label(c: Column) -> Column:
    code = to_number(c)
    out = F.lit(None).cast("string")
    for value, label in TRANSACTION_CODES.items():
        out = F.when(code == value, F.lit(label)).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def _decode_entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def _closed_entity(found: re.Match) -> str:
    return html.unescape(found[0]) if found[0][1] == "#" or found[0][1:] in html.entities.html5 else found[0]


@F.pandas_udf(T.StringType())
def _decode_closed_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda x: CLOSED_ENTITY.sub(_closed_entity, x), na_action="ignore")


def clean_description(c: Column, bare_entities: bool = True) -> Column:
    """Entities decoded; tags, links and mail addresses blanked; lower case; single spaces.

    ``bare_entities`` decodes known names without their semicolon too, as the surveyed cleaning does. Only text containing
    ``&`` visits Python; the rest stays in the JVM.
    """
    decode = _decode_entities if bare_entities else _decode_closed_entities
    text = F.coalesce(decode(F.when(c.contains("&"), c)), c)
    for shape in (SPACES, TAG, LINK, MAIL):
        text = F.regexp_replace(text, shape, " ")
    return F.trim(F.regexp_replace(F.lower(text), " +", " "))


_DICT_JSON = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def dict_text(c: Column, schema: str) -> Column:
    """A printed Python dict as a struct of strings (bare words read as NULL); NULL where it is malformed."""
    body = F.regexp_replace(c, r"(:\s*)(?:None|True|False)(\s*[,}])", "$1null$2")
    return F.from_json(body, schema, _DICT_JSON)


def map_point(c: Column) -> Column:
    """struct(latitude, longitude) from map text; one bad coordinate voids both."""
    d = dict_text(c, "LATITUDE string, LONGITUDE string")
    lat, lon = d["LATITUDE"], d["LONGITUDE"]
    bad = (lat.isNotNull() & to_number(lat).isNull()) | (lon.isNotNull() & to_number(lon).isNull())
    return F.struct(
        F.when(~bad, to_number(lat)).alias("latitude"),
        F.when(~bad, to_number(lon)).alias("longitude"),
    )


def location_parts(c: Column) -> Column:
    """struct(locality, building_name, building_id) from location text."""
    d = dict_text(c, "LOCALITY_NAME string, BUILDING_NAME string, BUILDING_ID string")
    return F.struct(
        F.trim(d["LOCALITY_NAME"]).alias("locality"),
        F.nullif(F.trim(d["BUILDING_NAME"]), F.lit("")).alias("building_name"),
        F.trim(d["BUILDING_ID"]).try_cast("long").alias("building_id"),
    )


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def slug_text(label: str) -> str:
    """Driver-side twin of :func:`slug`, for naming columns."""
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in label.lower()).split()
    return "_".join(words)
