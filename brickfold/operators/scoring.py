"""Validation and scoring of request tables, and the prediction log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import (
    AGE_SCALE, BALCONY_SCALE, BAND_SHARE, FLOOR_SCALE, FURNISHING_SCALE, first_problems, luxury_tier, price_band, price_from_log,
)

# Accepted labels and limits of a request, and the log columns.
ACCEPTED = {
    "property_type": ("flat", "house"),
    "transact_type": ("Sale", "Rent"),
    "balcony": tuple(BALCONY_SCALE),
    "agePossession": tuple(AGE_SCALE),
    "furnishing_type": tuple(FURNISHING_SCALE),
    "floor_category": tuple(FLOOR_SCALE),
    "facing": ("North", "South", "East", "West", "North-East", "North-West", "South-East", "South-West"),
}
ROOM_RANGE, AREA_MAX, EXTRA_BEDROOMS = (1, 15), 20000, 3
REQUEST_FIELDS = ("city", "sector", "property_type", "transact_type", "bedRoom", "bathroom", "balcony", "agePossession",
                  "built_up_area", "servant_room", "store_room", "furnishing_type", "floor_category", "facing", "amenities")
LOG_COLUMNS = ("timestamp", "city", "locality", "input_features_json", "predicted_price", "predicted_range_low",
               "predicted_range_high", "model_version", "is_outlier_input", "latency_ms")


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def validate_requests(df: DataFrame, id_cols: Sequence[str] = ("request_id",), accepted=ACCEPTED) -> DataFrame:
    """Trims text, drops a client's luxury_category and adds ``problems`` (empty = valid)."""
    strange = [c for c in df.columns if c not in (*REQUEST_FIELDS, *id_cols, "luxury_category")]
    if strange:
        raise ValueError(f"unknown request fields: {strange}")
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name in REQUEST_FIELDS]
    out = df.drop("luxury_category").withColumns({c: F.trim(c) for c in text})
    if "amenities" not in out.columns:
        out = out.withColumn("amenities", F.array().cast("array<string>"))
    out = out.withColumn("amenities", F.coalesce("amenities", F.array().cast("array<string>")))
    checks = [(~_known(F.length(c) > 0), f"{c} is empty") for c in ("city", "sector")]
    checks += [(~_known(F.col(c).isin(*labels)), f"{c} is not an accepted label") for c, labels in accepted.items()]
    checks += [(~_known(F.col(c).between(*ROOM_RANGE)), f"{c} is out of range") for c in ("bedRoom", "bathroom")]
    checks += [(~_known((F.col("built_up_area") > 0) & (F.col("built_up_area") <= AREA_MAX)), "built_up_area is out of range")]
    checks += [(F.col(c).isNull(), f"{c} is missing") for c in ("servant_room", "store_room")]
    checks += [(_known(F.col("bedRoom") > F.col("bathroom") + EXTRA_BEDROOMS), "bathroom too low for bedroom count")]
    return out.withColumn("problems", first_problems(checks))


def valid_requests(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("problems") == 0).drop("problems").withColumn("luxury_category", luxury_tier(F.col("amenities")))


def rejected_requests(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("problems") > 0)


def price_columns(df: DataFrame, prediction: str = "prediction", share: float = BAND_SHARE) -> DataFrame:
    """Log prediction to price and its band; the input-outlier flag is always false."""
    price = price_from_log(F.col(prediction))
    low, high = price_band(F.col("predicted_price"), share)
    return df.withColumn("predicted_price", price).withColumns({"range_low": low, "range_high": high, "is_outlier_input": F.lit(False)})


def log_rows(scored: DataFrame, version: str, at: Column | None = None, latency: Column | None = None) -> DataFrame:
    """Scored requests in prediction-log shape."""
    payload = F.to_json(F.struct(*[c for c in REQUEST_FIELDS if c in scored.columns]))
    return scored.select(
        (at if at is not None else F.current_timestamp()).alias("timestamp"),
        "city", F.col("sector").alias("locality"), payload.alias("input_features_json"),
        "predicted_price", F.col("range_low").alias("predicted_range_low"), F.col("range_high").alias("predicted_range_high"),
        F.lit(f"price_model_{version}").alias("model_version"), "is_outlier_input",
        (latency if latency is not None else F.lit(0)).cast("int").alias("latency_ms"),
    )
