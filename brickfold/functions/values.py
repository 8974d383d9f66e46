"""Row arithmetic: ratios, ordinals, distances, money formats, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal scales, Earth radius, tiers, bands, thresholds.
AGE_SCALE = {"New Property": 0, "Under Construction": 1, "Relatively New": 2, "Moderately Old": 3, "Old Property": 4}
FLOOR_SCALE = {"Low Floor": 0, "Mid Floor": 1, "High Floor": 2}
LUXURY_SCALE = {"Low": 0, "Medium": 1, "High": 2}
FURNISHING_SCALE = {"Unfurnished": 0, "Semifurnished": 1, "Furnished": 2}
BALCONY_SCALE = {"0": 0, "1": 1, "2": 2, "3": 3, "3+": 4}
EARTH_RADIUS_KM = 6371.0088
LUXURY_HIGH_FROM, LUXURY_MEDIUM_FROM = 5, 2
BAND_SHARE = 0.15
MONEY_STEPS = ((1e7, "Cr"), (1e5, "Lakh"), (1e3, "Thousand"))
GATE_LIMITS = {"r2_min": 0.80, "r2_stretch": 0.85, "within_15_min": 0.70, "p95_latency_ms_max": 300.0, "min_rows": 500}
IMPROVEMENT_TARGET_PCT = 32.5


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or either is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ordinal(c: Column, scale: Mapping[str, int], unknown: int | None = None) -> Column:
    out = F.lit(unknown).cast("int")
    for label, rank in scale.items():
        out = F.when(c == label, F.lit(rank)).otherwise(out)
    return out


def list_length(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def luxury_tier(amenities: Column) -> Column:
    n = list_length(amenities)
    return F.when(n >= LUXURY_HIGH_FROM, "High").when(n >= LUXURY_MEDIUM_FROM, "Medium").otherwise("Low")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    # greatest/least skip NULL, so guard it explicitly
    return F.when(a.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def log_target(price: Column) -> Column:
    return F.log1p(price)


def price_from_log(prediction: Column) -> Column:
    return F.when(prediction.isNotNull(), F.greatest(F.lit(0.0), F.expm1(prediction)))


def price_band(price: Column, share: float = BAND_SHARE) -> tuple[Column, Column]:
    low = F.when(price.isNotNull(), F.greatest(F.lit(0.0), price * F.lit(1 - share)))
    return low, price * F.lit(1 + share)


def fixed_text(value: Column, places: int) -> Column:
    """The number with that many decimals, rounded as it stands in binary (exact ties to even); ``format_string`` rounds its printed digits."""
    plain = F.format_string(f"%.{places}f", value)
    size, scale = F.abs(value), 10 ** places
    whole = F.floor(size)
    part = size - whole
    # where the printed digits tie, both halves of the fraction times 10 * scale are exact, so their sum has the right sign
    split = part * F.lit(134217729.0)
    high = split - (split - part)
    tenths = F.round(part * F.lit(10.0 * scale))
    beyond = (high * F.lit(10.0 * scale) - tenths) + (part - high) * F.lit(10.0 * scale)
    down = F.floor(tenths / 10)
    odd = (whole if places == 0 else down) % 2 == 1
    rounded = down + ((beyond > 0) | ((beyond == 0) & odd)).cast("long")
    units = whole + F.floor(rounded / scale)
    text = F.concat(F.when(value < 0, "-").otherwise(""), units.cast("string"))
    if places:
        text = F.concat(text, F.lit("."), F.lpad((rounded % scale).cast("string"), places, "0"))
    return F.when((tenths % 10 == 5) & (size < 2.0**53), text).otherwise(plain)


def sale_text(value: Column) -> Column:
    out = F.concat(F.lit("₹"), F.format_number(value, 0))
    for step, label in reversed(MONEY_STEPS):
        out = F.when(value >= step, F.concat(F.lit("₹"), fixed_text(value / F.lit(step), 2), F.lit(f" {label}"))).otherwise(out)
    return F.when(value <= 0, F.lit("₹0")).otherwise(out)


def rent_text(value: Column) -> Column:
    whole = F.bround(value, 0).cast("long")
    digits = whole.cast("string")
    grouped = F.regexp_replace(digits, r"(?<=\d)(?=(?:\d\d)*\d{3}$)", ",")
    return F.when(whole <= 0, F.lit("₹0 / month")).otherwise(F.concat(F.lit("₹"), grouped, F.lit(" / month")))


def money_text(value: Column, transact_type: Column) -> Column:
    return F.when(transact_type == "Rent", rent_text(value)).otherwise(sale_text(value))


def direction(impact: Column, neutral: bool = False) -> Column:
    """up for gains; zero is down in explanations, neutral on the page."""
    out = F.when(impact > 0, "up")
    return out.when(impact < 0, "down").otherwise("neutral") if neutral else out.otherwise("down")


def round_floats(cols: Mapping[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, c in cols.items()]


def improvement_pct(old: Column, new: Column, lower_is_better: Column) -> Column:
    """Gain of ``new`` over ``old`` in percent of |old|; positive is better, NULL when old is 0."""
    gain = F.when(lower_is_better, old - new).otherwise(new - old)
    return F.try_divide(gain, F.abs(old)) * F.lit(100.0)


def target_met(pct: Column, target: float = IMPROVEMENT_TARGET_PCT) -> Column:
    return pct >= F.lit(target)


def verdicts(r2: Column, within: Column, rows: Column, p95: Column | None = None) -> dict[str, Column]:
    """Gate verdict columns; the stretch goal is reported only, latency only when measured."""
    v = {
        "r2_min": r2 >= GATE_LIMITS["r2_min"],
        "within_15_min": within >= GATE_LIMITS["within_15_min"],
        "min_rows": rows >= GATE_LIMITS["min_rows"],
    }
    if p95 is not None:
        v["p95_latency"] = F.coalesce(p95 <= GATE_LIMITS["p95_latency_ms_max"], F.lit(True))
    overall = F.forall(F.array(*[F.coalesce(c, F.lit(False)) for c in v.values()]), lambda x: x)
    return {**v, "r2_stretch": r2 >= GATE_LIMITS["r2_stretch"], "overall": overall}


def summary_line(name: Column, passed: Column, r2: Column, mae: Column, within: Column, p95: Column | None = None) -> Column:
    latency = F.lit("n/a") if p95 is None else F.when(p95.isNotNull(), fixed_text(p95, 1)).otherwise(F.lit("n/a"))
    return F.concat(
        F.when(passed, "[PASS] ").otherwise("[FAIL] "), name,
        F.lit(" R²="), fixed_text(r2, 4), F.lit(" (≥0.80) MAE=₹"), fixed_text(mae, 0), F.lit(" within±15%="), fixed_text(within * 100, 1), F.lit("% (≥70%) latency_p95="),
        latency, F.lit("ms (<300ms)"),
    )


def first_problems(checks: Sequence[tuple[Column, str]]) -> Column:
    """Array of the messages whose condition is true."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(bad, F.array(F.lit(msg))).otherwise(none) for bad, msg in checks])
