"""Scoring request tables by saved models: state tables are joined, the encoder and the model run as they were fitted."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoders, explain, geo
from ..operators.features import add_row_features
from ..operators.scoring import log_rows, price_columns, rejected_requests, valid_requests, validate_requests
from ..sources.artifacts import PriceModel, latest, load_model


def request_inputs(requests: DataFrame, fitted: PriceModel) -> DataFrame:
    """Valid requests with every engineered input, by the saved state.

    A request has no price of its own, so nothing is taken out of its group. Its sector stands for its locality where it names none. A group
    that the state does not know gets its city's prior; a city it does not know gets NULL, which the encoder fills as a missing value.
    """
    have = set(requests.columns)
    absent = {c: F.lit(None).cast("double") for c in ("price_inr", "price_per_sqft", "latitude", "longitude", "floor_num", "total_floor") if c not in have}
    out = requests.withColumns(absent | ({} if "locality" in have else {"locality": F.col("sector")}) | {"amenities_list": F.col("amenities")})
    nobody = F.lit(False)
    known = fitted.state["prior"].select(F.col("city").alias("__city")).withColumn("__known", F.lit(True))
    out = out.join(F.broadcast(known), out["city"] == known["__city"], "left").drop("__city")
    out = encoders.encode_locality(out, fitted.state["locality"], fitted.state["prior"], loo="members", member=nobody)
    if "sector" in fitted.state:
        spark = requests.sparkSession
        out = geo.add_distances(out, geo.centres_table(spark), geo.stations_table(spark))
        out = encoders.encode_sector(out, fitted.state["sector"], fitted.state["sector_prior"], loo="members", member=nobody)
    means = [c for c in ("locality_avg_price_sqft", "locality_smoothed_price", "sector_smoothed_price") if c in out.columns]
    out = out.withColumns({c: F.when(F.col("__known"), F.col(c)) for c in means}).drop("__known")
    return add_row_features(out, labels=list(fitted.amenities))


def predict(requests: DataFrame, fitted: PriceModel, explain_top: int | None = explain.TOP_CONTRIBUTIONS) -> DataFrame:
    """``requests`` with log-scale ``prediction`` and, for linear models, ``contributions`` (the weightiest inputs first) and ``base``."""
    scored = fitted.model.transform(fitted.encoder.transform(request_inputs(requests, fitted)))
    out = {}
    if explain_top and hasattr(fitted.model, "coefficients"):
        weights = fitted.model.coefficients.toArray()
        parts = explain.fitted_contributions(vector_to_array("features"), fitted.encoder.names, weights, fitted.means)
        out = {"contributions": explain.top_contributions(parts, explain_top), "base": F.lit(explain.base_value(fitted.model.intercept, weights, fitted.means))}
    return scored.withColumns(out).select(*[F.col(f"`{c}`") for c in requests.columns], "prediction", *out)


def split_by_model(checked: DataFrame, models: Mapping[str, PriceModel]) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejected ones) of validated requests; one whose transaction type has no model is rejected with that as its reason."""
    served = F.lower("transact_type").isin(*models) if models else F.lit(False)
    reason = F.when((F.size("problems") == 0) & ~F.coalesce(served, F.lit(False)), F.array(F.concat(F.lit("no model for "), F.col("transact_type"))))
    marked = checked.withColumn("problems", F.coalesce(reason, F.col("problems")))
    return valid_requests(marked), rejected_requests(marked)


def score(valid: DataFrame, models: Mapping[str, PriceModel], explain_top: int | None = None) -> DataFrame:
    """Valid requests with prediction, price, band and ``version``, each by the model of its transaction type."""
    parts = []
    for segment, fitted in sorted(models.items()):
        own = predict(valid.filter(F.lower("transact_type") == segment), fitted, explain_top)
        parts.append(price_columns(own, share=fitted.band).withColumn("version", F.lit(fitted.version)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def log_of(scored: DataFrame, models: Mapping[str, PriceModel]) -> DataFrame:
    """Prediction-log rows, each naming the version that made it."""
    return reduce(DataFrame.unionByName, [log_rows(scored.filter(F.lower("transact_type") == s), m.version) for s, m in sorted(models.items())])


class ModelStore:
    """The finished models of a folder, each read once; ``current`` looks for newer versions and reads only those."""

    def __init__(self, spark: SparkSession, folder: str, versions: Mapping[str, str] | None = None):
        self.spark, self.folder, self.versions = spark, folder, versions
        self.held: dict[str, PriceModel] = {}

    def current(self) -> dict[str, PriceModel]:
        wanted = dict(self.versions) if self.versions is not None else latest(self.spark, self.folder)
        if not wanted:
            raise FileNotFoundError(f"no finished model under {self.folder}")
        for segment, version in wanted.items():
            if segment not in self.held or self.held[segment].version != version:
                self.held[segment] = load_model(self.spark, self.folder, segment, version)
        self.held = {s: self.held[s] for s in wanted}
        return dict(self.held)


def score_requests(requests: DataFrame, folder: str, versions: Mapping[str, str] | None = None, id_cols: tuple[str, ...] = ("request_id",), explain_top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) of a request table by the saved models of ``folder``, the latest finished ones unless named."""
    models = ModelStore(requests.sparkSession, folder, versions).current()
    valid, rejected = split_by_model(validate_requests(requests, id_cols), models)
    return score(valid, models, explain_top), rejected
