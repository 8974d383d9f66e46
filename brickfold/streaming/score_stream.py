"""Scoring a stream of requests into the prediction log."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import log_rows, price_columns, rejected_requests, valid_requests, validate_requests
from ..plans import serving


def _start(
    requests: DataFrame, judge: Callable[[DataFrame], tuple[DataFrame, DataFrame]], log_path: str, reject_path: str, checkpoint: str,
    id_cols: tuple[str, ...], available_now: bool,
) -> StreamingQuery:
    """``judge`` gives the log rows and the rejected rows of a validated micro-batch; a replayed batch rewrites only its own folders.

    The rows of a batch, often one or two files, are dealt to all cores before they are scored.
    """
    checked = validate_requests(requests, id_cols)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism).persist()
        try:
            log, rejected = judge(batch)
            log.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
            rejected.select(*id_cols, "problems").write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_stream(
    requests: DataFrame, predict: Callable[[DataFrame], DataFrame], log_path: str, reject_path: str, checkpoint: str, version: str,
    id_cols: tuple[str, ...] = ("request_id",), available_now: bool = True,
) -> StreamingQuery:
    """Validate, score by ``predict`` (which adds a log-scale ``prediction``) and append each micro-batch.

    No state is kept between batches. Rejected requests go to their own table with their reasons.
    """
    return _start(requests, lambda b: (log_rows(price_columns(predict(valid_requests(b))), version), rejected_requests(b)), log_path, reject_path, checkpoint, id_cols, available_now)


def score_stream_saved(
    requests: DataFrame, folder: str, log_path: str, reject_path: str, checkpoint: str, versions: Mapping[str, str] | None = None,
    id_cols: tuple[str, ...] = ("request_id",), available_now: bool = True,
) -> StreamingQuery:
    """Validate, score by the saved models of ``folder`` and append each micro-batch.

    Each batch joins the models' state tables as they stand and takes the latest finished version, read again only when a newer one is there,
    unless ``versions`` names one for each segment. A batch scores its rows exactly as ``serving.score_requests`` would.
    """
    store = serving.ModelStore(requests.sparkSession, folder, versions)

    def judge(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        models = store.current()
        valid, rejected = serving.split_by_model(batch, models)
        return serving.log_of(serving.score(valid, models), models), rejected

    return _start(requests, judge, log_path, reject_path, checkpoint, id_cols, available_now)
