"""Evaluation of responses as they arrive: vote counts are kept as state, metrics are made anew for each trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import evaluation, metrics


def streaming_votes(responses: DataFrame, dialect: str = "afirst") -> DataFrame:
    """Running votes per (item_id, label) of a stream of (item_id, label, sample_idx, response)."""
    return evaluation.votes(evaluation.parse_samples(responses, dialect), keep=["label"])


def follow_accuracy(predictions: DataFrame, sink: Callable[[DataFrame, int], None], by: list[str] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Calls `sink` with counts, accuracy and F1 so far of a stream of (label, score) after each trigger; the state is four counts a group."""
    out = metrics.confusion(predictions, by=by).writeStream.outputMode("complete")
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    return out.foreachBatch(sink).trigger(availableNow=True).start()


def follow_auroc(responses: DataFrame, sink: Callable[[DataFrame, int], None], dialect: str = "afirst", checkpoint: str | None = None) -> StreamingQuery:
    """Calls `sink` with the AUROC so far after each trigger."""
    out = streaming_votes(responses, dialect).writeStream.outputMode("complete")
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    return out.foreachBatch(lambda df, n: sink(metrics.auroc(df, score="p"), n)).trigger(availableNow=True).start()
