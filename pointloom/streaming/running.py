"""Confusion counts of scenes as they arrive: additive, so a streaming aggregate keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pointloom.operators.metrics import confusion


def running_confusion(stream: DataFrame, n_classes: int) -> DataFrame:
    """(gt, pred, n) so far; state is bounded by the number of class pairs."""
    return confusion(stream, n_classes)


def start(stream: DataFrame, n_classes: int, name: str, checkpoint: str) -> StreamingQuery:
    return running_confusion(stream, n_classes).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
