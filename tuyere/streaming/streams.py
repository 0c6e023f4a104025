"""Streaming forms, additional to the batch operators: tumbling grids, sessions, a message bus without state, a closed
loop. What keeps state is in channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean, least, largest and number per key and window; late rows count until the watermark passes the window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"), F.count("*").alias("n"))


def sliding(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def bus(stream: DataFrame, only: Column | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Messages of a stream or table, filtered and transformed."""
    if only is not None:
        stream = stream.where(only)
    return stream.transform(transform) if transform else stream


class ClosedLoop:
    """Phases run in order over each micro-batch; a failing phase is noted and the next ones go on with what came before."""

    PHASES = ("collect", "preprocess", "analyse", "decide", "act", "feedback")

    def __init__(self, **handlers: Callable[[DataFrame], DataFrame]) -> None:
        unknown = set(handlers) - set(self.PHASES)
        if unknown:
            raise ValueError(f"unknown phases: {sorted(unknown)}")
        self.handlers, self.history = handlers, []

    def __call__(self, batch: DataFrame, epoch: int = 0) -> DataFrame:
        for phase in self.PHASES:
            handler = self.handlers.get(phase)
            if handler is None:
                continue
            try:
                batch = handler(batch)
                self.history.append((epoch, phase, "done", ""))
            except Exception as e:  # noqa: BLE001 - the loop goes on and tells
                self.history.append((epoch, phase, "failed", str(e)[:200]))
        return batch

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(lambda df, epoch: self(df, epoch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
