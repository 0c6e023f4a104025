"""A message bus with state per channel: the last messages, statistics, and user functions that are called for each message
(H-08, H-09). State is kept by Spark in the checkpoint's store, so a stream that starts again goes on where it was.

A channel's messages are handled in one place in the order they come in, as its history has an order; a stream whose messages
do not need one should use the aggregations of ``streams``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "at long, message_type string, payload string"
OUT = "channel string, at long, message_type string, payload string, n long, dropped long, kind string, name string, result string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Channel(StatefulProcessor):
    """Per channel: how many messages came and how many a filter dropped, when the first and the last came, and the last
    ``keep`` of them in a ring of that many places, so that a message writes one place whatever the length of the history.

    A transformer that fails leaves the message as it is; a callback that fails gives an error row; neither stops the stream.
    A channel without a message for ``idle`` seconds gives a row of kind idle, once until the next message."""

    def __init__(self, keep: int = 1000, transform: Callable[[str], str] | None = None, only: Callable[[dict], bool] | None = None, callbacks: dict[str, Callable[[dict], object]] | None = None, idle: float | None = None):
        self.keep, self.transform, self.only, self.callbacks, self.idle = keep, transform, only, callbacks or {}, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.figures = handle.getValueState("figures", "n long, dropped long, first_at long, last_at long")
        self.ring = handle.getMapState("history", "slot int", MESSAGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, dropped, first, last = self.figures.get() if self.figures.exists() else (0, 0, None, None)
        for pdf in rows:
            out = []
            for at, kind, payload in pdf.sort_values("at", kind="stable")[["at", "message_type", "payload"]].itertuples(index=False):
                message = {"channel": key[0], "at": int(at), "message_type": kind, "payload": payload}
                if self.transform:
                    try:
                        message["payload"] = self.transform(payload)
                    except Exception:  # noqa: BLE001 - the message stays as it came
                        pass
                if self.only and not self.only(message):
                    dropped += 1
                    continue
                self.ring.updateValue((n % self.keep,), (message["at"], kind, message["payload"]))
                n += 1
                first, last = message["at"] if first is None else first, message["at"]
                head = (key[0], message["at"], kind, message["payload"], n, dropped)
                out.append((*head, "message", None, None))
                for name, call in self.callbacks.items():
                    try:
                        result = call(message)
                        if result is not None:
                            out.append((*head, "callback", name, str(result)))
                    except Exception as e:  # noqa: BLE001 - a callback's failure is a result
                        out.append((*head, "error", name, str(e)[:200]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        self.figures.update((n, dropped, first, last))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, (list, tuple)) else t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, dropped, _, last = self.figures.get()
        yield pd.DataFrame([(key[0], last, None, None, n, dropped, "idle", None, None)], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def publish(stream: DataFrame, channel: Channel | None = None) -> DataFrame:
    """What the channels of a stream of messages (channel, at, message_type, payload) make of them: a row for each message that
    passes, one for each callback that answers or fails, one for each channel that has gone quiet."""
    channel = channel or Channel()
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.select("channel", F.col("at").cast("long").alias("at"), "message_type", "payload")
    return rows.groupBy("channel").transformWithStateInPandas(channel, OUT, "Append", "None" if channel.idle is None else "ProcessingTime")


def history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """channel, at, message_type, payload: the last messages of every channel, from the stream's state."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "history").load()
    return rows.select("key.channel", "user_map_value.*")


def statistics(spark: SparkSession, checkpoint: str) -> DataFrame:
    """channel, n, dropped, first_at, last_at, from the stream's state."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "figures").load()
    return rows.select("key.channel", "value.*")


class Running(StatefulProcessor):
    """The z-score of each value of a key against all values before it; the state is three numbers."""

    def __init__(self, value: str, threshold: float):
        self.value, self.threshold = value, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0)
        for pdf in rows:
            out = []
            for x in pdf[self.value]:
                sd = (m2 / n) ** 0.5 if n else 0.0
                z = abs(x - mean) / sd if sd > 1e-10 else 0.0
                out.append((key[0], float(x), z, z > self.threshold))
                n += 1
                step = x - mean
                mean += step / n
                m2 += step * (x - mean)
            yield pd.DataFrame(out, columns=["key", "value", "z", "is_anomaly"])
        self.moments.update((n, float(mean), float(m2)))

    def close(self) -> None:
        pass


def running_anomalies(stream: DataFrame, key: str, value: str, threshold: float = 2.5) -> DataFrame:
    """key, value, z, is_anomaly; null and NaN are no values."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    return rows.groupBy("key").transformWithStateInPandas(Running("value", threshold), "key string, value double, z double, is_anomaly boolean", "Append", "None")
