"""The bus with state, replayed in micro-batches with a restart in between."""

import json
import sys
import time

import pytest
from pyspark import cloudpickle

from tuyere.streaming import channels

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test

SCHEMA = "channel string, at long, message_type string, payload string"


class Player:
    """Plays messages into a folder and runs the stream over what is new, each time as a new query on the same checkpoint."""

    def __init__(self, spark, path, channel):
        self.spark, self.path, self.channel = spark, f"file://{path}", channel

    def play(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/in")
        stream = self.spark.readStream.schema(SCHEMA).json(f"{self.path}/in")
        out = channels.publish(stream, self.channel()).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state")
        query = out.trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    def out(self):
        return self.spark.read.parquet(f"{self.path}/out").collect()


def upper(payload):
    doc = json.loads(payload)
    return json.dumps({k: v * 2 for k, v in doc.items()})


def hot(message):
    value = json.loads(message["payload"])["v"]
    if value < 0:
        raise ValueError("below zero")
    return f"{value} is hot" if value > 150 else None


def channel():
    return channels.Channel(keep=4, transform=upper, only=lambda m: m["message_type"] != "noise", callbacks={"hot": hot})


def message(name, at, v, kind="data"):
    return name, at, kind, json.dumps({"v": v}) if v is not None else "no json"


def test_history_statistics_and_callbacks(spark, tmp_path):
    bus = Player(spark, tmp_path, channel)
    bus.play([message("a", k, 10 * k) for k in range(1, 7)] + [message("b", 1, 100)])
    bus.play([message("a", 7, 1, "noise"), message("a", 8, 90), message("c", 1, -5), message("c", 2, None)])
    kept = {}
    for r in channels.history(spark, f"{bus.path}/state").collect():
        kept.setdefault(r.channel, []).append((r.at, r.payload))
    assert sorted(kept["a"]) == [(4, '{"v": 80}'), (5, '{"v": 100}'), (6, '{"v": 120}'), (8, '{"v": 180}')]
    assert sorted(kept["c"]) == [(1, '{"v": -10}'), (2, "no json")]  # what cannot be transformed stays
    figures = {r.channel: tuple(r)[1:] for r in channels.statistics(spark, f"{bus.path}/state").collect()}
    assert figures == {"a": (7, 1, 1, 8), "b": (1, 0, 1, 1), "c": (2, 0, 1, 2)}
    rows = bus.out()
    assert sorted((r.channel, r.n) for r in rows if r.kind == "message") == [("a", k) for k in range(1, 8)] + [("b", 1), ("c", 1), ("c", 2)]
    assert sorted((r.channel, r.at, r.result) for r in rows if r.kind == "callback") == [("a", 8, "180 is hot"), ("b", 1, "200 is hot")]
    errors = [(r.channel, r.at) for r in rows if r.kind == "error"]
    assert sorted(errors) == [("c", 1), ("c", 2)]


def test_idle_channels(spark, tmp_path):
    """The timer of a channel runs out while the stream goes on."""
    path = f"file://{tmp_path}"
    spark.createDataFrame([message("quiet", 1, 1)], SCHEMA).coalesce(1).write.json(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).json(f"{path}/in")
    query = channels.publish(stream, channels.Channel(idle=0.5)).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{path}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("idle").where("kind = 'idle'").count():
            time.sleep(1)
        assert [(r.channel, r.at, r.n) for r in spark.table("idle").where("kind = 'idle'").collect()][0] == ("quiet", 1, 1)
    finally:
        query.stop()


def test_running_anomalies(spark, tmp_path):
    """Moments go on over a restart; NaN and null are passed over."""
    path = f"file://{tmp_path}"
    for values in ([1.0, 2.0, 1.0, 2.0, None], [float("nan"), 1.5, 50.0]):
        spark.createDataFrame([("k", v) for v in values], "key string, v double").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("key string, v double").parquet(f"{path}/in")
        query = channels.running_anomalies(stream, "key", "v").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = {r.value: (r.z, r.is_anomaly) for r in spark.read.parquet(f"{path}/out").collect()}
    assert len(spark.read.parquet(f"{path}/out").collect()) == 6
    mean, sd = 7.5 / 5, (sum((x - 1.5) ** 2 for x in (1, 2, 1, 2, 1.5)) / 5) ** 0.5
    assert got[50.0] == (pytest.approx((50 - mean) / sd), True) and got[1.5][1] is False
