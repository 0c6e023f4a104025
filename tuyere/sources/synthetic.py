"""Made tables and series for trials (I-12 to I-14, G-19): expressions over spark.range, seeded by row number, so that any
number of rows is made in parallel and a row does not depend on how rows are dealt."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: str, *by: Column) -> Column:
    """In (0, 1), by a hash of the seed and the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: str, *by: Column) -> Column:
    """Standard normal, by the polar form of two uniform numbers."""
    return F.sqrt(-2 * F.log(uniform(seed + "/r", *by))) * F.cos(2 * math.pi * uniform(seed + "/a", *by))


# Name, constant, (name, factor) of other columns, deviation of the noise.
FURNACE = [
    ("风温", 1500.0, [], 50.0),
    ("炉顶温度", 200.0, [("风温", 0.7)], 30.0),
    ("热风温度", 100.0, [("风温", 0.9)], 20.0),
    ("热风压力", 0.35, [], 0.05),
    ("炉顶压力", 0.05, [("热风压力", 0.8)], 0.01),
    ("冷风压力", 0.03, [("热风压力", 0.6)], 0.01),
    ("风量", 5000.0, [], 500.0),
    ("富氧流量", 500.0, [("风量", 0.1)], 100.0),
    ("喷煤量", 750.0, [("风量", 0.15)], 150.0),
    ("CO含量", 25.0, [], 3.0),
    ("CO2含量", 18.0, [], 2.0),
    ("H2含量", 3.0, [], 0.5),
    ("焦比", 350.0, [], 30.0),
    ("煤比", 150.0, [], 20.0),
]
RATIO = ("矿焦比", "焦比", "煤比", 0.5, 0.1, 0.02)
TARGET = ("铁水温度", 1450.0, [("风温", 0.3), ("热风温度", 0.2), ("热风压力", 15.0), ("风量", 0.001), ("焦比", 0.05), ("煤比", 0.05), ("CO含量", 0.5)], 30.0)


def furnace(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id and 16 numbers that hang together as in FURNACE, RATIO and TARGET."""
    rows = spark.range(n)

    def add(df: DataFrame, name: str, constant: float, parts: list, noise: float) -> DataFrame:
        value = F.lit(constant)
        for other, factor in parts:
            value = value + F.col(other) * factor
        return df.withColumn(name, value + noise * normal(f"{seed}:{name}", F.col("id")))

    for entry in FURNACE:
        rows = add(rows, *entry)
    name, top, bottom, factor, constant, noise = RATIO
    rows = rows.withColumn(name, F.col(top) / F.col(bottom) * factor + constant + noise * normal(f"{seed}:{name}", F.col("id")))
    return add(rows, *TARGET)


def patterns(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id and ten columns of known shape."""
    i = F.col("id")
    e = lambda name: -F.log(uniform(f"{seed}:{name}", i))
    z = lambda name: normal(f"{seed}:{name}", i)
    rows = spark.range(n).select(
        "id", (100 + 10 * z("normal")).alias("normal"), (50 * e("right")).alias("right_skewed"), (100 - 50 * e("left")).alias("left_skewed"),
        (100 + 5 * F.when(uniform(f"{seed}:peak", i) < 0.05, 6.0).otherwise(1.0) * z("peaked")).alias("peaked"), (80 + 40 * uniform(f"{seed}:flat", i)).alias("flat"),
        (100 + 50 * z("high")).alias("high_variance"), (100 + 2 * z("low")).alias("low_variance"),
        (100 + 20 * F.sin(i * (8 * math.pi / max(n, 1))) + 2 * z("periodic")).alias("periodic"), (100 + i * (50.0 / max(n, 1)) + 5 * z("trend")).alias("trend"),
    )
    return rows.withColumn("target", 0.3 * F.col("normal") + 0.2 * F.col("trend") + 5 * z("target"))


#: Shapes of a series by its group: (part of a slow wave, of a fast wave, of a trend, of a step, of noise).
SHAPES = {"stable": (0.0, 0.0, 0.0, 0.0, 1.0), "wave": (5.0, 0.0, 0.0, 0.0, 0.5), "fast_wave": (0.0, 4.0, 0.0, 0.0, 0.5), "rising": (0.0, 0.0, 8.0, 0.0, 0.7), "falling": (0.0, 0.0, -8.0, 0.0, 0.7), "step": (0.0, 0.0, 0.0, 6.0, 0.5), "mixed": (3.0, 2.0, 3.0, 0.0, 0.5), "noisy": (0.0, 0.0, 0.0, 0.0, 3.0), "wave_on_trend": (4.0, 0.0, 5.0, 0.0, 0.5)}


def series(nodes: DataFrame, steps: int, *, id_col: str = "id", share: float = 0.05, seed: int = 42) -> DataFrame:
    """id, shape, timestep, value, is_anomaly: a series per node, of a shape chosen by the id; a share of the nodes jumps by 3
    to 6 deviations of its noise in the last twentieth of its steps. A row per node and step, made without a shuffle."""
    node, at = F.col("id"), F.col("timestep") / float(max(steps, 1))
    table = F.array(*[F.struct(F.lit(name).alias("shape"), *[F.lit(v).alias(k) for k, v in zip(("slow", "fast", "trend", "jump", "noise"), values, strict=True)]) for name, values in SHAPES.items()])
    rows = nodes.select(F.col(id_col).alias("id")).withColumn("s", F.get(table, F.floor(uniform(f"{seed}:shape", node) * len(SHAPES)).cast("int")))
    rows = rows.withColumn("odd", uniform(f"{seed}:odd", node) < share).withColumn("timestep", F.explode(F.sequence(F.lit(0), F.lit(max(steps, 1) - 1))))
    is_odd = F.col("odd") & (F.col("timestep") >= int(steps * 0.95))
    s = F.col("s")
    value = 100 + s["slow"] * F.sin(2 * math.pi * at) + s["fast"] * F.sin(20 * math.pi * at) + s["trend"] * at + F.when(at >= 0.5, s["jump"]).otherwise(0.0) + s["noise"] * normal(f"{seed}:noise", node, F.col("timestep"))
    jump = F.when(is_odd, s["noise"] * (3 + 3 * uniform(f"{seed}:size", node))).otherwise(0.0)
    return rows.select("id", s["shape"].alias("shape"), "timestep", (value + jump).alias("value"), is_odd.alias("is_anomaly"))


def scenario(datasets: DataFrame, kind: str = "normal", steps: int = 10, *, start: str = "2024-01-01 00:00:00", seed: int = 42) -> DataFrame:
    """dataset, ts, value, status: a value a minute. A normal run stays near its mean; an abnormal one is off by four
    deviations; a transition moves from the one to the other."""
    weight = {"normal": F.lit(0.0), "abnormal": F.lit(1.0), "transition": F.col("k") / float(max(steps - 1, 1))}[kind]
    rows = datasets.select("dataset").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(steps, 1) - 1))))
    mean = 50 + 100 * uniform(f"{seed}:mean", F.col("dataset"))
    value = mean + mean * 0.02 * (normal(f"{seed}:v", F.col("dataset"), F.col("k")) + 4 * weight)
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + 60 * F.col("k"))
    return rows.select("dataset", ts.alias("ts"), value.alias("value"), F.when(weight >= 0.5, "anomaly").otherwise("normal").alias("status"))


def fake_column(name: str, kind: str, seed: int = 42) -> Column:
    """A value for a column by its name, else by its type."""
    n, i = name.lower(), F.col("id")
    u = uniform(f"{seed}:{name}", i)
    if "time" in n or "date" in n or kind.startswith(("timestamp", "date")):
        return F.timestamp_seconds(1_704_067_200 + F.col("id") * 60).cast(kind if kind.startswith(("timestamp", "date")) else "string")
    for word, (low, high) in (("temp", (800.0, 1600.0)), ("press", (0.1, 0.5)), ("flow", (1000.0, 6000.0)), ("rate", (0.0, 1.0)), ("percent", (0.0, 100.0))):
        if word in n and kind in ("double", "float"):
            return (low + (high - low) * u).cast(kind)
    if kind in ("double", "float") or kind.startswith("decimal"):
        return (100 * u).cast(kind)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.floor(100 * u).cast(kind)
    if kind == "boolean":
        return u < 0.5
    if "status" in n:
        return F.get(F.array(*[F.lit(x) for x in ("normal", "warning", "alarm")]), F.floor(3 * u).cast("int"))
    return F.concat(F.lit(f"{name}_"), F.floor(1_000_000 * u).cast("string"))


def fake_rows(spark: SparkSession, columns: list[tuple[str, str]], n: int, *, known: DataFrame | None = None, overwrite: bool = False, seed: int = 42) -> DataFrame:
    """n rows for (name, type) columns. With known rows: those topped up to n in all, or, to overwrite, new rows beside them."""
    have = known.count() if known is not None else 0
    wanted = n if overwrite or known is None else max(0, n - have)
    rows = spark.range(have, have + wanted).select("id", *[fake_column(c, k, seed).alias(c) for c, k in columns if c != "id"])
    rows = rows.select(*[F.col(c).cast(k).alias(c) for c, k in columns])
    return rows if known is None else known.unionByName(rows)
