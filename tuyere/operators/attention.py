"""Graph attention over a dictionary graph: node features and the forward pass (G-15, G-16)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of node types, their level, and the degree that counts as one.
TYPES = ("root", "work_type", "category", "pool", "dataset")
LEVEL = {"root": 0, "work_type": 1, "category": 2, "pool": 3, "dataset": 4}
FULL_DEGREE = 50


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, x: a one for the node's type, in and out degree (50 and more are 1), level / 4. Degrees are counted before the join."""
    degree = lambda c, name: edges.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(name))
    rows = nodes.select("id", "type").join(degree("dst", "n_in"), "id", "left").join(degree("src", "n_out"), "id", "left")
    part = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(FULL_DEGREE)) / FULL_DEGREE
    level = F.coalesce(F.get(F.array(*[F.lit(LEVEL[t] / 4) for t in TYPES]), F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type")).cast("int") - 1), F.lit(0.0))
    return rows.select("id", F.array(*[(F.col("type") == t).cast("double") for t in TYPES], part("n_in"), part("n_out"), level).alias("x"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _matrix(m: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])


def random_layer(inputs: int, outputs: int = 16, heads: int = 4, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights W (heads, outputs, inputs) and the attention vectors of both ends (heads, outputs), by Glorot's rule."""
    random = np.random.default_rng(seed)
    draw = lambda *shape: random.normal(0, np.sqrt(2 / (inputs + outputs)), shape)
    return {"W": draw(heads, outputs, inputs), "src": draw(heads, outputs), "dst": draw(heads, outputs)}


def attend(vectors: DataFrame, edges: DataFrame, layer: dict[str, np.ndarray], slope: float = 0.2) -> DataFrame:
    """id, x: per head, the sum of the neighbours' (and the node's own) projected vectors, weighted by the softmax over all
    edges that come in; the heads side by side, through an ELU. Maxima and sums are combined before each shuffle, so a hub
    costs a row per task and head."""
    heads, size, _ = layer["W"].shape
    parts = [F.struct(F.lit(k).alias("head"), F.transform(_matrix(layer["W"][k]), lambda row: _dot(row, F.col("x"))).alias("h")) for k in range(heads)]
    rows = vectors.select("id", F.explode(F.array(*parts)).alias("p")).select("id", "p.head", "p.h")
    end = lambda name: F.get(F.array(*[_dot(_vector(v), F.col("h")) for v in layer[name]]), F.col("head"))
    rows = rows.withColumn("to", end("dst")).withColumn("from", end("src"))
    links = edges.select("src", "dst").unionByName(vectors.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    pairs = links.join(rows.select(F.col("id").alias("src"), "head", "h", "from"), "src").join(rows.select(F.col("id").alias("dst"), "head", "to"), ["dst", "head"])
    raw = F.col("from") + F.col("to")
    pairs = pairs.withColumn("e", F.when(raw > 0, raw).otherwise(raw * slope))
    pairs = pairs.join(pairs.groupBy("dst", "head").agg(F.max("e").alias("most")), ["dst", "head"]).withColumn("w", F.exp(F.col("e") - F.col("most")))
    sums = pairs.groupBy("dst", "head").agg(F.sum("w").alias("all"), *[F.sum(F.col("w") * F.get("h", F.lit(k))).alias(f"s{k}") for k in range(size)])
    elu = lambda v: F.when(v > 0, v).otherwise(F.exp(v) - 1)
    one = sums.select(F.col("dst").alias("id"), "head", F.array(*[elu(F.col(f"s{k}") / F.col("all")) for k in range(size)]).alias("h"))
    joined = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("head", "h"))).alias("l"))  # as many as heads
    return joined.select("id", F.flatten(F.transform("l", lambda p: p["h"])).alias("x"))


def _vector(v: np.ndarray) -> Column:
    return F.array(*[F.lit(float(k)) for k in v])
