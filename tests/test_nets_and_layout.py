"""The autoencoder's gradients and what it finds; layouts and their crossings."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuyere.operators import autoencoder, layout, models


def test_gradient():
    rng = np.random.default_rng(1)
    sizes = autoencoder.shapes(3, (5, 2, 5))
    flat, x = autoencoder.start(sizes, 1) + 0.1 * rng.normal(size=sum(a * b + b for a, b in sizes)), rng.normal(size=(7, 3))
    loss, g = autoencoder.loss_and_gradient(flat, sizes, x)
    assert loss == pytest.approx(((autoencoder.outputs(autoencoder.unpack(flat, sizes), x)[-1] - x) ** 2).mean() / 2)
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (autoencoder.loss_and_gradient(up, sizes, x)[0] - autoencoder.loss_and_gradient(down, sizes, x)[0]) / 2e-6
        assert g[k] == pytest.approx(slope, abs=1e-6)


def test_curved_structure(spark):
    """Points off a circle, between its sides, are found by the net; principal axes see nothing odd in them."""
    rng = np.random.default_rng(2)
    angle = rng.uniform(0, 2 * np.pi, 1500)
    x = np.column_stack([np.cos(angle), np.sin(angle), np.cos(angle) + 0.02 * rng.normal(size=1500)])
    x[:20, :2] = rng.normal(size=(20, 2)) * 0.05
    x[:20, 2] = x[:20, 0]
    df = spark.createDataFrame([(k, *v.tolist()) for k, v in enumerate(x)] + [(9000, None, 1.0, 1.0), (9001, float("nan"), 1.0, 1.0)], "id long, a double, b double, c double").repartition(2)
    names = ["a", "b", "c"]
    got = autoencoder.autoencoder(df, names, hidden=(16, 8, 1, 8, 16), rounds=25, rate=0.01, share=0.05).cache()
    found = {r.id for r in got.where("is_outlier").collect()}
    linear = {r.id for r in models.linear_autoencoder(df, names, width=1).where("is_outlier").collect()}
    assert len(found & set(range(20))) >= 16 and len(linear & set(range(20))) <= 5
    assert got.count() == 1502 and got.where("id >= 9000 and (error is not null or is_outlier)").count() == 0
    assert autoencoder.autoencoder(df.where("false"), names).count() == 0


def test_training_stops(spark):
    rows = spark.createDataFrame([(k % 10 == 0, [0.0, 0.0]) for k in range(200)], "held boolean, x array<double>").repartition(2)
    _, losses = autoencoder.train(rows, 2, hidden=(2,), rounds=40, patience=3)
    assert len(losses) < 40 and losses[-1] < 1e-3


def graph(spark, seed=3):
    rng = random.Random(seed)
    nodes = [(f"{kind}{k}", kind, level) for level, (kind, n) in enumerate((("r", 2), ("c", 9), ("d", 30))) for k in range(n)]
    edges = [(f"r{k % 2}", f"c{k}") for k in range(9)] + [(f"c{rng.randrange(9)}", f"d{k}") for k in range(30)] + [(f"r{rng.randrange(2)}", f"d{k}") for k in range(0, 30, 3)]
    return nodes, edges, spark.createDataFrame(nodes, "id string, type string, level int"), spark.createDataFrame(edges, "src string, dst string")


def plain_crossings(place, level, edges):
    pairs = [tuple(sorted((a, b), key=lambda n: level[n])) for a, b in set(edges)]
    return sum(
        level[a] == level[c] and level[b] == level[d] and (place[a] - place[c]) * (place[b] - place[d]) < 0
        for (a, b), (c, d) in itertools.combinations(pairs, 2)
    )


def test_layered(spark):
    nodes, edges, n, e = graph(spark)
    level = {i: k for i, _, k in nodes}
    before = {r.id: r.place for r in layout.layered(n, e, 0).collect()}
    rows = layout.layered(n, e, 6).collect()
    after = {r.id: r.place for r in rows}
    for k in range(3):
        assert sorted(p for i, p in after.items() if level[i] == k) == list(range(sum(v == k for v in level.values())))
    first, last = plain_crossings(before, level, edges), plain_crossings(after, level, edges)
    assert last < 0.7 * first, (first, last)
    assert layout.crossings(spark.createDataFrame([(r.id, r.level, r.place) for r in rows], "id string, level int, place long"), e) == last
    assert all(0 < r.x < 1 and r.y == -r.level for r in rows) and len({(r.x, r.y) for r in rows}) == len(nodes)


def test_first_children(spark):
    _, edges, n, e = graph(spark)
    left, kept = layout.first_children(n, e, 2)
    per = kept.join(n.withColumnRenamed("id", "dst"), "dst").groupBy("src", "type").count()
    assert per.agg(F.max("count")).first()[0] <= 2
    ids = {r.id for r in left.collect()}
    assert {"r0", "r1", "c0", "c2", "c1", "c3"} <= ids
    assert all(r.src in ids and r.dst in ids for r in kept.collect())
