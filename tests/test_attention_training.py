"""Gradients of the trained attention against finite differences, and what training does on the dictionary graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuyere.operators import attention, attention_training, graph
from tuyere.plans.table_queries import _graph

SF = "/root/testdata/sf0.001"


def dense_loss(x, links, pairs, model):
    """The same in plain numpy, a node and a head at a time."""
    h = x
    for layer in model.layers:
        out = []
        for k in range(layer["W"].shape[0]):
            p = h @ layer["W"][k].T
            column = np.zeros((len(x), p.shape[1]))
            for j in range(len(x)):
                into = [a for a, b in links if b == j]
                e = np.array([layer["src"][k] @ p[a] + layer["dst"][k] @ p[j] for a in into])
                w = np.exp(np.where(e > 0, e, 0.2 * e))
                column[j] = (w / w.sum()) @ p[into]
            out.append(np.where(column > 0, column, np.exp(np.minimum(column, 0)) - 1))
        h = np.concatenate(out, 1)
    logit = np.array([h[a] @ model.pair @ h[b] for a, b, _ in pairs])
    y = np.array([p[2] for p in pairs])
    return h, float((np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - y * logit).mean())


@pytest.mark.parametrize("per_part", [1000, 6])
def test_gradients(spark, per_part):
    rng = np.random.default_rng(7)
    names = [f"n{k}" for k in range(9)]
    x = rng.normal(size=(9, 3))
    edges = [(names[a], names[b]) for a, b in {(0, k) for k in range(1, 8)} | {(2, 5), (5, 2), (3, 4), (7, 1)}]  # n0 is a hub, n8 has no link
    pairs = [("n0", "n1", 1.0), ("n5", "n2", 1.0), ("n8", "n0", 0.0), ("n4", "n6", 0.0), ("n3", "n3", 1.0)]
    features = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "id string, x array<double>")
    g = attention_training.graph_of(features, spark.createDataFrame(edges, "src string, dst string"), per_part)
    assert (g.parts.n > 1) == (per_part == 6)
    place = {n: k for k, n in enumerate(names)}
    links = {(place[a], place[b]) for s, d in edges for a, b in ((s, d), (d, s))} | {(k, k) for k in range(9)}
    model = attention_training.new_model(3, hidden=2, outputs=3, heads=2, seed=5)
    model = model.moved(model.flat() + rng.normal(size=model.flat().size) * 0.3)
    dealt = attention_training.Parts.of(attention_training._numbered_pairs(spark.createDataFrame(pairs, "src string, dst string, y double"), g.names, "y"), per_part)
    loss, got = attention_training.gradients(g, dealt, len(pairs), model)
    numbered = [(place[a], place[b], y) for a, b, y in pairs]
    z, want = dense_loss(x, sorted(links), numbered, model)
    assert loss == pytest.approx(want, abs=1e-12)
    flat, h = model.flat(), 1e-6
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k], down[k] = flat[k] + h, flat[k] - h
        slope = (dense_loss(x, sorted(links), numbered, model.moved(up))[1] - dense_loss(x, sorted(links), numbered, model.moved(down))[1]) / (2 * h)
        assert got[k] == pytest.approx(slope, abs=2e-7)
    vectors = {r.id: r.x for r in attention_training.embed(g, model).collect()}
    assert np.allclose([vectors[n] for n in names], z)


def area(rows):
    """How often a linked pair scores above an unlinked one."""
    yes, no = np.array([r.p for r in rows if r.y > 0]), np.array([r.p for r in rows if r.y == 0])
    return float((yes[:, None] > no[None]).mean() + 0.5 * (yes[:, None] == no[None]).mean())


def test_training_on_the_dictionary_graph(spark):
    """Edges that training never sees score better by trained weights than by the ones it started from."""
    _, nodes, edges = _graph(spark, SF)
    held = F.pmod(F.xxhash64(F.lit(3), "src", "dst"), F.lit(5)) == 0
    known = edges.where(F.col("type").isin(*attention_training.EXAMPLES) & ~held)
    g = attention_training.graph_of(attention.features(nodes, known), known)
    pairs = attention_training.examples(nodes, edges, known, 300)
    counts = {r.y: r["count"] for r in pairs.groupBy("y").count().collect()}
    assert counts[1.0] == 300 and counts[0.0] == 300
    assert pairs.where("y = 0").join(edges, ["src", "dst"], "left_semi").count() == 0
    start = attention_training.new_model(8)
    model, losses = attention_training.train(g, pairs, model=start, epochs=12, rate=0.02)
    assert losses[-1] < 0.8 * losses[0]
    new = attention_training.examples(nodes, edges, edges.where(F.col("type").isin(*attention_training.EXAMPLES) & held), 200, seed=9)
    before, after = (area(attention_training.pair_scores(attention_training.embed(g, m), new, m).collect()) for m in (start, model))
    assert after > before + 0.3 and after > 0.7, (before, after)
    again, other = attention_training.train(g, pairs, model=start, epochs=2, rate=0.02)
    assert np.allclose(other, losses[:2])
    links = graph.link_candidates(attention_training.embed(g, model), edges, 0.5).collect()
    assert links and not {(r.a, r.b) for r in links} & {(r.src, r.dst) for r in edges.collect()}
