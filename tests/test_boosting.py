"""Boosted trees over bins: splits against all splits, choices against plain cross-validation, leaves against predictions."""

import numpy as np
import pytest

from tuyere.operators import attribution, boosting


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.uniform(-2, 2, n), rng.integers(0, 4, n), rng.normal(size=n)])
    return x, np.sin(2 * x[:, 0]) + 0.5 * (x[:, 1] == 2) + 0.1 * rng.normal(size=n)


def test_first_split_is_the_best():
    x, y = data(120)
    edges = boosting.bin_edges(x)
    bins = boosting.binned(x, edges)
    tree, node = boosting.grow(bins, y, 1, 256)
    best = min(
        (((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum(), f, k)
        for f in range(3) for k in range(len(edges[f])) if 20 <= (left := bins[:, f] <= k).sum() <= 100
    )
    assert (tree.feature[0], tree.cut[0]) == best[1:]
    assert np.array_equal(node, tree.at(bins)) and tree.rows[1] + tree.rows[2] == 120
    assert tree.value[1] == pytest.approx(y[node == 1].mean())


def test_trees_keep_enough_rows():
    x, y = data()
    tree, node = boosting.grow(boosting.binned(x, boosting.bin_edges(x)), y, 15, 256)
    leaves = tree.feature < 0
    assert tree.rows[leaves].min() >= boosting.LEAST_ROWS and tree.rows[leaves].sum() == len(y)
    assert np.array_equal(np.bincount(node, minlength=len(leaves)), np.where(leaves, tree.rows, 0))


def test_grid(spark):
    x, y = data()
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(k, *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0, 1.0, 5.0), (901, float("nan"), 1.0, 1.0, 5.0)], "id long, a double, b double, c double, y double")
    grid = ((1, 4), (0.1, 0.5), (5, 20))
    model = boosting.fit(df, names, "y", grid=grid)
    assert len(model.errors) == 8 and model.choice == min(model.errors, key=model.errors.get)
    # one choice by hand, over the same folds
    rows = boosting.bounded_sample(df, "id", [*names, "y"], 10**6, 42)
    assert len(rows) == 400
    fold = np.random.default_rng(42).permutation(np.arange(400) % 3)
    edges, error = boosting.bin_edges(rows[:, :3]), 0.0
    for k in range(3):
        seen, out = rows[fold != k], rows[fold == k]
        mean, trees, _ = boosting.boost(boosting.binned(seen[:, :3], edges), seen[:, 3], 4, 0.1, 20, 256)
        error += ((boosting.Boosted(mean, trees, edges, (), {}).predict(out[:, :3]) - out[:, 3]) ** 2).sum()
    assert model.errors[4, 0.1, 20] == pytest.approx(error / 400)
    assert ((model.predict(x) - y) ** 2).mean() < 0.1 * y.var()
    # what is explained adds up to the prediction
    got = {r.id: r for r in attribution.explain(df.where("id < 50"), model, names).collect()}
    want = model.predict(x[:50])
    assert all(got[k].base + sum(got[k].phi) == pytest.approx(want[k]) for k in range(50))
    assert boosting.fit(df, names, "y", grid=grid).choice == model.choice
    assert boosting.fit(df.where("false"), names, "y", grid=grid).trees == []


def test_cells_stand_for_their_rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 6, 500), rng.integers(0, 3, 500)]).astype(np.int32)
    y = x[:, 0] * 1.5 + rng.normal(size=500)
    cells = boosting.Cells.of(x, y)
    assert len(cells.n) <= 18 and cells.n.sum() == 500
    by_row, _ = boosting.grow(x, y, 4, 256)
    by_cell, _ = boosting.grow(cells.bins, cells.total, 4, 256, times=cells.n)
    assert all(np.allclose(getattr(by_row, k), getattr(by_cell, k)) for k in ("feature", "cut", "left", "value", "rows"))
    names = ["a", "b"]
    df = spark.createDataFrame([(k, *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")
    model = boosting.fit(df, names, "y", grid=((3,), (0.3,), (10,)))
    explained = attribution.explain_cells(df, model, names)
    assert explained.count() <= 18
    rows = {r.feature: r.mean_abs for r in attribution.importance(attribution.explain(df, model, names), names).collect()}
    assert {r.feature: r.mean_abs for r in attribution.importance(explained, names).collect()} == pytest.approx(rows)
