"""Boosted trees and what each column adds to their predictions (E-10, E-11, E-13)."""

from __future__ import annotations

from collections.abc import Iterable
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.functions.storage import stored
from tuyere.operators.stats import rank_of

#: Depths, rates and numbers of trees that fit() tries with Spark's own trees. The whole grid in one go is in ``boosting``.
GRID = ((3, 5, 7), (0.01, 0.1, 0.2), (100, 200, 300))

#: Codes of a column that every task holds; with more, rows are joined to them by a shuffle.
FEW_CODES = 100_000


def factorize(df: DataFrame, column: str, id_col: str) -> DataFrame:
    """The column as codes from 0 in the order of first appearance by id; null is -1. Ids are unique numbers."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_x")).agg(F.min(id_col).alias("_first"))
    codes = stored(rank_of(stored(firsts, "firsts"), "_first", "_rank").select("_x", (F.col("_rank") - 1).cast("double").alias("_code")), "codes")
    if codes.count() <= FEW_CODES:
        codes = F.broadcast(codes)
    return df.join(codes, F.col(column) == F.col("_x"), "left").withColumn(column, F.coalesce("_code", F.lit(-1.0))).drop("_x", "_code")


def prepare(df: DataFrame, features: list[str], target: str, *, id_col: str = "id", seed: int = 42) -> DataFrame:
    """id, features and target as doubles, and is_train (seven of ten rows by a hash of the id): texts are factorized, missing
    numbers take the column's median, rows without a target go."""
    kinds = dict(df.dtypes)
    rows = df.select(id_col, *features, target).where(F.col(target).isNotNull())
    for c in features:
        rows = factorize(rows, c, id_col) if kinds[c] == "string" else rows.withColumn(c, F.col(c).cast("double"))
    medians = rows.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"_m_{c}") for c in features])
    filled = rows.crossJoin(F.broadcast(medians)).select(id_col, *[F.coalesce(c, f"_m_{c}").alias(c) for c in features], F.col(target).cast("double").alias(target))  # one row
    return filled.withColumn("is_train", F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(10)) < 7)


def fit(train: DataFrame, features: list[str], target: str, *, grid: tuple[Iterable, Iterable, Iterable] = GRID, folds: int = 3, seed: int = 42):
    """The boosted trees of least squared error in cross-validation; without folds if the grid holds one choice.

    Boosting adds tree after tree, so the choices that differ in the number of trees only are one fit of the largest, whose
    first trees are the smaller ones; its error after each tree takes one pass over the fold left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    depths, rates, sizes = (sorted(set(x)) for x in grid)
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(train).select("_x", F.col(target).alias("_y"))
    trees = lambda depth, rate, n: GBTRegressor(featuresCol="_x", labelCol="_y", seed=seed, maxDepth=depth, stepSize=rate, maxIter=n)
    if len(depths) * len(rates) * len(sizes) == 1:
        return trees(depths[0], rates[0], sizes[0]).fit(rows)
    rows = stored(rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), "_x", "_y"), F.lit(folds))), "folds")
    best = None
    for depth in depths:
        for rate in rates:
            errors = np.zeros(len(sizes))
            for k in range(folds):
                model = trees(depth, rate, sizes[-1]).fit(rows.where(F.col("_fold") != k))
                by_tree = model.evaluateEachIteration(rows.where(F.col("_fold") == k), "squared")
                errors += [by_tree[n - 1] for n in sizes]
            choice = min(zip(errors.tolist(), [(depth, rate, n) for n in sizes], strict=True))
            best = min(best, choice) if best else choice
    return trees(*best[1]).fit(rows)


def leaves(model) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, path) of all leaves; a path has (feature, above, up to, share of rows that go this way) once per feature."""
    if hasattr(model, "leaves"):
        return model.leaves()
    out = []

    def walk(node, weight: float, path: dict) -> None:
        if node.subtreeDepth() == 0:
            out.append((weight * node.prediction(), [(f, *x) for f, x in sorted(path.items())]))
            return
        f, cut, n = node.split().featureIndex(), node.split().threshold(), node.impurityStats().count()
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, ends in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            walk(child, weight, path | {f: (*ends, share * child.impurityStats().count() / n)})

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        walk(tree._call_java("rootNode"), weight, {})
    return out


def _sizes(inside: list[np.ndarray], shares: list[float], n: int) -> list[np.ndarray]:
    """Sums, by the size of T, over subsets T of the path of the product of inside over T and shares over the rest."""
    sums = [np.ones(n)]
    for x, share in zip(inside, shares, strict=True):
        sums = [(sums[k] * share if k < len(sums) else 0.0) + (sums[k - 1] * x if k else 0.0) for k in range(len(sums) + 1)]
    return sums


def shapley(found, x: np.ndarray, pairs: bool = False) -> tuple[float, np.ndarray]:
    """(base, values): path-dependent Shapley values, rows by features, or interaction values, rows by features twice (the
    diagonal holds what is left of a feature's own value). A leaf is a product game of the few features on its path."""
    n, d = x.shape
    base, phi, both = 0.0, np.zeros((n, d)), np.zeros((n, d, d) if pairs else (0, 0, 0))
    for value, path in found:
        m = len(path)
        base += value * float(np.prod([p[3] for p in path]))
        inside = [((x[:, f] > a) & (x[:, f] <= b)).astype(float) for f, a, b, _ in path]
        shares = [p[3] for p in path]
        for j in range(m):
            rest = [k for k in range(m) if k != j]
            sums = _sizes([inside[k] for k in rest], [shares[k] for k in rest], n)
            total = sum(factorial(s) * factorial(m - s - 1) / factorial(m) * v for s, v in enumerate(sums))
            phi[:, path[j][0]] += value * total * (inside[j] - shares[j])
            for i in range(j) if pairs else ():
                rest = [k for k in range(m) if k not in (i, j)]
                sums = _sizes([inside[k] for k in rest], [shares[k] for k in rest], n)
                total = sum(factorial(s) * factorial(m - s - 2) / (2 * factorial(m - 1)) * v for s, v in enumerate(sums))
                more = value * total * (inside[i] - shares[i]) * (inside[j] - shares[j])
                both[:, path[i][0], path[j][0]] += more
                both[:, path[j][0], path[i][0]] += more
    if not pairs:
        return base, phi
    for f in range(d):
        both[:, f, f] = phi[:, f] - both[:, f, :].sum(axis=1)
    return base, both


def explain(df: DataFrame, model, features: list[str], *, id_col: str = "id", pairs: bool = False) -> DataFrame:
    """id, base, phi (an array by feature; with pairs by feature and feature, row by row). Base and phi add up to the
    prediction. No shuffle: the leaves, a few numbers each, go to all tasks."""
    found = leaves(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), 10_000):
                rows = part.iloc[at : at + 10_000]
                base, phi = shapley(found, rows[features].to_numpy(float), pairs)
                yield pd.DataFrame({id_col: rows[id_col].to_numpy(), "base": base, "phi": list(phi.reshape(len(rows), -1))})

    return df.select(id_col, *features).mapInPandas(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, base double, phi array<double>")


def explain_cells(df: DataFrame, model, features: list[str]) -> DataFrame:
    """base, phi and n of each different row of the features: how many rows there are of it, which all have these values."""
    cells = df.groupBy(*features).agg(F.count("*").alias("n"))
    tasks = max(24, 2 * df.sparkSession.sparkContext.defaultParallelism)  # few rows, but each takes all leaves
    return explain(cells.repartition(tasks, *features), model, features, id_col="n")


def importance(explained: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean_abs: features by their mean absolute value over rows, or over the n that a row stands for, the highest
    first."""
    names = F.array(*[F.lit(c) for c in features])
    times = F.col("n") if "n" in explained.columns else F.lit(1)
    means = explained.agg(F.array(*[F.sum(F.abs(F.get("phi", F.lit(k))) * times) / F.sum(times) for k in range(len(features))]).alias("m"))
    ranked = means.select(F.posexplode("m").alias("k", "mean_abs"))
    return ranked.select(F.get(names, F.col("k")).alias("feature"), "mean_abs").orderBy(F.desc("mean_abs"), "feature")
