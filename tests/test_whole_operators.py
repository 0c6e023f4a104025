"""Registered queries run their operators with the operators' own settings, or with those that are stated."""

import itertools

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tuyere.operators import attribution, boosting, scale
from tuyere.plans import model_queries, table_queries

SF = "/root/testdata/sf0.001"


def test_yeo_johnson_query_is_the_operator(spark):
    want, lam = scale.yeo_johnson(table_queries._items(spark, SF), "l_extendedprice")
    expected = {(r.l_orderkey, r.l_linenumber): round(r.scaled, 3) for r in want.collect()}
    got = {(r.l_orderkey, r.l_linenumber): r.scaled for r in table_queries.QUERIES["scale_yeo_johnson"](spark, SF).collect()}
    assert got.keys() == expected.keys() and max(abs(got[k] - expected[k]) for k in got) <= 0.001


def test_shap_ranking_fits_the_whole_grid(spark, monkeypatch):
    """Nothing of the grid, the folds or the rows up to the stated bound is left out."""
    seen = []

    def fit(train, features, target, **options):
        seen.append(options)
        raise InterruptedError

    monkeypatch.setattr(boosting, "fit", fit)
    with pytest.raises(InterruptedError):
        model_queries.shap_ranking(spark, SF)
    assert seen == [{}] and [len(x) for x in boosting.GRID] == [3, 3, 3]


def test_first_trees_of_one_fit_are_the_smaller_choices(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    y = x[:, 0] ** 2 + x[:, 1] + rng.normal(0, 0.5, 240)
    table = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double").coalesce(1).cache()
    grid, folds = ((1, 2), (0.3,), (2, 5)), 2
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(table).select("_x", F.col("y").alias("_y")).withColumn("f", F.pmod(F.xxhash64(F.lit(42), "_x", "_y"), F.lit(folds))).cache()
    errors = {}
    for choice in itertools.product(*grid):
        depth, rate, n = choice
        for k in range(folds):
            model = GBTRegressor(featuresCol="_x", labelCol="_y", seed=42, maxDepth=depth, stepSize=rate, maxIter=n).fit(rows.where(F.col("f") != k))
            e = model.transform(rows.where(F.col("f") == k)).agg(F.avg((F.col("prediction") - F.col("_y")) ** 2)).first()[0]
            errors[choice] = errors.get(choice, 0) + e
    got = attribution.fit(table, ["a", "b"], "y", grid=grid, folds=folds)
    best = min(errors, key=errors.get)
    assert (got.getMaxDepth(), got.getStepSize(), len(got.trees)) == best
