"""What keeps queries within memory and time on tables much larger than their files suggest."""

import numpy as np
from pyspark.sql import functions as F

from tuyere.functions import names, quantiles
from tuyere.operators import autoencoder, knowledge, layout, models


def test_put_edges_broadcasts_no_pairs(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"), F.lit("cross").alias("type"), F.lit(0.5).alias("weight")).write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    new = edges.where("src < '5'").withColumn("weight", F.lit(0.8)).union(edges.where("src < '5'").withColumn("weight", F.lit(0.1)))
    got = knowledge.put_edges(edges, new)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    n = edges.where("src < '5'").count()
    assert {(r.weight, r["count"]) for r in got.groupBy("weight").count().collect()} == {(0.8, n), (0.5, 1000 - n)}


def test_names_compute_each_replacement_once(spark):
    rows = spark.createDataFrame([("  9(A b)【c】% ", "Order"), (None, ""), ("x" * 60, "(a)"), ("---", "9")], "a string, b string")
    one = rows.select(names.normalise_name(F.col("a")).alias("n"))
    both = rows.select(names.table_name(F.col("a"), F.col("b")).alias("n"))
    for df, most in ((one, 5), (both, 10)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= most
    assert [r.n for r in one.collect()] == ["t_9_a_b_c", "unnamed", "x" * 50, ""]
    assert [r.n for r in both.collect()] == ["t_9_a_b_c_order_col", "unnamed_unnamed", "x" * 50 + "_a", "_t_9"]


def test_forest_scores_each_row_once_as_a_walk_does(spark):
    random = np.random.default_rng(1)
    trees = [models.grow_tree(random.normal(size=(64, 3)), random, 6) for _ in range(5)]
    rows = random.normal(size=(5000, 3))

    def walk(tree, row, at=0):
        while tree[at, 0] >= 0:
            at = int(tree[at, 2] if row[int(tree[at, 0])] <= tree[at, 1] else tree[at, 3])
        return tree[at, 4]

    expected = np.array([sum(walk(t, row) for t in trees) for row in rows])
    assert (models.depths([models._steps(t) for t in trees], 6, rows) == expected).all()
    table = spark.range(500).select("id", F.sin("id").alias("x"), F.cos("id").alias("y"))
    assert "ArrowEvalPython" not in models.isolation_forest(table, ["x", "y"])._jdf.queryExecution().executedPlan().toString()


def test_lanes_learn_as_plain_steps_do():
    random = np.random.default_rng(3)
    sizes = autoencoder.shapes(3, (5, 2, 5))
    first, rows = autoencoder.start(sizes, 1), random.normal(size=(3, 70, 3))
    net = autoencoder.Lanes(np.concatenate([first, np.zeros(2 * len(first))]), sizes, 3, 32, np.float64)
    assert net.learn(rows.transpose(1, 0, 2).reshape(-1, 3), 4, 0.01) == 3
    for lane in range(3):
        p, m, v = first, np.zeros_like(first), np.zeros_like(first)
        for t, k in enumerate(range(0, 70, 32), 5):
            _, g = autoencoder.loss_and_gradient(p, sizes, rows[lane, k : k + 32])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(net.p[lane], p, atol=1e-12) and np.allclose(net.m[lane] / 10, m, atol=1e-12)


def test_autoencoder_deals_a_single_file_to_parts(spark, monkeypatch):
    """All rows are learned from or held out, in parts of like size, and are scored once."""
    monkeypatch.setattr(autoencoder, "NET_ROWS", 1000)
    monkeypatch.setattr(autoencoder, "PARTS", 4)
    rows = spark.range(0, 10_003, 1, 1).select((F.col("id") % 10 == 0).alias("held"), F.array(F.sin("id"), F.cos("id")).alias("x"))
    blocks = autoencoder.packed(rows, 4)
    sizes = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum(F.length("held")).alias("n"), F.sum(F.length("x")).alias("bytes")).collect()}
    assert len(sizes) == 4 and sum(sizes.values()) == 10_003 and max(sizes.values()) <= 1.3 * min(sizes.values())
    assert blocks.agg(F.sum(F.length("x"))).first()[0] == 10_003 * 16
    params, losses = autoencoder.train(rows, 2, hidden=(8, 2, 8), rounds=6, rate=0.01)
    assert len(losses) == 7 and losses[-1] < 0.1 * losses[0] and np.isfinite(params).all()
    got = autoencoder.autoencoder(spark.range(500).select("id", F.sin("id").alias("x"), F.cos("id").alias("y")), ["x", "y"], rounds=1)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_ranking_tasks_follow_the_rows(spark, monkeypatch):
    """Repeated values take few bytes, so Spark would join the partitions of all rows to a few; they are ordered once."""
    monkeypatch.setattr(quantiles, "TASK_ROWS", 2000)
    table = spark.range(20_000).select("id", (F.col("id") * 7919 % 5000).cast("double").alias("x"))
    got = quantiles.with_ranks(table, {"x": "r"}, few=100, bucket_rows=200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() == 10 and plan.count("Window [") == 1 and plan.count("Sort [") == 1
    assert got.where("abs(r - (4 * x + 2.5)) > 1e-9").count() == 0


def test_layout_makes_the_graph_once(spark):
    nodes = spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("type"), F.least("id", F.lit(1)).cast("int").alias("level"))
    edges = spark.range(1, 60).select(F.lit("0").alias("src"), F.col("id").cast("string").alias("dst"))
    left, kept = layout.first_children(nodes, edges, 20)
    for df in (left, kept):
        assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert left.count() == 21 and kept.count() == 20
