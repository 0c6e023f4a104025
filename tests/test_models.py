"""Models, attributions, task texts, attention and made tables against brute force and known values."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuyere.operators import attention, attribution, models, semantic
from tuyere.sources import synthetic


def test_shapiro_wilk_known_values():
    # published example: weights of eleven men
    w, p = models.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.001)
    assert models.shapiro_wilk(np.ones(10)) == (1.0, 1.0)
    random = np.random.default_rng(1)
    assert models.shapiro_wilk(random.normal(size=500))[1] > 0.05 > models.shapiro_wilk(random.exponential(size=500))[1]


def test_normality_and_distance(spark):
    random = np.random.default_rng(2)
    x = np.round(random.normal(size=3000), 2)
    df = spark.createDataFrame([(float(v), float(v * v)) for v in x] + [(None, float("nan"))], "a double, b double")
    d = {r.param: (r.n, r.d) for r in models.ks_distance(df, ["a", "b"]).collect()}
    for name, values in (("a", np.sort(x)), ("b", np.sort(x * x))):
        phi = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in values])
        k = np.arange(1, len(values) + 1) / len(values)
        last = {v: (a, p) for v, a, p in zip(values, k, phi)}
        first = {}
        for v, a in zip(values, k - 1 / len(values)):
            first.setdefault(v, a)
        want = max(max(abs(a - p), abs(p - first[v])) for v, (a, p) in last.items())
        assert d[name] == (len(values), pytest.approx(want))
    got = {r.param: r for r in models.normality(df, ["a", "b"], small=1000).collect()}
    assert got["a"].test == "ks" and got["a"].is_normal and not got["b"].is_normal
    assert {r.test for r in models.normality(df, ["a", "b"]).collect()} == {"shapiro"}


@pytest.mark.parametrize("method", [lambda d: models.isolation_forest(d, ["x", "y"], contamination=0.02), lambda d: models.linear_autoencoder(d, ["x", "y"], share=0.02)])
def test_planted_outliers(spark, method):
    random = np.random.default_rng(3)
    rows = [(k, float(a), float(a + 0.1 * b)) for k, (a, b) in enumerate(random.normal(size=(500, 2)))]
    rows += [(1000 + k, 4.0 + k / 10, -4.0 - k / 10) for k in range(5)] + [(2000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    flagged = {r.id for r in method(df).where("is_outlier").collect()}
    assert {1000 + k for k in range(5)} - flagged == set() and len(flagged) <= 12 and 2000 not in flagged
    assert method(df.limit(0)).count() == 0


def test_shapley_values(spark):
    random = np.random.default_rng(4)
    x = random.uniform(size=(300, 3))
    rows = [(k, *map(float, v), float(3 * v[0] + v[1] * v[0])) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    model = attribution.fit(df, names, "y", grid=((3,), (0.3,), (4,)))
    found = attribution.leaves(model)
    got = {r.id: r for r in attribution.explain(df, model, names).collect()}
    both = {r.id: np.array(r.phi).reshape(3, 3) for r in attribution.explain(df, model, names, pairs=True).collect()}

    def value(row, known):
        return sum(v * np.prod([float(lo < row[f] <= hi) if f in known else s for f, lo, hi, s in path] or [1.0]) for v, path in found)

    for k in (0, 7, 123):
        row, want = x[k], np.zeros(3)
        for j in range(3):
            rest = [f for f in range(3) if f != j]
            for size in range(3):
                for t in combinations(rest, size):
                    want[j] += math.factorial(size) * math.factorial(2 - size) / 6 * (value(row, {*t, j}) - value(row, set(t)))
        assert np.allclose(got[k].phi, want)
        assert got[k].base + sum(got[k].phi) == pytest.approx(model.predict(_vector(row)))
        assert np.allclose(both[k].sum(axis=1), want) and np.allclose(both[k], both[k].T)
    ranking = [r.feature for r in attribution.importance(attribution.explain(df, model, names), names).collect()]
    assert ranking[0] == "a"


def _vector(row):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(row)


def test_prepare(spark):
    df = spark.createDataFrame([(3, "u", 1.0, 1.0), (1, "v", None, 2.0), (2, None, 3.0, 3.0), (4, "v", 5.0, None)], "id long, k string, x double, y double")
    got = {r.id: (r.k, r.x) for r in attribution.prepare(df, ["k", "x"], "y").collect()}
    assert got == {3: (1.0, 1.0), 1: (0.0, 1.0), 2: (-1.0, 3.0)}


def test_attention(spark):
    nodes = spark.createDataFrame([("a", "root"), ("b", "pool"), ("c", "dataset")], "id string, type string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "b")], "src string, dst string")
    x = {r.id: np.array(r.x) for r in attention.features(nodes, edges.distinct()).collect()}
    assert list(x["c"]) == [0, 0, 0, 0, 1, 2 / 50, 0, 1]
    layer = attention.random_layer(8, outputs=3, heads=2)
    got = {r.id: np.array(r.x) for r in attention.attend(attention.features(nodes, edges.distinct()), edges, layer).collect()}
    into = {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"]}
    for node, sources in into.items():
        want = []
        for k in range(2):
            h = {n: layer["W"][k] @ v for n, v in x.items()}
            e = np.array([layer["src"][k] @ h[s] + layer["dst"][k] @ h[node] for s in sources])
            w = np.exp(np.where(e > 0, e, 0.2 * e))
            v = sum(a * h[s] for a, s in zip(w / w.sum(), sources))
            want.extend(np.where(v > 0, v, np.exp(v) - 1))
        assert np.allclose(got[node], want)


def test_parse_query_without_hits(spark):
    words = spark.createDataFrame([("pool", "p", "steam"), ("pool", "q", "")], "level string, name string, alias string")
    assert [tuple(r) for r in semantic.parse_query(words, "nothing").collect()] == [("keyword", "nothing")]
    assert sorted(tuple(r) for r in semantic.parse_query(words, "STEAM now").collect()) == [("keyword", "STEAM now"), ("pool", "p")]


def test_replies(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('x {"a": 2} y',), ("```json\n{\"a\": 3}\n```",), ("{broken",), (None,)], "r string")
    assert [r.parsed.a if r.parsed else None for r in semantic.parse_replies(df, "r", "a int").collect()] == [1, 2, 3, None, None]


def test_made_tables(spark):
    rows = synthetic.furnace(spark, 4000)
    assert len(rows.columns) == 17
    assert rows.agg(F.corr("风温", "热风温度")).first()[0] > 0.8 and abs(rows.agg(F.avg("风温")).first()[0] - 1500) < 5
    assert rows.repartition(7).exceptAll(synthetic.furnace(spark, 4000)).count() == 0
    p = synthetic.patterns(spark, 4000).agg(F.skewness("right_skewed"), F.skewness("left_skewed"), F.kurtosis("peaked"), F.kurtosis("flat")).first()
    assert p[0] > 1 and p[1] < -1 and p[2] > 0.5 and p[3] < -0.5
    nodes = spark.range(400).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    odd = synthetic.series(nodes, 100).where("is_anomaly")
    assert odd.agg(F.min("timestep")).first()[0] == 95 and 5 <= odd.select("id").distinct().count() <= 40
    known = synthetic.fake_rows(spark, [("id", "bigint"), ("status", "string")], 5)
    assert synthetic.fake_rows(spark, [("id", "bigint"), ("status", "string")], 8, known=known).count() == 8
    assert synthetic.fake_rows(spark, [("id", "bigint"), ("status", "string")], 8, known=known, overwrite=True).count() == 13
    assert [r.status for r in synthetic.scenario(spark.createDataFrame([("d",)], "dataset string"), "abnormal", 3).collect()] == ["anomaly"] * 3


def test_few_codes_are_broadcast(spark):
    from tuyere.operators import attribution

    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (9, None), (7, "c")], "id long, x string")
    got = attribution.factorize(df, "x", "id")
    assert {r.id: r.x for r in got.collect()} == {1: 0.0, 2: 1.0, 3: 1.0, 7: 2.0, 9: -1.0}
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString() and "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
