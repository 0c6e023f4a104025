"""Exact quantiles, ranks and binary search against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuyere.functions import quantiles as module
from tuyere.functions.quantiles import evenly, how_many_up_to, quantiles
from tuyere.functions.special import normal_inverse, normal_share
from tuyere.operators import scale, stats

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_quantiles_of_groups(spark):
    rng = random.Random(1)
    groups = {f"g{n}": [float(rng.choice([rng.random(), rng.randrange(5), 7])) for _ in range(n)] for n in [*range(1, 14), 100, 999]}
    groups |= {"same": [3.0] * 40, "none": [None] * 3, None: [1.0, 2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("g5", None)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: (r.n, r.q) for r in quantiles(table, {"x": F.col("x")}, SHARES, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        known = [x for x in xs if x is not None]
        assert got[g][0] == len(known)
        assert got[g][1] == [None] * len(SHARES) if not known else np.allclose(got[g][1], np.quantile(known, SHARES), rtol=1e-12)


def test_quantiles_of_many_values(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.lognormal(0, 3, 60_000), np.full(30_000, 2.5), -rng.random(10_000)])
    table = spark.createDataFrame([(float(x), float(-x)) for x in values], "a double, b double")
    got = {r.name: r.q for r in quantiles(table, {"a": F.col("a"), "b": F.col("b")}, SHARES).collect()}
    assert np.allclose(got["a"], np.quantile(values, SHARES)) and np.allclose(got["b"], np.quantile(-values, SHARES))
    assert quantiles(table.where("false"), {"a": F.col("a")}, SHARES, ["b"]).count() == 0


def test_search_and_ranks(spark):
    bounds = [1, 3, 3, 8]
    table = spark.range(-1, 12).select("id", how_many_up_to(F.array(*map(F.lit, bounds)), F.col("id"), 4).alias("k"))
    assert all(r.k == sum(b <= r.id for b in bounds) for r in table.collect())
    rng = random.Random(3)
    values = [rng.choice([rng.randrange(40), rng.randrange(10_000)]) for _ in range(3000)]
    got = {r._v: r._rank for r in stats.ranks(spark.createDataFrame([(v,) for v in values], "x int"), "x", buckets=50).collect()}
    ordered = sorted(values)
    for v in set(values):
        first = ordered.index(v)
        assert got[v] == first + (values.count(v) + 1) / 2


def test_even_quantiles(spark):
    rng = random.Random(6)
    for n, points in ((2, 2), (7, 5), (50, 50), (400, 33), (1000, 1000)):
        values = [float(rng.choice([rng.randrange(5), rng.random()])) for _ in range(n)]
        got = {r.k: r.v for r in evenly(spark.createDataFrame([(v,) for v in values], "_v double"), n, points).collect()}
        assert sorted(got) == list(range(points))
        assert np.allclose([got[k] for k in range(points)], np.quantile(values, np.linspace(0, 1, points)), atol=1e-12)


def test_normal_functions():
    from statistics import NormalDist

    shares = [1e-7, 1e-4, 0.01, 0.2, 0.5, 0.77, 0.999, 1 - 1e-7]
    assert np.allclose(normal_inverse(np.array(shares)), [NormalDist().inv_cdf(p) for p in shares], atol=1e-8)
    xs = np.array([-6.0, -3.0, -1.2, 0.0, 0.5, 2.9, 4.0])
    assert np.allclose(normal_share(xs), [NormalDist().cdf(x) for x in xs], rtol=1e-9)


def test_quantile_scale_and_power_transform(spark):
    rng = np.random.default_rng(4)
    values = np.round(rng.lognormal(0, 1, 400), 1)
    table = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
    q = np.quantile(values, np.linspace(0, 1, 50))
    share = np.linspace(0, 1, 50)
    both = 0.5 * (np.interp(values, q, share) - np.interp(-values, -q[::-1], -share[::-1]))
    both = np.where(values == q[0], 0, np.where(values == q[-1], 1, both))
    got = sorted(r.scaled for r in scale.quantile_scale(table, "x", 50).collect() if r.x is not None)
    assert np.allclose(got, np.sort(both), atol=1e-9)
    normal = [r.scaled for r in scale.quantile_scale(table, "x", 50, "normal").collect()]
    assert normal.count(None) == 1 and max(x for x in normal if x is not None) < 5.2
    scaled = [r.scaled for r in scale.yeo_johnson(table, "x")[0].collect() if r.scaled is not None]
    assert abs(np.mean(scaled)) < 1e-9 and abs(np.std(scaled) - 1) < 1e-9


@pytest.mark.parametrize(("few", "rows_per_bucket"), [(1000, 20_000), (3, 200), (3, 20)])
def test_ranks_on_rows(spark, few, rows_per_bucket):
    """Average ranks with frequent values, in buckets of several values and of one."""
    rng = random.Random(12)
    rows = [(k, float(rng.choice((1, 1, 1, 2, 9))), round(rng.gauss(0, 1), 3), rng.choice((0.0, rng.random()))) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    got = {r.id: r for r in module.with_ranks(df, {"a": "ra", "b": "rb", "c": "rc"}, few, rows_per_bucket).collect()}
    assert len(got) == 900
    for j, name in ((1, "ra"), (2, "rb"), (3, "rc")):
        values = sorted(r[j] for r in rows)
        first, last = {}, {}
        for k, v in enumerate(values, 1):
            first.setdefault(v, k)
            last[v] = k
        assert all(got[r[0]][name] == (first[r[j]] + last[r[j]]) / 2 for r in rows)
