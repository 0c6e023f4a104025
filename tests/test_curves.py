"""Inversion counts, Kendall's tau and its p, locally weighted regression and splines against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest

from tuyere.catalogue import QUERIES
from tuyere.functions import frames
from tuyere.functions import inversions as counting
from tuyere.operators import concordance, smoothing
from tuyere.sources.testdata import gappy


def plain_inversions(rows):
    return sum(w * v for x, y, w in rows for a, b, v in rows if x < a and y > b)


@pytest.mark.parametrize("seed", range(4))
def test_weighted_inversions(seed):
    rng = random.Random(seed)
    ranks = np.array([rng.randrange(1 + 9 * seed) for _ in range(60)])
    weights = np.array([rng.randrange(1, 5) * (10**9 if seed == 3 else 1) for _ in range(60)])
    want = sum(int(weights[i]) * int(weights[j]) for i in range(60) for j in range(i + 1, 60) if ranks[i] > ranks[j])
    assert counting.weighted_inversions(ranks, weights) == want


@pytest.mark.parametrize("rows_per_bucket", [50_000, 30])
def test_inversions(spark, monkeypatch, rows_per_bucket):
    """Frequent values in either column, and buckets of few rows."""
    monkeypatch.setattr(counting, "ROWS", rows_per_bucket)
    rng = random.Random(8)
    values = [(rng.choice((0.0, round(rng.gauss(0, 3), 1))), rng.choice((5.0, round(rng.uniform(0, 9), 1)))) for _ in range(700)]
    rows = [(x, y, float(values.count((x, y)))) for x, y in sorted(set(values))]
    df = spark.createDataFrame([(x, y, int(w)) for x, y, w in rows], "x double, y double, w long").repartition(4)
    assert counting.inversions(df) == plain_inversions(rows)


def tau_b(pairs):
    s = tx = ty = 0
    for (x, y), (a, b) in itertools.combinations(pairs, 2):
        s += np.sign(x - a) * np.sign(y - b)
        tx += x == a
        ty += y == b
    n = len(pairs) * (len(pairs) - 1) / 2
    return s / math.sqrt((n - tx) * (n - ty)) if (n - tx) * (n - ty) else None


def test_kendall(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(12), rng.randrange(9)) for _ in range(150)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pairs] + [(None, 1.0), (1.0, math.nan)], "a double, b double")
    r = concordance.kendall(df, "a", "b").first()
    assert r.n == 150 and r.tau == pytest.approx(tau_b(pairs)) and 0 < r.p < 1
    # published: five orders of a sample without ties have an exact p of 2 * P(at most so many inversions)
    orders = list(itertools.permutations(range(5)))
    for order in ((0, 1, 2, 3, 4), (1, 0, 2, 4, 3), (3, 1, 4, 0, 2)):
        c = sum(a > b for a, b in itertools.combinations(order, 2))
        few = min(c, 10 - c)
        want = min(1, 2 * sum(sum(a > b for a, b in itertools.combinations(o, 2)) <= few for o in orders) / 120)
        r = concordance.kendall(spark.createDataFrame(list(enumerate(order)), "a int, b int"), "a", "b").first()
        assert r.tau == pytest.approx(1 - c / 5) and r.p == pytest.approx(want)
    same = concordance.kendall(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()
    assert (same.n, same.tau, same.p) == (2, None, None)
    assert concordance.kendall(df.where("false"), "a", "b").first().n == 0


def plain_lowess(x, y, share, rounds):
    k = int(share * len(x) + 1e-10)
    weight, at = np.ones(len(x)), np.array(sorted(set(x)))
    for r in range(rounds + 1):
        fit = []
        for a in at:
            d = np.abs(x - a)
            h = np.sort(d)[k - 1]
            u = np.where(d == 0, 0, d / h if h else 2.0)
            w = np.where(u < 1, (1 - np.minimum(u, 1) ** 3) ** 3, 0) * weight
            mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            var = (w * (x - mx) ** 2).sum()
            fit.append(my + ((w * (x - mx) * y).sum() / var * (a - mx) if var > 1e-12 else 0))
        off = np.abs(y - np.interp(x, at, fit))
        med = np.median(off)
        weight = (1 - np.minimum(off / (6 * med), 1) ** 2) ** 2
    return at, np.array(fit)


@pytest.mark.parametrize("ties", [False, True])
def test_lowess(spark, ties):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 150)
    x = np.round(x, 0 if ties else 6)
    y = np.sin(x) + rng.normal(size=150) * 0.2
    y[::25] += 8  # far off
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (math.nan, 1.0), (1.0, None)], "u double, v double").repartition(3)
    at, want = plain_lowess(x, y, 0.3, 3)
    got = {r.x: r.fitted for r in smoothing.lowess(df, "u", "v", 0.3, 3).collect()}
    assert sorted(got) == at.tolist() and np.allclose([got[a] for a in at], want, atol=1e-7)
    few = smoothing.lowess(df, "u", "v", 0.3, 3, points=20).collect()
    assert len(few) == min(20, len(at)) or ties
    assert smoothing.lowess(df.where("false"), "u", "v").count() == 0


def dense_spline(i, y, smoothing_by):
    """g and second derivatives from the whole matrices."""
    n, h = len(i), np.diff(i)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    c = np.linalg.solve(r + smoothing_by * q.T @ q, q.T @ y)
    return y - smoothing_by * q @ c, np.concatenate([[0], c, [0]])


@pytest.mark.parametrize("chunk", [2, 3, 7, 1000])
@pytest.mark.parametrize("smoothing_by", [0.0, 2.5])
def test_spline(spark, chunk, smoothing_by):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for s, n in (("a", 40), (None, 17), ("two", 9), ("one", 4), ("none", 3)):
        v = np.cumsum(rng.normal(size=n))
        known = rng.uniform(size=n) > 0.4 if s in ("a", None) else np.isin(np.arange(n), {"two": [2, 6], "one": [1], "none": []}[s])
        rows += [(s, 10 * k, k, float(v[k]) if known[k] else (None if k % 2 else math.nan)) for k in range(n)]
        at = np.flatnonzero(known).astype(float)
        if len(at) > 2:
            g, c = dense_spline(at, v[known], smoothing_by)
        else:
            g, c = v[known], np.zeros(len(at))
        for k in range(n):
            if known[k]:
                want[s, k] = v[k]
            elif len(at) == 0:
                want[s, k] = None
            elif len(at) == 1:
                want[s, k] = g[0]
            elif k < at[0] or k > at[-1]:
                e, f, sign = (0, 1, 1) if k < at[0] else (-1, -2, -1)
                h = abs(at[f] - at[e])
                slope = sign * (g[f] - g[e]) / h - sign * h / 6 * (2 * c[e] + c[f])
                want[s, k] = g[e] + (k - at[e]) * slope
            else:
                j = np.searchsorted(at, k) - 1
                h, u, w = at[j + 1] - at[j], k - at[j], at[j + 1] - k
                want[s, k] = (u * g[j + 1] + w * g[j]) / h - u * w / 6 * ((1 + u / h) * c[j + 1] + (1 + w / h) * c[j])
    df = spark.createDataFrame(rows, "series string, t long, id long, v double").repartition(3)
    got = {(r.series, r.id): r.filled for r in smoothing.fill_spline(df, smoothing_by, chunk).collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] is None if value is None else got[key] == pytest.approx(value, abs=1e-8), key


def test_impute_spline_runs_through_all_known_values(spark):
    """The query's gaps against the whole matrices of each series, which a cubic through four points does not meet."""
    sf, series = "/root/testdata/sf0.001", {}
    for r in gappy(spark, sf).orderBy("series", "t", "id").collect():
        series.setdefault(r.series, []).append((r.id, r.v))
    want = {}
    for rows in series.values():
        known = [k for k, (_, v) in enumerate(rows) if v is not None]
        at, y = np.array(known, float), np.array([rows[k][1] for k in known])
        c = dense_spline(at, y, 0.0)[1]
        for k, (row, v) in enumerate(rows):
            j = np.searchsorted(at, k)
            if v is None and 0 < j < len(at):
                h, s, e = at[j] - at[j - 1], k - at[j - 1], at[j] - k
                want[row] = (s * y[j] + e * y[j - 1]) / h - s * e / 6 * ((1 + s / h) * c[j] + (1 + e / h) * c[j - 1])
    got = {r.id: r.filled for r in QUERIES["impute_spline"](spark, sf).collect()}
    assert len(want) > 80 and len(got) == sum(map(len, series.values()))
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())


def test_banded_systems_in_blocks():
    """Blocks of every fill, with bands that reach beyond the system and do not count."""
    rng = np.random.default_rng(12)
    for n in (2, 7, 32, 33, 57, 200):
        band, right = rng.uniform(-1, 1, size=(n, 5)) + [0, 0, 6, 0, 0], rng.normal(size=(n, 3))
        whole = sum(np.diag(band[max(0, -k) : n - max(0, k), k + 2], k) for k in range(-2, 3) if abs(k) < n)
        before = band.copy()
        assert np.allclose(smoothing.solve_banded(band, right), np.linalg.solve(whole, right), atol=1e-12)
        assert (band == before).all()


def test_spline_cuts_a_series_once(spark, monkeypatch):
    """Buckets without a known value, or with one; rows are put in order once."""
    values = [(s, k, k, float(k % 5 + k * k) if k % m == 3 else None) for s, n, m in (("a", 400, 37), ("b", 90, 4), (None, 60, 50), ("d", 30, 99), ("e", 20, 21)) for k in range(n) if s != "e" or k != 3]
    table = spark.createDataFrame(values, "series string, t long, id long, v double").repartition(3)
    whole = {(r.series, r.id): r.filled for r in smoothing.fill_spline(table).collect()}
    cuts, cut_by = [], frames.bucketed
    monkeypatch.setattr(frames, "ROWS", 8)
    for module in (frames, smoothing):
        monkeypatch.setattr(module, "bucketed", lambda *a: cuts.append(a) or cut_by(*a), raising=False)
    cut = {(r.series, r.id): r.filled for r in smoothing.fill_spline(table, chunk=3).collect()}
    assert len(cuts) == 1 and len(cut) == len(values) and set(cut) == set(whole)
    assert all(v == pytest.approx(whole[k], abs=1e-6) if v is not None else whole[k] is None and k[0] == "e" for k, v in cut.items())
