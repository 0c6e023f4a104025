"""The exact neighbour search, what rests on it (local outlier factor, filling from nearest rows), and chained equations,
against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuyere.functions import nearest as search
from tuyere.operators import impute_columns, outliers


def points(seed=1):
    """Two spaces of clustered points, one of them with a dense heap, and a space of a few."""
    rng = np.random.default_rng(seed)
    out = []
    for space, n, dims in (("a", 700, 2), ("b", 300, 3), ("few", 3, 2)):
        x = rng.normal(size=(n, dims)) + rng.integers(0, 4, size=(n, 1)) * 5
        if space == "a":
            x[:250] = x[0] + rng.normal(size=(250, dims)) * 1e-3
        out += [(space, k, v.tolist()) for k, v in enumerate(x)]
    return out


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL", 40)
    monkeypatch.setattr(search, "BLOCK", 30)
    rows, k = points(), 5
    rng = np.random.default_rng(2)
    asks = rows + [("a", 1000 + j, v.tolist()) for j, v in enumerate(rng.normal(size=(40, 2)) * 20)] + [("none", 1, [0.0, 0.0]), ("few", 9, [50.0, 0.0])]
    p = spark.createDataFrame(rows, "space string, i long, x array<double>").repartition(4)
    q = spark.createDataFrame(asks, "space string, q long, x array<double>").repartition(3)
    got = {}
    for r in search.nearest(q, p, k).collect():
        got.setdefault((r.space, r.q), []).append((r.r, r.i, r.d))
    by_space = {s: [(i, np.array(x)) for t, i, x in rows if t == s] for s in ("a", "b", "few", "none")}
    for space, j, x in asks:
        want = sorted((math.dist(x, y), i) for i, y in by_space[space])[:k]
        mine = sorted(got.get((space, j), []))
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert np.allclose([d for _, _, d in mine], [d for d, _ in want], atol=1e-9)


def test_cells_are_ruled_out(spark, monkeypatch):
    """Queries visit a small share of the cells of a plane."""
    monkeypatch.setattr(search, "CELL", 20)
    rng = np.random.default_rng(3)
    rows = [("s", k, v.tolist()) for k, v in enumerate(rng.uniform(size=(4000, 2)))]
    p = spark.createDataFrame(rows, "space string, i long, x array<double>")
    cells = search._Cells(search._pick_pivots(p))
    figures = search._assigned(p, cells).groupBy("space", "cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect()
    cells = search._Cells(cells.pivots, {(r.space, r.cell): (r.n, r.least, r.most) for r in figures})
    assert 150 <= len(cells.pivots["s"]) <= 200
    visits = search._visits(p.select("space", F.col("i").alias("q"), "x", F.lit(0.02).alias("bound")), cells, 5, False)
    assert visits.count() < 4000 * 8


def test_local_outlier_factor(spark):
    """Against a plain version by rows, with copies and a row without a vector."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(120, 2)), [[9.0, 9.0], [9.1, 9.0]]])
    x = np.concatenate([x, x[[3] * 40], x[[7] * 2]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (1000, None), (1001, [1.0]), (1002, [None, 1.0])], "id long, v array<double>")
    k = 6
    least = {tuple(v): i for i, v in reversed(rows)}
    near = {}
    for i, v in rows:
        near[i] = sorted((math.dist(v, w), least[tuple(w)], j) for j, w in rows if j != i)[:k]
    kd = {i: n[-1][0] for i, n in near.items()}
    lrd = {i: 1 / (np.mean([max(d, kd[j]) for d, _, j in n]) + 1e-10) for i, n in near.items()}
    want = {i: np.mean([lrd[j] for _, _, j in n]) / lrd[i] for i, n in near.items()}
    got = {r.id: r.lof for r in outliers.local_outlier_factor(df, "id", "v", k).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)
    flagged = outliers.lof_outliers(df, "id", "v", k, 0.05).where("is_outlier").collect()
    assert {120, 121} <= {r.id for r in flagged} and len(flagged) <= 0.05 * len(rows) + 1


def test_local_outlier_factor_of_copies_and_nothing(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(30)], "id long, v array<double>")
    assert {r.lof for r in outliers.local_outlier_factor(same, "id", "v", 5).collect()} == {1.0}
    assert outliers.local_outlier_factor(same.where("false"), "id", "v", 5).count() == 0


def gappy(n=300, seed=4):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    x = np.column_stack([a, 2 * a - b + 0.3 * rng.normal(size=n), b, a + b + 0.3 * rng.normal(size=n)])
    known = rng.uniform(size=x.shape) > 0.15
    known[5] = False  # a row without any value
    known[6] = [True, False, True, False]
    x[10:40], known[10:40] = x[10], known[6]  # copies with gaps
    x[50:80], known[50:80] = x[50], True  # copies without
    return x, known


def frame(spark, x, known):
    return spark.createDataFrame([(k, *[float(v) if ok else (None if (k + j) % 2 else math.nan) for j, (v, ok) in enumerate(zip(row, here, strict=True))], "t") for k, (row, here) in enumerate(zip(x, known, strict=True))], "id long, a double, b double, c double, d double, note string")


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_fill_from_nearest(spark, weights):
    x, known = gappy()
    got = impute_columns.fill_from_nearest(frame(spark, x, known), "id", ["a", "b", "c", "d"], 5, weights).collect()
    assert len(got) == len(x) and all(r.note == "t" for r in got)
    for r in got:
        for c in range(4):
            k = r.id
            if known[k, c]:
                assert r[c + 1] == x[k, c]
                continue
            near = []
            for j in range(len(x)):
                both = known[k] & known[j]
                if known[j, c] and both.any() and j != k:
                    near.append((math.sqrt(4 / both.sum() * ((x[k] - x[j])[both] ** 2).sum()), j))
            near = sorted(near)[:5]
            if not near:
                want = x[known[:, c], c].mean()
            elif weights == "uniform":
                want = np.mean([x[j, c] for _, j in near])
            else:
                w = [float(d == 0) for d, _ in near] if near[0][0] == 0 else [1 / d for d, _ in near]
                want = np.average([x[j, c] for _, j in near], weights=w)
            assert r[c + 1] == pytest.approx(want, abs=1e-9), (k, c)


def test_fill_from_nearest_without_gaps_or_rows(spark):
    x, known = gappy(100)
    whole = frame(spark, x, known | True)
    assert impute_columns.fill_from_nearest(whole, "id", ["a", "b"]).exceptAll(whole).count() == 0
    assert impute_columns.fill_from_nearest(whole.where("false"), "id", ["a", "b"]).count() == 0


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_chained_equations(spark, estimator):
    """Planted relations are recovered better than by the mean; known values and rows stay."""
    x, known = gappy()
    names = ["a", "b", "c", "d"]
    df = frame(spark, x, known)
    got, changes = impute_columns.fill_by_equations(df, "id", names, rounds=12 if estimator == "linear" else 2, estimator=estimator, trees=10)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == len(x) and got.columns == df.columns
    filled, mean = 0.0, 0.0
    for k in range(len(x)):
        for c in range(4):
            if known[k, c]:
                assert rows[k][c + 1] == x[k, c]
            elif known[k].sum() >= 2:
                filled += (rows[k][c + 1] - x[k, c]) ** 2
                mean += (x[known[:, c], c].mean() - x[k, c]) ** 2
    assert filled < (0.3 if estimator == "linear" else 0.6) * mean, (filled, mean)
    assert changes[-1] < changes[0]


def test_chained_equations_stop(spark):
    """Gaps in one column have nothing to wait for: the second round moves nothing, and is the last."""
    df = spark.createDataFrame([(k, float(k), None if k % 3 == 0 else 2.0 * k + 1) for k in range(30)], "id long, a double, b double")
    got, changes = impute_columns.fill_by_equations(df, "id", ["a", "b"], estimator="linear")
    assert len(changes) == 2 and changes[1] < 1e-9
    assert all(r.b == pytest.approx(2 * r.a + 1) for r in got.collect())


def test_chained_equations_without_relations(spark):
    """One column, or no known value: the mean, or nothing."""
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, None)], "id long, a double, b double")
    got, changes = impute_columns.fill_by_equations(df, "id", ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, None), (2, 2.0, None), (3, 3.0, None)] and changes == []
    assert impute_columns.fill_by_equations(df.where("false"), "id", ["a", "b"])[0].count() == 0


def test_closest_of_a_block_is_exact():
    """Against sorting all distances: ties by rank, values far from zero, bounds, fewer points than asked for."""
    rng = np.random.default_rng(8)
    for dims, far, k in ((1, 0.0, 3), (2, 1e7, 5), (64, 0.0, 11), (64, 1e4, 11), (3, 0.0, 500)):
        y = np.round(rng.normal(size=(300, dims)) * 3) + far
        x = np.concatenate([y[:40], np.round(rng.normal(size=(40, dims)) * 3) + far])
        rank, bound = rng.permutation(300), np.where(np.arange(80) % 3, np.inf, dims**0.5)
        d = search._distances(x, y)
        want = [(j, c, d[j, c]) for j in range(80) for c in sorted(range(300), key=lambda c: (d[j, c], rank[c]))[:k] if d[j, c] <= bound[j]]
        got = list(zip(*search._closest(x, y, rank, bound, k), strict=True))
        assert [v[:2] for v in got] == [v[:2] for v in want] and np.allclose([v[2] for v in got], [v[2] for v in want], rtol=1e-15)


def test_queries_are_copied_by_groups_of_cells(spark, monkeypatch):
    """In many dimensions a query visits most cells: it is stored once and goes to a few groups, whose blocks may be empty."""
    monkeypatch.setattr(search, "CELL", 20)
    monkeypatch.setattr(search, "FEW", 3)
    rows = {}

    def counted(df, name):
        rows[name] = stored(df, name)
        return rows[name]

    stored = search.stored
    monkeypatch.setattr(search, "stored", counted)
    x = np.random.default_rng(9).normal(size=(800, 24)).astype(np.float32)
    points = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)], "space string, i long, x array<float>")
    got = {}
    for r in search.nearest(points.withColumnRenamed("i", "q"), points, 5).orderBy("q", "r").collect():
        got.setdefault(r.q, []).append(r.i)
    d = search._distances(x.astype(float), x.astype(float))
    assert all(got[q] == np.lexsort((np.arange(800), d[q]))[:5].tolist() for q in range(800))
    visits = rows["nearest-visits"]
    assert visits.count() <= 800 and visits.schema["x"].dataType.simpleString() == "array<float>"
    copies = visits.select(F.explode("visits").alias("v")).select("v.*").collect()
    cells = sum(bin(b).count("1") for r in copies for b in r.cells)
    assert len(copies) <= 12 * 800 and cells > 25 * 800


def test_lof_outliers_in_many_dimensions(spark, monkeypatch):
    """Flags of a plain version, from several groups of cells, with each vector stored once for the cells it visits."""
    monkeypatch.setattr(search, "CELL", 20)
    monkeypatch.setattr(search, "FEW", 3)
    counts, stored = {}, search.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(search, "stored", counted)
    n, k = 400, 10
    x = np.random.default_rng(10).normal(size=(n, 16)).astype(np.float32)
    x[7] *= 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = {r.id: r.is_outlier for r in outliers.lof_outliers(df, "id", "v", k, 0.05).collect()}
    d = search._distances(x.astype(float), x.astype(float))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(far, far[:, -1][near]).mean(1) + 1e-10)
    lof = density[near].mean(1) / density
    assert got == dict(enumerate((lof > np.quantile(lof, 0.95)).tolist())) and got[7]
    assert counts["nearest-home"] == n and counts["nearest-visits"] <= n
