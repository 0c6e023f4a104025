"""Models over rows: isolation forest, linear autoencoder and normality tests (C-21, C-23, C-28).

Rows with a null in a used column take no part: they get no score and are no outliers."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.special import normal_quantile, normal_share
from tuyere.functions.storage import stored
from tuyere.operators.stats import longer

#: Digits of a percentile of scores: one part in so many rows.
ACCURACY = 10_000


def _complete(columns: list[str]):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])


def _above(df: DataFrame, score: str, share: float) -> DataFrame:
    """Adds is_outlier: whether the score is above the percentile that leaves this share."""
    limit = df.agg(F.percentile_approx(score, 1 - share, ACCURACY).alias("_limit"))
    return df.crossJoin(F.broadcast(limit)).withColumn("is_outlier", F.coalesce(F.col(score) > F.col("_limit"), F.lit(False))).drop("_limit")


def bounded_sample(df: DataFrame, id_col: str, columns: list[str], size: int, seed: int) -> np.ndarray:
    """About size rows (all, if there are no more), chosen by a hash of the id: the bound of what reaches the driver."""
    rows = df.where(_complete(columns)).select(F.xxhash64(F.lit(seed), id_col).alias("_h"), *[F.col(c).cast("double").alias(c) for c in columns])
    n = rows.count()
    if n > size:
        rows = rows.where(F.pmod("_h", F.lit(1 << 40)) < F.lit(int((1 << 40) * size / n)))
    got = rows.orderBy("_h").collect()
    return np.array([[r[c] for c in columns] for r in got], float).reshape(len(got), len(columns))


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n values: what a cut-off leaf adds, and the unit of scores."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, random: np.random.Generator, height: int) -> np.ndarray:
    """Rows (feature or -1, threshold, left, right, depth at a leaf)."""
    nodes: list[list[float]] = []

    def grow(part: np.ndarray, depth: int) -> int:
        place = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + path_length(len(part))])
        spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 and depth < height else []
        if len(spread):
            f = int(random.choice(spread))
            cut = random.uniform(part[:, f].min(), part[:, f].max())
            left = grow(part[part[:, f] <= cut], depth + 1)
            nodes[place] = [f, cut, left, grow(part[part[:, f] > cut], depth + 1), 0]
        return place

    grow(x, 0)
    return np.array(nodes)


def _steps(tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, next node, depth) of a tree's nodes; the next nodes of node k are at 2 k (right) and 2 k + 1 (left),
    and a leaf leads to itself, so that all rows take the same number of steps."""
    leaf, own = tree[:, 0] < 0, np.arange(len(tree))
    both = np.stack([np.where(leaf, own, tree[:, 3]), np.where(leaf, own, tree[:, 2])], axis=1)
    return np.where(leaf, 0, tree[:, 0]).astype(np.int64), np.where(leaf, np.inf, tree[:, 1]), both.ravel().astype(np.int64), tree[:, 4].copy()


def depths(forest: list[tuple[np.ndarray, ...]], height: int, rows: np.ndarray, block: int = 4096) -> np.ndarray:
    """The sum of the depths at which the trees, given by their steps and no higher than height, have the rows; in blocks that
    stay in a core's cache."""
    out = np.zeros(len(rows))
    for start in range(0, len(rows), block):
        part = np.ascontiguousarray(rows[start : start + block])
        values, base, total = part.ravel(), np.arange(len(part)) * part.shape[1], out[start : start + block]
        for feature, threshold, following, depth in forest:
            at = np.zeros(len(part), np.int64)
            for _ in range(height):
                left = values.take(base + feature.take(at)) <= threshold.take(at)
                at = following.take(2 * at + left)
            total += depth.take(at)
    return out


def isolation_forest(df: DataFrame, columns: list[str], *, id_col: str = "id", trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """df with iso_score (0 to 1; null if a column is null) and is_outlier, the share ``contamination`` of highest scores.
    Trees grow on bounded samples; every row is scored once, in its own partition, without a shuffle."""
    random = np.random.default_rng(seed)
    pool = bounded_sample(df, id_col, columns, trees * sample, seed)
    size = min(sample, len(pool))
    height = math.ceil(math.log2(max(size, 2)))
    forest = [_steps(grow_tree(pool[random.choice(len(pool), size, replace=False)], random, height)) for _ in range(trees)] if size else []
    unit = path_length(size) or 1.0

    @F.pandas_udf("double")
    def score(values: pd.DataFrame) -> pd.Series:
        x = values.to_numpy(float)
        known = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        if forest:
            out[known] = 2.0 ** (-depths(forest, height, x[known]) / len(forest) / unit)
        return pd.Series(out)

    got = df.withColumn("iso_score", F.nanvl(score(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])), F.lit(None).cast("double")))
    return _above(stored(got, "isolation"), "iso_score", contamination)


def linear_autoencoder(df: DataFrame, columns: list[str], *, width: int | None = None, share: float = 0.05) -> DataFrame:
    """df with error (mean squared difference of the standardised row and what ``width`` principal axes, half of the columns
    by default, keep of it) and is_outlier. Moments come from one aggregation, the error is a plain expression."""
    rows = df.where(_complete(columns))
    x = {c: F.col(c).cast("double") for c in columns}
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    got = rows.agg(*[F.avg(x[c]) for c in columns], *[F.covar_pop(x[a], x[b]) for a, b in pairs]).first()
    if got[0] is None:
        return df.withColumn("error", F.lit(None).cast("double")).withColumn("is_outlier", F.lit(False))
    d = len(columns)
    mean, cov = got[:d], np.zeros((d, d))
    for (a, b), v in zip(pairs, got[d:], strict=True):
        cov[columns.index(a), columns.index(b)] = cov[columns.index(b), columns.index(a)] = v
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd == 0] = 1.0
    _, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    lost = axes[:, : d - (width or max(1, d // 2))]  # the axes of least variance
    z = [(x[c] - F.lit(float(mean[k]))) / F.lit(float(sd[k])) for k, c in enumerate(columns)]
    parts = [reduce(lambda a, b: a + b, [F.lit(float(axis[k])) * z[k] for k in range(d)]) for axis in lost.T]
    error = reduce(lambda a, b: a + b, [p * p for p in parts], F.lit(0.0)) / d
    return _above(df.withColumn("error", F.when(_complete(columns), error)), "error", share)


# Fixed values of Royston's approximation (1995): the two end weights, and mean and deviation of the transformed W.
_END1 = (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157)
_END2 = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
_MEAN_SMALL, _SD_SMALL = (0.544, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
_MEAN_LARGE, _SD_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p) for 3 to 5000 values; (1, 1) if all are equal."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return 1.0, 1.0
    m = np.array([normal_quantile((k - 0.375) / (n + 0.25)) for k in range(1, n + 1)])
    u, total = 1 / math.sqrt(n), float(m @ m)
    a = m / math.sqrt(total)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        powers = u ** np.arange(5, 0, -1)
        last = a[-1] + float(np.dot(_END1, powers))
        if n > 5:
            second = a[-2] + float(np.dot(_END2, powers))
            scale = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(scale)
            a[1], a[-2] = -second, second
        else:
            a = m / math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[0], a[-1] = -last, last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, size = math.log(max(1 - w, 1e-300)), math.log(n)
    poly = lambda c, v: sum(k * v**p for p, k in enumerate(c))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y, mean, sd = -math.log(gamma - y), poly(_MEAN_SMALL, n), math.exp(poly(_SD_SMALL, n))
    else:
        mean, sd = poly(_MEAN_LARGE, size), math.exp(poly(_SD_LARGE, size))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def kolmogorov_p(d: float, n: int) -> float:
    """Asymptotic two-sided p of a Kolmogorov-Smirnov distance."""
    t = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * t) ** 2) for k in range(1, 101))))


def _ks_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov_p(a, b) for a, b in zip(d, n, strict=True)])


def ks_distance(df: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """param, n, d: the largest distance of each column's distribution from N(0, 1). Values are counted per distinct value
    and numbered within buckets of the normal distribution function, so no task orders a whole column."""

    @F.pandas_udf("double")
    def phi(x: pd.Series) -> pd.Series:
        return pd.Series(normal_share(x.to_numpy(float)))

    counts = longer(df, columns).where("x is not null and not isnan(x)").groupBy("param", "x").agg(F.count("*").alias("k")).withColumn("p", phi("x"))
    lo, hi = F.min("x").alias("lo"), F.max("x").alias("hi")
    counts = counts.join(F.broadcast(counts.groupBy("param").agg(lo, hi, F.sum("k").alias("n"))), "param")  # a row per column
    counts = counts.withColumn("b", F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * buckets))
    before = Window.partitionBy("param").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy("param", "b").agg(F.sum("k").alias("s")).select("param", "b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("o"))
    upto = F.sum("k").over(Window.partitionBy("param", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("c", upto).join(offsets, ["param", "b"]).withColumn("c", F.col("c") + F.col("o"))
    gap = F.greatest(F.abs(F.col("c") / F.col("n") - F.col("p")), F.abs(F.col("p") - (F.col("c") - F.col("k")) / F.col("n")))
    return rows.groupBy("param").agg(F.first("n").alias("n"), F.max(gap).alias("d"))


def normality(df: DataFrame, columns: list[str], small: int = 5000) -> DataFrame:
    """param, n, test, statistic, p, is_normal (p > 0.05): Shapiro-Wilk for fewer than ``small`` values, so that a group in a
    task is bounded, else Kolmogorov-Smirnov against N(0, 1). Columns with fewer than 3 values have null statistics."""
    sizes = df.agg(*[F.count(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in columns]).first()
    few, many = [c for c in columns if sizes[c] < small], [c for c in columns if sizes[c] >= small]
    schema, out = "param string, n long, test string, statistic double, p double", []

    def shapiro(group: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(group["x"].to_numpy()) if len(group) > 2 else (None, None)
        return pd.DataFrame({"param": [group["param"].iloc[0]], "n": [len(group)], "test": ["shapiro"], "statistic": [w], "p": [p]})

    if few:
        out.append(longer(df, few).where("x is not null and not isnan(x)").groupBy("param").applyInPandas(shapiro, schema))
    if many:
        p_of = F.pandas_udf(_ks_p, "double")
        out.append(ks_distance(df, many).select("param", "n", F.lit("ks").alias("test"), F.col("d").alias("statistic"), p_of("d", "n").alias("p")))
    return reduce(lambda a, b: a.unionByName(b), out).withColumn("is_normal", F.col("p") > 0.05)
