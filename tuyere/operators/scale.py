"""Scaling with stored parameters and exact inverses (C-30 to C-37), over whole columns or within groups.

Parameters are a DataFrame (name, a, b): scaled = (x - a) / b for all linear methods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.functions.frames import clean, with_groups
from tuyere.functions.quantiles import evenly, how_many_up_to, quantiles

LINEAR = ("zscore", "mad", "minmax", "robust", "iqr_q1")


def parameters(df: DataFrame, columns: list[str], method: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """A row per column. A width of 0 becomes 1 (for minmax: a constant goes to the lower bound)."""
    df = clean(df, *columns)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    g = long.groupBy("name")
    if method == "zscore":
        p = g.agg(F.avg("x").alias("a"), F.stddev_samp("x").alias("b"))
    elif method == "zscore_pop":
        p = g.agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("b"))
    elif method == "mad":
        centre = quantiles(df, {c: F.col(c) for c in columns}, [0.5]).select("name", F.col("q")[0].alias("a"))
        one = centre.groupBy().pivot("name", columns).agg(F.first("a")).select(*[F.col(f"`{c}`").alias(f"_a{k}") for k, c in enumerate(columns)])
        away = quantiles(df.crossJoin(F.broadcast(one)), {c: F.abs(F.col(c) - F.col(f"_a{k}")) for k, c in enumerate(columns)}, [0.5])  # one row
        p = centre.join(away.select("name", F.col("q")[0].alias("b")), "name")
    elif method == "minmax":
        p = g.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("b", (F.col("hi") - F.col("lo")) / (high - low))
        p = p.withColumn("b", F.when(F.col("b") == 0, 1.0).otherwise(F.col("b"))).select("name", (F.col("lo") - low * F.col("b")).alias("a"), "b")
    elif method in ("robust", "iqr_q1"):
        q = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
        p = q.select("name", F.col("q")[1 if method == "robust" else 0].alias("a"), (F.col("q")[2] - F.col("q")[0]).alias("b"))
    else:
        raise ValueError(f"unknown method {method}")
    return p.withColumn("b", F.when(F.coalesce(F.col("b"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("b")))


def _wide(p: DataFrame, columns: list[str]) -> DataFrame:
    return p.groupBy().pivot("name", columns).agg(F.first(F.struct("a", "b")))


def apply(df: DataFrame, p: DataFrame, columns: list[str], inverse: bool = False) -> DataFrame:
    """The columns scaled (or scaled back) in place; parameters are one row and are broadcast."""
    one = _wide(p, columns)
    one = one.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(columns)])
    rows = df.crossJoin(F.broadcast(one))
    for k, c in enumerate(columns):
        a, b = F.col(f"_{k}.a"), F.col(f"_{k}.b")
        rows = rows.withColumn(c, F.col(c) * b + a if inverse else (F.col(c) - a) / b)
    return rows.drop(*[f"_{k}" for k in range(len(columns))])


def log_scale(df: DataFrame, column: str, offset: float = 0.0) -> DataFrame:
    """ln(x + offset) if that is positive everywhere, else log1p of x clipped from below."""
    df = clean(df, column)
    bad = df.agg(F.coalesce(F.min(F.col(column) + offset) <= 0, F.lit(False)).alias("_bad"))
    x = F.col(column)
    return df.crossJoin(F.broadcast(bad)).withColumn(column, F.when(x.isNull(), None).when(F.col("_bad"), F.log1p(F.greatest(x, F.lit(-offset + 1e-10)))).otherwise(F.log(F.when(x + offset > 0, x + offset)))).drop("_bad")


def within_groups(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """z-scores within groups, from statistics that are aggregated before the shuffle."""
    df = clean(df, column)
    s = df.groupBy(*group).agg(F.avg(column).alias("_a"), F.stddev_samp(column).alias("_b"))
    return with_groups(df, s, group).withColumn("scaled", F.try_divide(F.col(column) - F.col("_a"), F.col("_b"))).drop("_a", "_b")


def quantile_scale(df: DataFrame, column: str, points: int = 1000, output: str = "uniform") -> DataFrame:
    """The share of the reference quantiles below a value, linear between two of them, or the normal quantile of that share.
    Where reference quantiles are equal, the mean of the lowest and the highest share of that value counts. A table of fewer
    rows than points has as many reference quantiles as rows."""
    df = clean(df, column)
    n = df.where(F.col(column).isNotNull()).count()
    if n < 2:
        return df.withColumn("scaled", F.when(F.col(column).isNotNull(), 0.0))
    points = max(2, min(points, n))
    ref = evenly(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v")), n, points)
    steps = ref.groupBy("v").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    steps = steps.agg(F.sort_array(F.collect_list(F.struct("v", "lo", "hi"))).alias("_s"))  # no more entries than points
    x, s = F.col(column).cast("double"), F.col("_s")
    at = how_many_up_to(s, x, points, lambda e: e["v"])
    rows = df.crossJoin(F.broadcast(steps)).withColumn("_at", F.when(x.isNotNull(), at))
    low, high = F.get(s, F.col("_at") - 1), F.get(s, F.col("_at"))
    on = low["v"] == x
    value = F.when(F.col("_at") == 0, 0.0).when(on & (F.col("_at") == 1), 0.0).when(high.isNull(), float(points - 1)).when(on, (low["lo"] + low["hi"]) / 2).otherwise(low["hi"] + (high["lo"] - low["hi"]) * F.try_divide(x - low["v"], high["v"] - low["v"]))
    rows = rows.withColumn("scaled", F.when(x.isNotNull(), value / (points - 1))).drop("_s", "_at")
    if output == "normal":
        inside = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col("scaled")))
        return rows.withColumn("scaled", normal_quantile(F.when(F.col("scaled").isNotNull(), inside)))
    return rows


def normal_quantile(p):
    """The standard normal quantile of a column of shares, vectorised in batches."""

    @F.pandas_udf("double")
    def inverse(x: pd.Series) -> pd.Series:
        from tuyere.functions.special import normal_inverse

        return pd.Series(normal_inverse(x.to_numpy(float)))

    return F.when(p.isNotNull(), inverse(p))


def yeo_johnson(df: DataFrame, column: str, steps: int = 40, standardise: bool = True) -> tuple[DataFrame, float]:
    """The transform with the likeliest lambda, found by golden-section search, standardised; every likelihood is one
    aggregation."""
    df, x = clean(df, column), F.col(column)

    def transformed(lam: float):
        up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-12 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
        low = F.greatest(-x, F.lit(0.0))
        down = -F.log1p(low) if abs(lam - 2) < 1e-12 else -(F.pow(low + 1, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x.isNotNull(), F.when(x >= 0, up).otherwise(down))  # greatest() passes over nulls

    def minus_likelihood(lam: float) -> float:
        import math

        var, jac, n = df.agg(F.var_pop(transformed(lam)), F.sum(F.signum(x) * F.log1p(F.abs(x))), F.count(x)).first()
        return float("inf") if not var else n / 2 * math.log(var) - (lam - 1) * jac

    a, b, g = -2.0, 4.0, (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = minus_likelihood(c), minus_likelihood(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = minus_likelihood(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = minus_likelihood(d)
        if b - a < 1e-4:
            break
    lam = (a + b) / 2
    scaled = df.withColumn("scaled", transformed(lam))
    if standardise:
        moments = scaled.agg(F.avg("scaled").alias("_m"), F.stddev_pop("scaled").alias("_s"))
        scaled = scaled.crossJoin(F.broadcast(moments)).withColumn("scaled", F.coalesce(F.try_divide(F.col("scaled") - F.col("_m"), F.col("_s")), F.col("scaled") - F.col("_m"))).drop("_m", "_s")
    return scaled, lam
