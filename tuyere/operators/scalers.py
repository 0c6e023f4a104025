"""Scaling whose parameters are rows that can be stored, found again by exact name and method, and applied either way
(C-36, C-37).

Parameters are (name, method, values map<string,double>, points array<double>). Every method is an expression of one row's
value and its column's parameters, so applying them shuffles nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuyere.functions.frames import clean
from tuyere.functions.quantiles import evenly, how_many_up_to, quantiles
from tuyere.operators import scale
from tuyere.operators.stats import longer

METHODS = ("zscore", "minmax", "robust", "quantile", "yeo-johnson", "log")
SCHEMA = "name string, method string, values map<string,double>, points array<double>"
_LINEAR = {"zscore": "zscore_pop", "minmax": "minmax", "robust": "robust"}


def fit(df: DataFrame, columns: list[str], method: str, points: int = 1000, offset: float = 0.0) -> DataFrame:
    """A row per column. For logarithms the offset is added, or what makes the least value 1 where that is not above 0 then."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    df, spark = clean(df, *columns), df.sparkSession
    if method in _LINEAR:
        p = scale.parameters(df, columns, _LINEAR[method])
        return p.select("name", F.lit(method).alias("method"), F.create_map(F.lit("a"), F.coalesce("a", F.lit(0.0)), F.lit("b"), "b").alias("values"), F.lit(None).cast("array<double>").alias("points"))
    rows = []
    for c in columns:
        x, marks, values = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_v")), None, {}
        if method == "log":
            least = x.agg(F.min("_v")).first()[0]
            values = {"offset": offset if least is None or least + offset > 0 else 1.0 - least}
        elif method == "quantile":
            n = x.count()
            marks = [r.v for r in evenly(x, n, max(2, min(points, n))).orderBy("k").collect()] if n > 1 else [r._v for r in x.collect()]  # no more than points
        else:
            scaled, lam = scale.yeo_johnson(x, "_v", standardise=False)
            m = scaled.agg(F.avg("scaled"), F.stddev_pop("scaled")).first()
            values = {"lambda": lam, "a": m[0] or 0.0, "b": m[1] or 1.0}
        rows.append((c, method, {k: float(v) for k, v in values.items()}, marks))
    return spark.createDataFrame(rows, SCHEMA)


def save(parameters: DataFrame, path: str) -> None:
    parameters.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _forward(x: Column, method: str, v: dict, points: list | None) -> Column:
    if method == "log":
        return F.when(x.isNotNull(), F.log(F.greatest(x + v["offset"], F.lit(1e-300))))
    if method == "quantile":
        if len(points) < 2:
            return F.when(x.isNotNull(), 0.0)
        marks, last = F.array(*[F.lit(p) for p in points]), len(points) - 1
        shares = {p: (points.index(p), last - points[::-1].index(p)) for p in dict.fromkeys(points)}
        first, final = (F.array(*[F.lit(shares[p][k]) for p in points]) for k in (0, 1))
        at = how_many_up_to(marks, x, len(points))
        low, high = F.get(marks, at - 1), F.get(marks, at)
        ends = F.when(at == 0, 0.0).when(low == x, F.when(x <= points[0], 0.0).when(x >= points[-1], float(last)).otherwise((F.get(first, at - 1) + F.get(final, at - 1)) / 2)).when(high.isNull(), float(last))
        inside = F.get(final, at - 1) + (F.get(first, at) - F.get(final, at - 1)) * F.try_divide(x - low, high - low)
        return F.when(x.isNotNull(), ends.otherwise(inside) / last)
    if method == "yeo-johnson":
        lam = v["lambda"]
        up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-12 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
        low = F.greatest(-x, F.lit(0.0))
        down = -F.log1p(low) if abs(lam - 2) < 1e-12 else -(F.pow(low + 1, F.lit(2 - lam)) - 1) / (2 - lam)
        x = F.when(x.isNotNull(), F.when(x >= 0, up).otherwise(down))
    return (x - v["a"]) / v["b"]


def _back(x: Column, method: str, v: dict, points: list | None) -> Column:
    if method == "log":
        return F.exp(x) - v["offset"]
    if method == "quantile":
        if not points:
            return F.lit(None).cast("double")
        marks, last = F.array(*[F.lit(p) for p in points]), len(points) - 1
        place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * last
        at = F.floor(place).cast("int")
        low = F.get(marks, at)
        return F.when(x.isNotNull(), low + (F.coalesce(F.get(marks, at + 1), low) - low) * (place - at))
    x = x * v["b"] + v["a"]
    if method == "yeo-johnson":
        lam = v["lambda"]
        up = F.expm1(x) if abs(lam) < 1e-12 else F.pow(F.greatest(x * lam + 1, F.lit(0.0)), F.lit(1 / lam)) - 1
        down = 1 - F.exp(-x) if abs(lam - 2) < 1e-12 else 1 - F.pow(F.greatest(1 - (2 - lam) * x, F.lit(0.0)), F.lit(1 / (2 - lam)))
        return F.when(x.isNotNull(), F.when(x >= 0, up).otherwise(down))
    return x


def transform(df: DataFrame, parameters: DataFrame, columns: list[str], method: str, inverse: bool = False) -> DataFrame:
    """df with the columns scaled, or scaled back. Columns without parameters of exactly that name and method stay as they are."""
    known = {r.name: r for r in parameters.where((F.col("method") == method) & F.col("name").isin(columns)).collect()}  # a row a column
    f = _back if inverse else _forward
    df = clean(df, *columns)
    return df.withColumns({c: f(F.col(c).cast("double"), method, r.values, r.points) for c, r in known.items()})


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, mean, std, least, largest, median."""
    moments = longer(df, columns).groupBy("param").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("largest"))
    middle = quantiles(df, {c: F.col(c) for c in columns}, [0.5]).select(F.col("name").alias("param"), F.col("q")[0].alias("median"))
    return moments.join(middle, "param").withColumnRenamed("param", "name")


def normalise(df: DataFrame, columns: list[str], method: str = "zscore") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scaled table, its parameters, and the figures of each column before and after (stage, name, ...)."""
    parameters = fit(df, columns, method)
    scaled = transform(df, parameters, columns, method)
    figures = [summary(x, columns).select(F.lit(stage).alias("stage"), "*") for stage, x in (("before", df), ("after", scaled))]
    return scaled, parameters, figures[0].unionByName(figures[1])
