"""Descriptive statistics, correlation and quality reports (C-01, C-38, C-40, E-01 to E-09, E-12, E-14)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import clean
from tuyere.functions.quantiles import cumulative, quantiles, with_ranks


def longer(df: DataFrame, columns: list[str]) -> DataFrame:
    return clean(df, *columns).select(F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """param, n, mean, std (sample), cv (percent, 0 for mean 0), skew and excess kurtosis (population), rounded to 4."""
    g = longer(df, columns).where("x is not null").groupBy("param")
    s = g.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.col("mean") * 100)
    return s.select("param", "n", *[F.round(c, 4).alias(n) for n, c in (("mean", F.col("mean")), ("std", F.col("std")), ("cv", cv), ("skew", F.col("skew")), ("kurt", F.col("kurt")))])


def interpret(described: DataFrame) -> DataFrame:
    """Labels of shape, and the rank by variation."""
    skew = F.when(F.col("skew") > 0.5, "right-skewed").when(F.col("skew") < -0.5, "left-skewed").otherwise("symmetric")
    kurt = F.when(F.col("kurt") > 1, "peaked").when(F.col("kurt") < -1, "flat").otherwise("normal")
    return described.select("param", skew.alias("skew_label"), kurt.alias("kurt_label"), F.row_number().over(Window.orderBy(F.desc("cv"), "param")).alias("cv_rank"))


def table_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    moments = longer(df, columns).groupBy("param").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("largest"),
    )
    q = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75]).select(F.col("name").alias("param"), F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))
    return moments.join(q, "param", "left")


def quality_report(df: DataFrame) -> DataFrame:
    """One row: rows, columns, repeated rows, missing cells and their share. Repeats are counted after grouping equal rows."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
    per_row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), nulls.alias("m")).groupBy("r").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    s = per_row.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_missing"))
    k = len(df.columns)
    return s.select("n_rows", F.lit(k).alias("n_columns"), "n_repeated", "n_missing", F.coalesce(F.try_divide("n_missing", F.col("n_rows") * k), F.lit(0.0)).alias("missing_rate"))


def column_types(df: DataFrame) -> DataFrame:
    """column_name, kind: numeric, categorical_numeric (less than 20 values), categorical (texts of which less than a twentieth
    differ), text, datetime or unknown. Distinct values are estimated for all columns in one aggregation, to two in a hundred,
    and counted only in those columns that seem to have few."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        text = kind == "string"
        number = F.expr(f"try_cast(`{name}` as double)") if text else F.lit(None).cast("double")
        parts.append(F.struct(F.lit("number" if numeric else "text" if text else "time" if kind.startswith(("timestamp", "date")) else "other").alias("k"), F.approx_count_distinct(c, 0.02).alias("u") if numeric or text else F.lit(0).cast("long").alias("u"), F.count("*").alias("n"), F.count_if(c.isNotNull() & number.isNull()).alias("bad")))
    found = dict(zip(df.columns, df.agg(F.array(*parts).alias("x")).first().x, strict=True))  # a row a column
    few = [c for c, r in found.items() if r.k in ("number", "text") and r.u < 40]
    exact = dict(zip(few, df.agg(*[F.countDistinct(F.col(f"`{c}`")).alias(f"u{k}") for k, c in enumerate(few)]).first(), strict=True)) if few else {}

    def kind_of(c: str) -> str:
        r, u = found[c], exact.get(c, found[c].u)
        if r.k == "number" or r.k == "text" and not r.bad:
            return "categorical_numeric" if u < 20 else "numeric"
        if r.k == "text":
            return "categorical" if r.n and u / r.n < 0.05 else "text"
        return "datetime" if r.k == "time" else "unknown"

    return df.sparkSession.createDataFrame([(c, kind_of(c)) for c in found], "column_name string, kind string")


def time_column(df: DataFrame) -> str | None:
    """The first column whose name holds time or date and whose values are all times; else the first of a time type."""
    kinds = [(c, k) for c, k in df.dtypes if k == "date" or k.startswith("timestamp")]
    named = [(c, k) for c, k in df.dtypes if "time" in c.lower() or "date" in c.lower()]
    texts = [c for c, k in named if k == "string"]
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.try_to_timestamp(F.col(f"`{c}`")).isNull()).alias(f"b{k}") for k, c in enumerate(texts)]).first() if texts else []
    wrong = {c for c, n in zip(texts, bad, strict=True) if n}
    fitting = [c for c, k in named if c not in wrong and (k in ("string", "tinyint", "smallint", "int", "bigint", "float", "double") or (c, k) in kinds)]
    return next(iter(fitting + [c for c, _ in kinds]), None)


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]


def pearson(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """a, b, n, r, t over rows complete in both; r is 0 for fewer than 3 rows and null for a constant; one aggregation."""
    df = clean(df, *columns, *([target] if target else []))
    pairs = [(c, target) for c in columns if c != target] if target else _pairs(columns)
    parts = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r")))
    e = df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return _with_t(e.withColumn("r", F.when(F.col("n") < 3, 0.0).otherwise(F.col("r"))))


def _with_t(e: DataFrame) -> DataFrame:
    return e.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def ranks(df: DataFrame, column: str, buckets: int = 1000) -> DataFrame:
    """_v, _rank: the average rank of each distinct value."""
    table = cumulative(df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")), buckets)
    return table.select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank"))


def rank_of(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the average rank."""
    return df.join(ranks(df, column).withColumnRenamed("_rank", name), F.col(column) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r, t: ranks within the rows complete in both columns, ties averaged. Columns without nulls are ranked once
    for all their pairs, which then take one aggregation; a column shuffles its rows once at most."""
    df = clean(df, *columns)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    full = [c for k, c in enumerate(columns) if not nulls[k]]
    parts = []

    def ranked(rows: DataFrame, columns: list[str]) -> DataFrame:
        named = rows.select(*[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(columns)])
        r = pearson(with_ranks(named, {f"_v{k}": f"_r{k}" for k in range(len(columns))}), [f"_r{k}" for k in range(len(columns))])
        names = F.create_map(*[F.lit(x) for k, c in enumerate(columns) for x in (f"_r{k}", c)])
        return r.select(names[F.col("a")].alias("a"), names[F.col("b")].alias("b"), "n", "r", "t")

    if len(full) > 1:
        parts.append(ranked(df, full))
    for a, b in _pairs(columns):
        if a not in full or b not in full:
            parts.append(ranked(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b]))
    return reduce(lambda p, q: p.unionByName(q), parts)


def top_pairs(corr: DataFrame, n: int = 10) -> DataFrame:
    return corr.orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def p_values(corr: DataFrame) -> DataFrame:
    """Two-sided p of t with n - 2 degrees of freedom."""
    from tuyere.functions.special import t_two_sided

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([1.0 if m < 3 or x != x else t_two_sided(x, m - 2) for x, m in zip(t, n, strict=True)])

    return corr.withColumn("p", p("t", "n")).withColumn("significant", F.col("p") < 0.05)


def network(corr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: name, size; edges: a, b, width, style) to be drawn."""
    long = corr.select("a", F.abs("r").alias("s")).unionByName(corr.select(F.col("b").alias("a"), F.abs("r").alias("s"))).groupBy("a").agg(F.avg("s").alias("s"))
    ends = long.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    nodes = long.crossJoin(F.broadcast(ends)).select(F.col("a").alias("name"), (300 + 700 * F.coalesce(F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).alias("size"))
    style = F.when(F.col("p") >= 0.05, "dashed").otherwise("solid") if "p" in corr.columns else F.lit("solid")
    return nodes, corr.select("a", "b", (0.5 + 8 * F.abs("r")).alias("width"), style.alias("style"))


def regression_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    df, e = clean(df, y, predicted), F.col(y) - F.col(predicted)
    return df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull()).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 1), n: equal widths between the least and the largest value."""
    df = clean(df, column)
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins) + 1
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
