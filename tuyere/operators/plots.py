"""What charts of a table's figures show, as rows (E-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import clean
from tuyere.operators.stats import describe


def bars(df: DataFrame, columns: list[str]) -> DataFrame:
    """param, place (from 0, in the order of the columns), mean, std: two bars for each parameter."""
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("param")).cast("int") - 1
    return describe(df, columns).select("param", place.alias("place"), "mean", "std")


def by_variation(df: DataFrame, columns: list[str]) -> DataFrame:
    """param, place, cv, shade: from the steadiest to the most variable, shades in equal steps from 0.2 to 0.8."""
    order = Window.orderBy("cv", "param")  # a row a column
    rows = describe(df, columns).select("param", "cv", (F.row_number().over(order) - 1).alias("place"), F.count("*").over(Window.partitionBy()).alias("n"))
    return rows.select("param", "place", "cv", F.round(0.2 + 0.6 * F.coalesce(F.try_divide("place", F.col("n") - 1), F.lit(0.0)), 6).alias("shade"))


def shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """param, skew, kurt, cv, side: the points of the scatter, and on which side of its two lines they lie."""
    side = F.when(F.col("skew") > 0.5, "right").when(F.col("skew") < -0.5, "left").otherwise("middle")
    return describe(df, columns).select("param", "skew", "kurt", "cv", side.alias("side"))


def heat(df: DataFrame, columns: list[str], order: list[str], rows: int = 50) -> DataFrame:
    """row, param, z: the first rows in the given order, each value as a z-score of its column (sample deviation); null where
    the column is constant."""
    df = clean(df, *columns)
    moments = df.agg(*[f(F.col(c)).alias(f"_{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    first = df.orderBy(*order).limit(rows).withColumn("row", F.row_number().over(Window.orderBy(*order)) - 1)  # so many rows at most
    cells = [F.struct(F.lit(c).alias("param"), F.try_divide(F.col(c) - F.col(f"_m{k}"), F.col(f"_s{k}")).alias("z")) for k, c in enumerate(columns)]
    return first.crossJoin(F.broadcast(moments)).select("row", F.explode(F.array(*cells)).alias("c")).select("row", "c.*")
