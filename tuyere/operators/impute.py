"""Missing values: patterns, mechanisms and fills (C-03 to C-15). Input rows are (series, t, id, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import bucketed, chunked, clean, frame, neighbours, numbered, with_stats, without_nan
from tuyere.functions.quantiles import with_quantiles
from tuyere.functions.storage import stored

ORDER = ["t", "id"]
#: About so many rows of cut series are put in order by a task.
TASK_ROWS = 500_000


def _around(df: DataFrame, value: str) -> DataFrame:
    rows, many = bucketed(df, "series", "t")
    rows = numbered(rows, "series", "t", ORDER, many)
    return neighbours(rows, "series", "t", ORDER, F.col(value).isNotNull(), F.struct("_i", "t", F.col(value).alias("x")), many).drop("_b")


def fill_linear(df: DataFrame, value: str = "v", name: str = "filled", by_time: bool = False) -> DataFrame:
    """Linear in the row number (or in time), the ends filled with the nearest value."""
    df = clean(df, value)
    a, b, at = F.col("prev"), F.col("next"), "t" if by_time else "_i"
    line = a["x"] + (b["x"] - a["x"]) * F.coalesce(F.try_divide(F.col(at) - a[at], b[at] - a[at]), F.lit(0.0))
    rows = _around(df, value)
    return rows.withColumn(name, F.coalesce(value, line, a["x"], b["x"])).drop("prev", "next", "_i")


@without_nan("v")
def fill_nearest(df: DataFrame) -> DataFrame:
    """The nearer row's value (the earlier of equals); the ends stay null."""
    a, b, i = F.col("prev"), F.col("next"), F.col("_i")
    value = F.when(a.isNotNull() & b.isNotNull(), F.when(i - a["_i"] <= b["_i"] - i, a["x"]).otherwise(b["x"]))
    return _around(df, "v").withColumn("filled", F.coalesce("v", value)).drop("prev", "next", "_i")


@without_nan("v")
def fill_forward(df: DataFrame, limit: int | None = None) -> DataFrame:
    a = F.col("prev")
    value = a["x"] if limit is None else F.when(F.col("_i") - a["_i"] <= limit, a["x"])
    return _around(df, "v").withColumn("filled", value).drop("prev", "next", "_i")


@without_nan("v")
def fill_backward(df: DataFrame, limit: int | None = None) -> DataFrame:
    b = F.col("next")
    value = b["x"] if limit is None else F.when(b["_i"] - F.col("_i") <= limit, b["x"])
    return _around(df, "v").withColumn("filled", value).drop("prev", "next", "_i")


@without_nan("v")
def fill_smoothed(df: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Linear fill, then the centred mean of three over all points."""
    rows = chunked(fill_linear(df, name="_x"), "series", "t", ORDER, 1, 1, chunk)
    return rows.withColumn("filled", F.avg("_x").over(frame("series", 1, 1))).where("_home").drop("_x", "_i", "_c", "_home")


@without_nan("v")
def fill_cubic(df: DataFrame) -> DataFrame:
    """The cubic in the row number through two known values on either side; linear where one side has a single one, and the
    ends filled with the nearest value. It is local, so that no task needs a whole series: a series is cut and numbered once,
    and the two known values before and after a bucket come from a row per bucket."""
    rows, many = bucketed(df, "series", "t")
    rows = stored(rows, "cubic-buckets") if many else rows
    n = rows.count() if many else 0
    rows = numbered(rows, "series", "t", ORDER, many)
    if many:  # so many tasks as rows need: a partition's bytes, by which Spark would join them, are few
        rows = rows.repartition(-(-n // TASK_ROWS), "series", "_b")
    rows = rows.withColumn("_p", F.when(F.col("v").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("v").alias("x"))))
    within = Window.partitionBy("series", "_b") if many else Window.partitionBy("series")
    # near and far: the nearest known value at or before the row and the one before that (_a), or at or after it and the next (_q)
    sides = {"_a": within.orderBy("_i"), "_q": within.orderBy(F.desc("_i"))}
    for name, order in sides.items():
        rows = rows.withColumn("_far", F.last("_p", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        pair = F.when(F.col("_p").isNotNull(), F.struct(F.col("_p").alias("near"), F.col("_far").alias("far")))
        rows = rows.withColumn(name, F.last(pair, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.drop("_far", "_p")
    if many:
        rows = stored(rows, "cubic-rows")
        # the last row of a bucket sees its last two known values, the first row its first two
        ends = rows.groupBy(F.col("series").alias("_key"), F.col("_b").alias("_bucket")).agg(F.max_by("_a", "_i").alias("_a"), F.min_by("_q", "_i").alias("_q"))
        for name, first in (("_a", F.col("_bucket")), ("_q", F.desc("_bucket"))):
            others = Window.partitionBy("_key").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket, not per point
            far = F.coalesce(F.col(name)["far"], F.last(F.col(name)["near"], True).over(others))
            ends = ends.withColumn("_pair", F.when(F.col(name).isNotNull(), F.struct(F.col(name)["near"].alias("near"), far.alias("far"))))
            ends = ends.withColumn(f"_other{name}", F.last("_pair", True).over(others))
        ends = stored(ends.select("_key", "_bucket", "_other_a", "_other_q"), "cubic-ends")
        rows = rows.join(ends, F.col("series").eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")), "left")
        for name in sides:
            own, other = F.col(name), F.col(f"_other{name}")
            both = F.struct(own["near"].alias("near"), F.coalesce(own["far"], other["near"]).alias("far"))
            rows = rows.withColumn(name, F.when(own.isNull(), other).otherwise(both))
        rows = rows.drop("_key", "_bucket", "_other_a", "_other_q")
    p, q, at = F.col("_a")["near"], F.col("_q")["near"], F.col("_i")
    points = [F.col("_a")["far"], p, q, F.col("_q")["far"]]
    cubic = F.lit(0.0)
    for k, one in enumerate(points):
        term = one["x"]
        for j, other in enumerate(points):
            if j != k:
                term = term * F.try_divide(at - other["i"], one["i"] - other["i"])
        cubic = cubic + term
    line = p["x"] + (q["x"] - p["x"]) * F.try_divide(at - p["i"], q["i"] - p["i"])
    return rows.withColumn("filled", F.coalesce("v", cubic, line, p["x"], q["x"])).drop("_a", "_q", "_i", "_b")


@without_nan("v")
def fill_statistic(df: DataFrame, how: str = "mean") -> DataFrame:
    """The series' mean, median or mode (smallest of equals); the mean is also what a nearest-neighbour or chained-equation fill
    of one column comes to. Those of several columns are in impute_columns."""
    if how == "median":
        return with_quantiles(df, "series", F.col("v"), [0.5], "_q").withColumn("filled", F.coalesce("v", F.col("_q")[0])).drop("_q")
    stat = {"mean": F.avg("v"), "mode": F.mode("v", True), "knn": F.avg("v"), "mice": F.avg("v")}[how]
    return with_stats(df, "series", stat.alias("_x")).withColumn("filled", F.coalesce("v", "_x")).drop("_x")


def fill_spline(df: DataFrame) -> DataFrame:
    """The natural cubic spline through all known values of the series."""
    from tuyere.operators import smoothing  # which needs this module's order of rows

    return smoothing.fill_spline(df)


METHODS = {
    "linear": fill_linear,
    "time": lambda df: fill_linear(df, by_time=True),
    "nearest": fill_nearest,
    "ffill": fill_forward,
    "bfill": fill_backward,
    "kalman": fill_smoothed,
    "spline": fill_spline,
    "cubic": fill_cubic,
    **{k: (lambda df, k=k: fill_statistic(df, k)) for k in ("mean", "median", "mode", "knn", "mice")},
}


@without_nan("v")
def fill_by_priority(df: DataFrame, methods: tuple[str, ...] = ("linear", "time", "ffill", "bfill")) -> tuple[DataFrame, str]:
    """The first method that leaves fewer nulls, else the median; and its name. How many nulls a method leaves follows from one
    aggregation per series, so only the chosen method runs."""
    first, last = (F.min if k else F.max for k in (1, 0))
    place = F.struct(*ORDER)
    known = F.when(F.col("v").isNotNull(), place)
    ends = df.groupBy("series").agg(first(known).alias("a"), last(known).alias("b"))
    inside = (F.struct(*ORDER) > F.col("a")) & (F.struct(*ORDER) < F.col("b"))
    gaps = df.where("v is null").join(ends.withColumnRenamed("series", "_s"), F.col("series").eqNullSafe(F.col("_s")))
    counts = gaps.agg(
        F.count("*").alias("missing"), F.count_if(F.col("a").isNotNull()).alias("any"), F.count_if(inside).alias("inside"), F.count_if(place > F.col("a")).alias("after"), F.count_if(place < F.col("b")).alias("before")
    ).first()
    filled = {"nearest": counts.inside, "ffill": counts.after, "bfill": counts.before}  # all other methods fill wherever the series has a value
    for m in methods:
        if not counts.missing or filled.get(m, counts["any"]):
            return METHODS[m](df), m
    return METHODS["median"](df), "median"


@without_nan("v")
def fill_statistics(filled: DataFrame) -> DataFrame:
    """Of the filled places: count, rate, mean, deviation, least, largest."""
    x = F.when(F.col("v").isNull(), F.col("filled"))
    return filled.groupBy("series").agg(F.count(x).alias("n_filled"), (F.count(x) / F.count("*")).alias("rate"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("largest"))


def missing_pattern(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """pattern (a digit per column, 1 is missing), n: the first patterns in falling order of the bitmap."""
    df = clean(df, *columns)
    bitmap = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return df.groupBy(bitmap.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("pattern")).limit(most)


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_missing, rate: a row per column, in one pass."""
    df = clean(df, *columns)
    parts = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count("*").alias("n")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.column_name", "x.n_missing", F.try_divide("x.n_missing", "x.n").alias("rate"))


def missing_mechanism(df: DataFrame, column: str, others: list[str]) -> DataFrame:
    """mean_corr and mechanism: the mean absolute correlation of being missing here with being present elsewhere; below 0.1
    MCAR, below 0.3 MAR, else (also when it is undefined) MNAR."""
    df = clean(df, column, *others)
    y = F.col(column).isNull().cast("double")
    parts = []
    for c in others:
        x = F.col(c).isNotNull().cast("double")
        parts.append(F.abs(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))))
    total = reduce(lambda a, b: a + b, parts) / len(parts)
    r = df.agg(total.alias("mean_corr"))
    return r.select("mean_corr", F.when(F.col("mean_corr") < 0.1, "MCAR").when(F.col("mean_corr") < 0.3, "MAR").otherwise("MNAR").alias("mechanism"))
