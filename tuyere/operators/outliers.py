"""Outlier flags, votes, replacement and statistics over series (C-16 to C-29).

Input rows are (series, t, id, v); a null value is never an outlier. Row windows are in the order of (t, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import centred, chunked, frame, with_stats, without_nan
from tuyere.functions.nearest import nearest
from tuyere.functions.quantiles import quantiles, with_quantiles
from tuyere.functions.storage import stored

ORDER = ["t", "id"]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _beyond(low: Column, high: Column, factor: float) -> Column:
    return (F.col("v") < low - factor * (high - low)) | (F.col("v") > high + factor * (high - low))


@without_nan("v")
def zscore(df: DataFrame, threshold: float = 3.0, name: str = "is_outlier") -> DataFrame:
    rows = with_stats(df, "series", F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return rows.withColumn(name, _flag(F.try_divide(F.abs(F.col("v") - F.col("_m")), F.col("_s")) > threshold)).drop("_m", "_s")


@without_nan("v")
def iqr(df: DataFrame, factor: float = 1.5, name: str = "is_outlier") -> DataFrame:
    rows = with_quantiles(df, "series", F.col("v"), [0.25, 0.75], "_q")
    return rows.withColumn(name, _flag(_beyond(F.col("_q")[0], F.col("_q")[1], factor))).drop("_q")


def with_rolling_median(rows: DataFrame, value: Column, window, name: str) -> DataFrame:
    """Adds the median of the values in a window of few rows; nulls do not count."""
    rows = rows.withColumn(name, F.collect_list(value).over(window)).withColumn(name, F.sort_array(name))
    return rows.withColumn(name, F.expr(f"(get({name}, (size({name}) - 1) div 2) + get({name}, size({name}) div 2)) / 2"))


def _rolling_mad(rows: DataFrame, before: int, after: int, factor: float, name: str) -> DataFrame:
    w = frame("series", before, after)
    rows = with_rolling_median(rows, F.col("v"), w, "_d").withColumn("_d", F.abs(F.col("v") - F.col("_d")))
    rows = with_rolling_median(rows, F.col("_d"), w, "_dd")
    return rows.withColumn(name, _flag(F.col("_d") > factor * F.col("_dd"))).drop("_d", "_dd")


@without_nan("v")
def rolling_mad(df: DataFrame, window: int = 10, factor: float = 3.0, name: str = "is_outlier", chunk: int = 100_000) -> DataFrame:
    """Deviation from the centred rolling median, against the rolling median of such deviations."""
    before, after = centred(window)
    rows = _rolling_mad(chunked(df, "series", "t", ORDER, 2 * before, 2 * after, chunk), before, after, factor, name)
    return rows.where("_home").drop("_i", "_c", "_home")


def _moving_average(rows: DataFrame, before: int, after: int, factor: float, name: str) -> DataFrame:
    w = frame("series", before, after)
    return rows.withColumn(name, _flag(F.abs(F.col("v") - F.avg("v").over(w)) > factor * F.stddev_samp("v").over(w)))


@without_nan("v")
def moving_average(df: DataFrame, window: int = 10, factor: float = 3.0, name: str = "is_outlier", chunk: int = 100_000) -> DataFrame:
    before, after = centred(window)
    rows = _moving_average(chunked(df, "series", "t", ORDER, before, after, chunk), before, after, factor, name)
    return rows.where("_home").drop("_i", "_c", "_home")


@without_nan("v")
def exponential(df: DataFrame, alpha: float = 0.3, window: int = 10, factor: float = 3.0, reach: int = 120, name: str = "is_outlier", chunk: int = 100_000) -> DataFrame:
    """Residual from the adjusted exponentially weighted mean, against its centred rolling mean. Weights beyond ``reach``
    rows are below (1 - alpha) ** reach, less than a double's precision, so a halo of that many rows is exact."""
    before, after = centred(window)
    rows = _exponential(chunked(df, "series", "t", ORDER, reach + before, after, chunk), alpha, before, after, factor, reach, name)
    return rows.where("_home").drop("_i", "_c", "_home")


def _exponential(rows: DataFrame, alpha: float, before: int, after: int, factor: float, reach: int, name: str) -> DataFrame:
    past = F.collect_list(F.coalesce("v", F.lit(float("nan")))).over(frame("series", reach, 0))
    state = F.aggregate(
        past,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")),
        lambda s, x: F.struct((s["n"] * (1 - alpha) + F.nanvl(x, F.lit(0.0))).alias("n"), (s["d"] * (1 - alpha) + F.when(F.isnan(x), 0.0).otherwise(1.0)).alias("d")),
        lambda s: F.try_divide(s["n"], s["d"]),
    )
    rows = rows.withColumn("_r", F.abs(F.col("v") - state))
    return rows.withColumn(name, _flag(F.col("_r") > factor * F.avg("_r").over(frame("series", before, after)))).drop("_r")


METHODS = {"zscore": zscore, "iqr": iqr, "rolling_mad": rolling_mad, "moving_average": moving_average, "exponential": exponential}


@without_nan("v")
def ensemble(df: DataFrame, methods: tuple[str, ...] = ("zscore", "iqr", "rolling_mad", "moving_average"), window: int = 10, reach: int = 120, chunk: int = 100_000) -> DataFrame:
    """votes, and is_outlier where more than half of the methods agree. The rows are numbered and dealt to chunks once; all
    row windows share that order, and the series' statistics are joined to it."""
    before, after = centred(window)
    halo = max([2 * before if "rolling_mad" in methods else 0, before if "moving_average" in methods else 0, reach + before if "exponential" in methods else 0])
    rows = chunked(df, "series", "t", ORDER, halo, 2 * after, chunk) if halo else df
    if "zscore" in methods:
        stats = df.groupBy(F.col("series").alias("_z")).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
        rows = rows.join(stats, F.col("series").eqNullSafe(F.col("_z")), "left").drop("_z")
    if "iqr" in methods:
        q = quantiles(df, {"v": F.col("v")}, [0.25, 0.75], ["series"]).select(F.col("series").alias("_z"), F.col("q").alias("_q"))
        rows = rows.join(q, F.col("series").eqNullSafe(F.col("_z")), "left").drop("_z")
    for m in methods:
        if m == "zscore":
            rows = rows.withColumn("_zscore", _flag(F.try_divide(F.abs(F.col("v") - F.col("_m")), F.col("_s")) > 3.0))
        elif m == "iqr":
            rows = rows.withColumn("_iqr", _flag(_beyond(F.col("_q")[0], F.col("_q")[1], 1.5)))
        elif m == "rolling_mad":
            rows = _rolling_mad(rows, before, after, 3.0, "_rolling_mad")
        elif m == "moving_average":
            rows = _moving_average(rows, before, after, 3.0, "_moving_average")
        else:
            rows = _exponential(rows, 0.3, before, after, 3.0, reach, "_exponential")
    if halo:
        rows = rows.where("_home").drop("_i", "_c", "_home")
    votes = reduce(lambda a, b: a + b, [F.col(f"_{m}").cast("int") for m in methods])
    return rows.withColumn("votes", votes).withColumn("is_outlier", F.col("votes") > len(methods) / 2).drop("_m", "_s", "_q", *[f"_{m}" for m in methods])


@without_nan("v")
def replace(flagged: DataFrame, how: str = "median", chunk: int = 100_000) -> DataFrame:
    """Adds fixed: the value, or for outliers the inliers' median or mean, the line between the inliers around, the centred
    rolling median of 5 inliers, or the value clipped to the series' quartile fences."""
    inlier = F.when(~F.col("is_outlier"), F.col("v"))
    if how in ("median", "mean"):
        if how == "median":
            rows = with_quantiles(flagged, "series", inlier, [0.5], "_q").withColumn("_x", F.col("_q")[0]).drop("_q")
        else:
            rows = with_stats(flagged, "series", F.avg(inlier).alias("_x"))
        return rows.withColumn("fixed", F.when(F.col("is_outlier"), F.col("_x")).otherwise(F.col("v"))).drop("_x")
    if how == "clip":
        rows = with_quantiles(flagged, "series", F.col("v"), [0.25, 0.75], "_q")
        low, high = F.col("_q")[0], F.col("_q")[1]
        clipped = F.greatest(F.least(F.col("v"), high + 1.5 * (high - low)), low - 1.5 * (high - low))
        return rows.withColumn("fixed", F.when(F.col("is_outlier"), clipped).otherwise(F.col("v"))).drop("_q")
    if how == "rolling_median":
        rows = chunked(flagged, "series", "t", ORDER, 2, 2, chunk)
        rows = with_rolling_median(rows, inlier, frame("series", 2, 2), "_x").where("_home")
        return rows.withColumn("fixed", F.when(F.col("is_outlier"), F.col("_x")).otherwise(F.col("v"))).drop("_x", "_i", "_c", "_home")
    if how == "interpolation":
        from tuyere.operators.impute import fill_linear

        return fill_linear(flagged.withColumn("_v", inlier), "_v", "_x").withColumn("fixed", F.when(F.col("is_outlier"), F.col("_x")).otherwise(F.col("v"))).drop("_v", "_x")
    raise ValueError(f"unknown replacement {how}")


@without_nan("v")
def statistics(flagged: DataFrame) -> DataFrame:
    """Per series: counts, rate, and mean, deviation, least and largest value of outliers and of the others."""
    aggs = [F.count("*").alias("n"), F.count_if("is_outlier").alias("n_outliers"), F.avg(F.col("is_outlier").cast("double")).alias("rate")]
    for label, c in (("out", F.when(F.col("is_outlier"), F.col("v"))), ("in", F.when(~F.col("is_outlier"), F.col("v")))):
        aggs += [F.avg(c).alias(f"{label}_mean"), F.stddev_samp(c).alias(f"{label}_std"), F.min(c).alias(f"{label}_min"), F.max(c).alias(f"{label}_max")]
    return flagged.groupBy("series").agg(*aggs)


@without_nan("v")
def rolling(df: DataFrame, window: int = 5, chunk: int = 100_000) -> DataFrame:
    """Centred rolling mean, deviation and median, null where the window is not full of values."""
    before, after = centred(window)
    rows, w = chunked(df, "series", "t", ORDER, before, after, chunk), frame("series", before, after)
    full = F.count("v").over(w) == window
    for name, c in (("roll_mean", F.avg("v")), ("roll_std", F.stddev_samp("v"))):
        rows = rows.withColumn(name, F.when(full, c.over(w)))
    rows = with_rolling_median(rows.withColumn("_full", full), F.col("v"), w, "roll_median").withColumn("roll_median", F.when(F.col("_full"), F.col("roll_median"))).drop("_full")
    return rows.where("_home").drop("_i", "_c", "_home")


def local_outlier_factor(df: DataFrame, id_col: str, vector_col: str, k: int = 20) -> DataFrame:
    """id, lof: exact, over all rows with a vector. Equal vectors are one point that counts as often as it occurs, so a large
    group of copies is compared once; nearest points come from cells around pivots (functions/nearest.py). Of points at one
    distance those with the smaller least id are nearer. Rows whose vector holds a null or is not as long as most go without."""
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats take half the room
    rows = df.select(F.col(id_col).alias("i"), F.col(vector_col).cast(kind).alias("x")).where("x is not null and not exists(x, v -> v is null or isnan(v))")
    rows = stored(rows, "lof-rows")
    length = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    rows = rows.where(F.size("x") == (length.n if length else 0))
    points = stored(rows.groupBy("x").agg(F.min("i").alias("i"), F.count("*").alias("w")), "lof-points")
    where = points.select(F.lit("all").alias("space"), "i", "x")
    others = nearest(where.withColumnRenamed("i", "q"), where, k + 1).where("q <> i").select("q", "i", "d")
    counted = others.join(points.select("i", "w"), "i").unionByName(points.where("w > 1").select(F.col("i").alias("q"), "i", F.lit(0.0).alias("d"), (F.col("w") - 1).alias("w")))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("q").orderBy("d", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = stored(counted.withColumn("m", F.least("w", k - before)).where("m > 0").select("q", "i", "d", "m"), "lof-near")  # no more than k a point
    reach = near.join(near.groupBy(F.col("q").alias("i")).agg(F.max("d").alias("kd")), "i")
    density = stored(reach.groupBy("q").agg((1 / (F.sum(F.col("m") * F.greatest("d", "kd")) / F.sum("m") + 1e-10)).alias("lrd")), "lof-density")
    mean = near.join(density.select(F.col("q").alias("i"), F.col("lrd").alias("other")), "i").groupBy("q").agg((F.sum(F.col("m") * F.col("other")) / F.sum("m")).alias("o"))
    scores = mean.join(density, "q").join(points.select(F.col("i").alias("q"), "x"), "q").select("x", (F.col("o") / F.col("lrd")).alias("lof"))
    return rows.join(scores, "x").select(F.col("i").alias(id_col), "lof")


def lof_outliers(df: DataFrame, id_col: str, vector_col: str, k: int = 20, contamination: float = 0.05) -> DataFrame:
    """id, lof, is_outlier: the given share with the largest factors."""
    rows = stored(local_outlier_factor(df, id_col, vector_col, k), "lof")
    return rows.crossJoin(F.broadcast(quantiles(rows, {"lof": F.col("lof")}, [1 - contamination]).select(F.col("q")[0].alias("_q")))).withColumn("is_outlier", F.col("lof") > F.col("_q")).drop("_q")
