"""Ordered windows that do not put a whole series into one task.

A series (the rows of one key) is cut into buckets of times. What a row needs from other buckets is either the nearest known
value before or after it, which is carried over from small per-bucket summaries, or a fixed number of neighbouring rows,
which are copied to the next chunk as a halo.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.quantiles import how_many_up_to

#: A series of more rows is cut into as many buckets between approximate quantiles of its times as it has times that many rows,
#: MOST_BUCKETS at most. Where no series has more, none is cut, and no summaries are joined.
ROWS, MOST_BUCKETS = 50_000, 2_000


def bucketed(df: DataFrame, key: str, t: str) -> tuple[DataFrame, bool]:
    """df with _b, the row's bucket in its series, and whether any series has several; only those take part in the join. Buckets
    have about as many rows each, however the times lie; rows of one time are in one bucket."""
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS)
    if sizes.isEmpty():
        return df.withColumn("_b", F.lit(0)), False
    long = df.select(F.col(key).alias("_of"), F.col(t).alias("_t")).join(sizes, F.col("_of").eqNullSafe(F.col("_key")))
    shares = F.array(*[F.lit(k / MOST_BUCKETS) for k in range(1, MOST_BUCKETS)])
    step = F.greatest(F.lit(1), F.floor(MOST_BUCKETS / F.ceil(F.col("_n") / ROWS)))
    marks = long.groupBy("_key", "_n").agg(F.percentile_approx("_t", shares, 10 * MOST_BUCKETS).alias("_q"))
    marks = marks.select("_key", F.array_sort(F.array_distinct(F.filter("_q", lambda x, k: (k + 1) % step == 0))).alias("_q"))
    cut = df.join(marks, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_b", F.coalesce(how_many_up_to(F.col("_q"), F.col(t), MOST_BUCKETS), F.lit(0)))
    return cut.drop("_key", "_q"), True


def neighbours(df: DataFrame, key: str, t: str, order: list[str], present: Column, payload: Column, many: bool | None = None) -> DataFrame:
    """Adds prev and next: the payload of the nearest row at or before, and at or after, for which present holds. Rows that
    have their buckets already keep them, and many tells whether there are several."""
    own = many is not None
    data, many = (df, many) if own else bucketed(df, key, t)
    data = data.withColumn("_p", F.when(present, payload))
    # what follows is sought in the opposite order: a frame that grows takes one step per row, one that shrinks starts anew at each
    within = Window.partitionBy(key, "_b") if many else Window.partitionBy(key)
    rows = data.withColumn("prev", F.last("_p", True).over(within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.last("_p", True).over(within.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)))
    if many:
        place = F.when(F.col("_p").isNotNull(), F.struct(*order))
        buckets = data.groupBy(key, "_b").agg(F.min_by("_p", place).alias("_first"), F.max_by("_p", place).alias("_last"))
        by_bucket = Window.partitionBy(key)  # a row per bucket, not per point
        carried = buckets.select(
            F.col(key).alias("_key"),
            F.col("_b").alias("_bucket"),
            F.last("_last", True).over(by_bucket.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.last("_first", True).over(by_bucket.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
        ).where("_before is not null or _after is not null")
        rows = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")), "left")
        rows = rows.withColumn("prev", F.coalesce("prev", "_before")).withColumn("next", F.coalesce("next", "_after")).drop("_before", "_after", "_key", "_bucket")
    return rows.drop("_p", *([] if own else ["_b"]))


def numbered(df: DataFrame, key: str, t: str, order: list[str], many: bool | None = None) -> DataFrame:
    """Adds _i, the row's number in its series from 0: the number in its bucket plus the rows of all buckets before."""
    own = many is not None
    data, many = (df, many) if own else bucketed(df, key, t)
    if not many:
        rows = data.withColumn("_i", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    else:
        before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = data.groupBy(key, "_b").count().select(F.col(key).alias("_key"), F.col("_b").alias("_bucket"), F.sum("count").over(before).alias("_o")).where("_o > 0")
        number = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
        rows = data.withColumn("_n", number).join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")), "left")
        rows = rows.withColumn("_i", F.coalesce("_o", F.lit(0)) + F.col("_n")).drop("_n", "_o", "_key", "_bucket")
    return rows if own else rows.drop("_b")


def chunked(df: DataFrame, key: str, t: str, order: list[str], before: int, after: int, size: int = 100_000) -> DataFrame:
    """Numbered rows in chunks, with so many rows of the neighbouring chunks copied into each; _home marks the own rows.
    Row frames over Window.partitionBy(key, "_c").orderBy("_i") are exact for them."""
    before_after(max(before, after), size)
    data, many = bucketed(df, key, t)
    data = numbered(data, key, t, order, many).drop("_b")
    if not many and size >= ROWS:
        return data.withColumn("_c", F.lit(0)).withColumn("_home", F.lit(True))
    chunk, within = F.floor(F.col("_i") / size), F.col("_i") % size
    copies = F.array_compact(F.array(chunk, F.when(within < after, chunk - 1), F.when(within >= size - before, chunk + 1)))
    return data.withColumn("_own", chunk).withColumn("_c", F.explode(copies)).withColumn("_home", F.col("_c") == F.col("_own")).drop("_own")


def before_after(n: int, size: int) -> int:
    if n > size:
        raise ValueError("the halo must not be longer than a chunk")
    return n


def frame(key: str, before: int, after: int):
    return Window.partitionBy(key, "_c").orderBy("_i").rowsBetween(-before, after)


def centred(n: int) -> tuple[int, int]:
    """(rows before, rows after) of a centred window of n rows: an even one has one more before."""
    return n // 2, n - 1 - n // 2


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """NaN is no value: null takes its place in those of the columns that can hold one."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if kinds.get(c) in ("double", "float")})


def without_nan(*columns: str) -> Callable:
    """For operators whose first argument is a DataFrame with such columns."""

    def around(operator: Callable) -> Callable:
        @wraps(operator)
        def run(df: DataFrame, *args, **options):
            return operator(clean(df, *columns), *args, **options)

        return run

    return around


def with_groups(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of groups, which has a row for each value of the keys; null is a value like any other."""
    renamed = groups.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(renamed, same, "left").drop(*[f"_of_{k}" for k in keys])


def with_stats(df: DataFrame, key: str, *stats: Column) -> DataFrame:
    """Joins statistics of each key's rows; they are aggregated before the shuffle. Rows of a null key are a group."""
    return with_groups(df, df.groupBy(key).agg(*stats), [key])
