"""Time-scale alignment: irregular series onto a common grid, with gap-limited interpolation (D family).

Input points are rows (series, t in microseconds, id, v); points without a value (null or NaN) are left out, of equal times the one with
the smallest id counts. An empty input gives an empty output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import chunked, clean, neighbours, with_groups, with_stats
from tuyere.functions.storage import stored

HOUR = 3_600_000_000
FREQUENCIES = {"1s": 1, "5s": 5, "1m": 60, "1min": 60, "1h": 3600, "1d": 86400}


def step_of(frequency: str) -> int:
    """Microseconds of a grid step: 1S, 5S, 1M (a minute), 1H, or a number with the unit s, m, h or d."""
    text = frequency.lower()
    if text in FREQUENCIES:
        return FREQUENCIES[text] * 1_000_000
    return int(text[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[text[-1]] * 1_000_000


def points_of(df: DataFrame) -> DataFrame:
    return clean(df, "v").where("v is not null").groupBy("series", "t").agg(F.min_by("v", "id").alias("v"))


def grid_of(points: DataFrame, step: int, shared: bool = False) -> DataFrame:
    """series, t: from the series' first time in equal steps up to its last; with shared, one range for all series."""
    ends = points.groupBy("series").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    if shared:
        ends = ends.select("series").crossJoin(F.broadcast(points.agg(F.min("t").alias("a"), F.max("t").alias("b"))))  # one row
    blocks = ends.select("series", "b", F.explode(F.sequence("a", "b", F.lit(step * 1000))).alias("at"))
    return blocks.select("series", F.explode(F.sequence("at", F.least(F.col("b"), F.col("at") + step * 999), F.lit(step))).alias("t"))


def bracket(points: DataFrame, grid: DataFrame, *more: str) -> DataFrame:
    """grid rows with prev and next (structs t, v and more columns of the points): the points at or before and at or after."""
    kinds = dict(points.dtypes)
    rows = points.select("series", "t", "v", *more, F.lit(0).alias("k")).unionByName(grid.select("series", "t", F.lit(None).cast("double").alias("v"), *[F.lit(None).cast(kinds[c]).alias(c) for c in more], F.lit(1).alias("k")))
    found = neighbours(rows, "series", "t", ["t", "k"], F.col("k") == 0, F.struct("t", "v", *more))
    # a point at a grid time comes before the grid row: it is both neighbours then
    exact = F.col("prev.t") == F.col("t")
    return found.where("k = 1").select("series", "t", "prev", F.when(exact, F.col("prev")).otherwise(F.col("next")).alias("next"))


def interpolate(points: DataFrame, grid: DataFrame, method: str = "linear", max_gap: int = 6 * HOUR) -> DataFrame:
    """series, t, v, status. Methods: linear, nearest, cubic, forward_fill, backward_fill. A grid time with a point takes
    its value; outside the points and in gaps longer than max_gap the value is null."""
    if method == "cubic":
        order, point = Window.partitionBy("series", "_c").orderBy("_i"), F.struct("t", "v")
        near = chunked(points, "series", "t", ["t"], 1, 2)
        near = near.select("series", "t", "v", F.lag(point).over(order).alias("p0"), F.lead(point).over(order).alias("p2"), F.lead(point, 2).over(order).alias("p3"), "_home").where("_home")
        # stored, so that its partitions are no part of the plan: a union with the grid, dealt by the same key, must deal both anew
        found = bracket(stored(near.drop("_home"), "align-neighbours"), grid, "p0", "p2", "p3").select("*", "prev.p0", "prev.p2", "prev.p3")
    else:
        found = bracket(points, grid)
    a, b, t = F.col("prev"), F.col("next"), F.col("t")
    inside = a.isNotNull() & b.isNotNull()
    status = F.when(a["t"] == t, "EXACT_MATCH").when(a.isNull(), "BEFORE_FIRST").when(b.isNull(), "AFTER_LAST").when(b["t"] - a["t"] > max_gap, "GAP_TOO_LARGE")
    linear = a["v"] + (b["v"] - a["v"]) * ((t - a["t"]) / (b["t"] - a["t"]))
    if method == "linear":
        value, done = linear, "LINEAR_INTERPOLATED"
    elif method == "nearest":
        value, done = F.when(t - a["t"] < b["t"] - t, a["v"]).otherwise(b["v"]), "NEAREST_NEIGHBOR"
    elif method in ("forward_fill", "backward_fill"):
        near = a if method == "forward_fill" else b
        status = F.when(a["t"] == t, "EXACT_MATCH").when(near.isNull(), "BEFORE_FIRST" if method == "forward_fill" else "AFTER_LAST").when(F.abs(t - near["t"]) > max_gap, "GAP_TOO_LARGE")
        value, done, inside = near["v"], method.upper() + "ED", near.isNotNull()
    elif method == "cubic":
        p0, p1, p2, p3 = F.col("p0"), a, F.col("p2"), F.col("p3")
        value = F.when(p0.isNull() | p3.isNull(), linear).otherwise(lagrange([p0, p1, p2, p3], t))
        done = "CUBIC_INTERPOLATED"
    else:
        raise ValueError(f"unknown method {method}")
    status = F.coalesce(status, F.lit(done))
    return found.select("series", "t", F.when(status == "EXACT_MATCH", a["v"]).when((status == done) & inside, value).alias("v"), status.alias("status"))


def lagrange(points: list[Column], t: Column) -> Column:
    """The cubic through four points (structs t, v), with times relative to the second in seconds."""
    rel = [(p["t"] - points[1]["t"]) / 1e6 for p in points]
    x = (t - points[1]["t"]) / 1e6
    total = F.lit(0.0)
    for i, p in enumerate(points):
        term = p["v"]
        for j in range(4):
            if j != i:
                term = term * ((x - rel[j]) / (rel[i] - rel[j]))
        total = total + term
    return total


def flag_outliers(aligned: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """is_outlier: further than so many population standard deviations from the series' mean; false with less than 3 values."""
    rows = with_stats(aligned, "series", F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"), F.count("v").alias("_n"))
    flag = (F.col("_n") >= 3) & (F.abs(F.col("v") - F.col("_m")) > sigmas * F.col("_s"))
    return rows.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("_m", "_s", "_n")


def align(df: DataFrame, step: int = HOUR, method: str = "linear", max_gap: int = 6 * HOUR, shared: bool = False) -> DataFrame:
    """series, t, v, status, is_outlier."""
    points = stored(points_of(df), "align-points")
    return flag_outliers(interpolate(points, grid_of(points, step, shared), method, max_gap))


def summary(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("series").agg(
        F.count("*").alias("n_points"),
        F.count_if(F.col("status").contains("INTERPOLATED")).alias("n_interpolated"),
        F.count_if(F.col("v").isNull()).alias("n_missing"),
        F.count_if("is_outlier").alias("n_outliers"),
    )


def table_align(df: DataFrame, ts: str, columns: list[str], step: int, **options) -> DataFrame:
    """A wide table aligned column by column on one shared grid, and wide again."""
    long = df.unpivot([ts], columns, "series", "v").select("series", F.col(ts).alias("t"), F.lit(0).alias("id"), F.col("v").cast("double").alias("v"))
    return align(long, step, shared=True, **options).groupBy("t").pivot("series", columns).agg(F.first("v"))


def parse_times(df: DataFrame, raw: str = "raw", zone: str = "UTC") -> DataFrame:
    """kind and t (microseconds): numbers above 1e12 are milliseconds, others seconds; ISO with or without an offset; four
    database forms without one, in the given zone. Rows that fit nothing keep a null t."""
    c = F.trim(F.col(raw))
    kind = (
        F.when(c.rlike(r"^\d+(\.\d+)?$"), F.when(F.expr(f"try_cast(trim({raw}) as double)") > 1e12, "UNIX_MS").otherwise("UNIX_S"))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"), "ISO_8601")
        .when(c.contains("T") | c.contains(" "), "DB_DATETIME")
        .otherwise("UNKNOWN")
    )
    number = F.expr(f"try_cast(trim({raw}) as decimal(30,6))")
    text = F.regexp_replace(c, "T", " ")
    zoned = F.expr(f"try_to_timestamp(trim({raw}))")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss"]
    naive = F.to_utc_timestamp(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]), zone)
    has_zone = c.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    micros = F.when(kind == "UNIX_MS", (number * 1000).cast("long")).when(kind == "UNIX_S", (number * 1_000_000).cast("long"))
    micros = micros.when((kind == "ISO_8601") & has_zone, F.unix_micros(zoned)).when(kind.isin("ISO_8601", "DB_DATETIME"), F.unix_micros(naive))
    return df.withColumn("kind", kind).withColumn("t", micros)


def time_offsets(df: DataFrame, most: int = 1000) -> DataFrame:
    """source, n, lag, r2 against the source with most points (first by name of equals): the lag, in places, at which the
    cross-correlation of the standardised times of the first ``most`` points is largest (the smallest of equals), and the
    squared correlation of the times if both have as many points. Fewer than 10 points: 0 and 0."""
    order = Window.partitionBy("series").orderBy("t", "id")
    counts = df.groupBy("series").agg(F.count("*").alias("n"))
    base = counts.orderBy(F.desc("n"), "series").limit(1).select(F.col("series").alias("base"))
    first = df.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") < most)
    lists = first.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("x"))
    x = F.transform("x", lambda e: e["t"] / 1e6)
    mean = F.aggregate("x", F.lit(0.0), lambda a, e: a + e) / F.size("x")
    lists = lists.select("series", x.alias("x")).withColumn("m", mean).withColumn("s", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + (e - F.col("m")) * (e - F.col("m"))) / F.size("x")))
    lists = lists.withColumn("z", F.when(F.col("s") > 0, F.transform("x", lambda e: (e - F.col("m")) / F.col("s"))).otherwise(F.transform("x", lambda e: F.lit(0.0))))
    left = lists.join(F.broadcast(base), F.col("series").eqNullSafe(F.col("base"))).select(F.col("z").alias("a"))  # one row of at most ``most`` numbers
    pairs = lists.select("series", "z").crossJoin(F.broadcast(left))
    lags = pairs.withColumn("lag", F.explode(F.sequence(1 - F.size("z"), F.size("a") - 1)))
    overlap = F.zip_with(F.slice("a", F.greatest(F.lit(1), F.col("lag") + 1), 1000000), F.slice("z", F.greatest(F.lit(1), 1 - F.col("lag")), 1000000), lambda p, q: F.coalesce(p * q, F.lit(0.0)))
    scored = lags.select("series", "lag", F.size("a").alias("na"), F.size("z").alias("nz"), "a", "z", F.round(F.aggregate(overlap, F.lit(0.0), lambda t, e: t + e), 6).alias("c"))
    r = F.aggregate(F.zip_with("a", "z", lambda p, q: p * q), F.lit(0.0), lambda t, e: t + e) / F.size("a")
    best = scored.groupBy("series").agg(F.min_by(F.struct("lag", "na", "nz", F.when(F.col("na") == F.col("nz"), r * r).otherwise(0.0).alias("r2")), F.struct(-F.col("c"), "lag")).alias("x"))
    small = (F.col("x.na") < 10) | (F.col("x.nz") < 10)
    return with_groups(best, counts, ["series"]).select("series", "n", F.when(small, 0).otherwise(F.col("x.lag")).alias("lag"), F.when(small, 0.0).otherwise(F.col("x.r2")).alias("r2"))


def synchronise(df: DataFrame, least: float = 0.8) -> DataFrame:
    """The offsets of all sources against the one with most points, and a warning where the times of two sources of equal
    length do not go together well (a squared correlation below ``least``)."""
    found = time_offsets(df)
    n = found.agg(F.max("n").alias("most"))  # one row
    weak = (F.col("n") == F.col("most")) & (F.col("r2") < least)
    return found.crossJoin(F.broadcast(n)).withColumn("warning", F.when(weak, F.concat(F.lit("weak match: r2 "), F.format_number("r2", 3)))).drop("most")
