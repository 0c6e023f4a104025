"""Exact quantiles without ordering everything in one task.

Approximate quantiles, merged from the tasks' small summaries, enclose each wanted quantile between two marks, but for one
rank on either side. One more pass counts the values below the lower mark and the few distinct values between the marks, and
finds the nearest values beyond the marks; only those are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.storage import stored

#: The approximate quantiles' rank error is at most the number of values divided by this.
ACCURACY = 10_000


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by..., name, n, q: for each named column the quantiles of its values that are not null or NaN, linear between two
    values.
    A column without values has an n of 0 and null quantiles. Rows of a null group are a group of their own."""
    by = by or []
    keys = [f"_g{k}" for k in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[F.when(~F.isnan(x := c.cast("double")), x).alias(f"_x{k}") for k, c in enumerate(columns.values())])
    margin = 3.0 / ACCURACY
    marks = ", ".join(f"{min(1.0, max(0.0, s + d))!r}D" for s in shares for d in (-margin, margin))
    xs, js = range(len(columns)), range(len(shares))
    summary = rows.groupBy(*keys).agg(*[F.expr(f"count(_x{k})").alias(f"_n{k}") for k in xs], *[F.expr(f"percentile_approx(_x{k}, array({marks}), {ACCURACY})").alias(f"_m{k}") for k in xs])
    if by:
        summary = stored(summary.withColumnsRenamed({k: f"{k}_" for k in keys}), "quantile-marks")
        marked = rows.join(summary, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).drop(*[f"{k}_" for k in keys])
        mark, size = lambda k, i: f"_m{k}[{i}]", lambda k: f"_n{k}"
    else:
        found, marked = summary.first(), rows  # a few numbers, which go into the filters of the next pass
        mark, size = lambda k, i: f"double('{found[f'_m{k}'][i]!r}')" if found[f"_m{k}"] else "double(null)", lambda k: f"{found[f'_n{k}']}L"
    # the values between the marks, counted by value, and the nearest ones beyond them, the lower with all that are below
    cells, beyond = [], []
    for k in xs:
        inside = [f"_x{k} between {mark(k, 2 * j)} and {mark(k, 2 * j + 1)}" for j in js]
        here = ", ".join(f"if({c}, {j}, null)" for j, c in enumerate(inside))
        cells.append(f"if({' or '.join(inside)}, named_struct('c', {k}, 'n', {size(k)}, 'x', _x{k}, 'js', array({here})), null)")
        for j in js:
            low, high = f"_x{k} < {mark(k, 2 * j)}", f"_x{k} > {mark(k, 2 * j + 1)}"
            n = f"max({size(k)})"
            beyond.append(f"named_struct('c', {k}, 'j', {j}, 'n', {n}, 'x', max(_x{k}) filter (where {low}), 'w', count_if({low}))")
            beyond.append(f"named_struct('c', {k}, 'j', {j}, 'n', {n}, 'x', min(_x{k}) filter (where {high}), 'w', least(count_if({high}), 1L))")
    # one pass for the values of all columns, which few rows have, and one for what lies beyond
    counted = marked.select(*keys, F.expr(f"inline(array_compact(array({', '.join(cells)})))")).groupBy(*keys, "c", "n", "x", "js").agg(F.count("*").alias("w"))
    counted = counted.selectExpr(*keys, "c", "explode(array_compact(js)) as j", "n", "x", "w")
    rest = marked.groupBy(*keys).agg(F.expr(f"array({', '.join(beyond)})").alias("e")).selectExpr(*keys, "inline(e)")
    counts = rest.unionByName(counted).where("w > 0 or n = 0")
    order = Window.partitionBy(*keys, "c", "j").orderBy("x")
    upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("upto", upto)
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("j") + 1)
    place = share * (F.col("n") - 1)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("x")))
    low = F.floor(place)
    found = counts.groupBy(*keys, "c", "j", "n").agg(at(low).alias("lo"), at(F.least(low + 1, F.col("n") - 1)).alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (place - low)
    wide = found.groupBy(*keys, "c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", value.alias("v")))), lambda e: e["v"]).alias("q"))
    names = F.array(*[F.lit(name) for name in columns])
    return wide.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.get(names, F.col("c")).alias("name"), "n", "q")


def with_quantiles(df: DataFrame, by: str, value: Column, shares: list[float], name: str) -> DataFrame:
    """Adds to each row the quantiles of its group as an array."""
    q = quantiles(df, {"v": value}, shares, [by]).select(F.col(by).alias("_q_by"), F.col("q").alias(name))
    return df.join(q, F.col(by).eqNullSafe(F.col("_q_by")), "left").drop("_q_by")


def how_many_up_to(bounds: Column, x: Column, most: int, key=lambda e: e) -> Column:
    """How many of the sorted bounds (no more than ``most``) are not above x, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(key(F.get(bounds, at + step - 1)) <= x, at + step).otherwise(at))


def cumulative(values: DataFrame, buckets: int = 1000) -> DataFrame:
    """_v, _n, _before: the distinct values of the column _v, how often each occurs, and how many values are below it. Counts
    are summed per bucket of values first (buckets lie between approximate quantiles), so that the running sum over everything
    has one row per bucket, and no task orders all."""
    counts = values.groupBy("_v").agg(F.count("*").alias("_n"))
    bounds = values.agg(F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 10 * buckets)).alias("_q"))  # one row
    counts = counts.crossJoin(F.broadcast(bounds)).withColumn("_b", how_many_up_to(F.col("_q"), F.col("_v"), buckets)).drop("_q")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_c", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(offsets), "_b")  # no more rows than buckets
    return counts.select("_v", "_n", (F.col("_o") + F.col("_c")).alias("_before"))


def evenly(values: DataFrame, n: int, points: int) -> DataFrame:
    """k, v: so many quantiles (two at least) in equal steps of the n values (two at least) of the column _v. Each distinct
    value is at the places from its _before on, and tells for which k the place below or above it is one of them."""
    table = stored(cumulative(values), "cumulative")
    span, steps = n - 1, points - 1
    exact = lambda place: f"(greatest(0L, {place}) * {steps}L + {span}L - 1) div {span}L"

    def at(shift: int, name: str) -> DataFrame:
        ks = table.selectExpr("_v", f"{exact(f'_before - {shift}L')} as a", f"least({steps}L, {exact(f'_before + _n - {shift}L')} - 1) as b").where("a <= b")
        return ks.selectExpr("explode(sequence(a, b)) as k", f"_v as {name}")

    low, high = at(0, "lo"), at(1, "hi")
    place = f"(k * {span}L % {steps}L) / {steps}D"
    return low.join(high, "k", "left").selectExpr("k", f"lo + (coalesce(hi, lo) - lo) * {place} as v")


#: A column of fewer distinct values is ranked by a table of them; rows of a bucket of values where there are more.
#: A task ranks about TASK_ROWS rows.
FEW, BUCKET_ROWS, TASK_ROWS = 1000, 20_000, 1_000_000


def with_ranks(df: DataFrame, columns: dict[str, str], few: int = FEW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds to each row, under the given names, the average ranks of the columns' values, which must not be null.

    A column of few values is ranked by counting them, and takes no shuffle. The values of any other one lie in buckets between
    approximate quantiles, at most 1000, and each row goes to the task of its bucket; a value that is such a bound has a bucket of
    its own, whose rank follows from the counts of the buckets, so the rows of a frequent value go to many tasks."""
    names, spark = list(columns), df.sparkSession
    sizes = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c, 0.05).alias(f"d{k}") for k, c in enumerate(names)]).first()
    small = [c for k, c in enumerate(names) if sizes[f"d{k}"] < few]
    rows, large = df, [c for c in names if c not in small]
    if small:
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(small)])
        counts = df.select(F.inline(pairs)).groupBy("k", "v").agg(F.count("*").alias("n")).collect()  # little more than few a column
        for k, c in enumerate(small):
            before, table = 0, []
            for v, n in sorted((r.v, r.n) for r in counts if r.k == k):
                table.append((v, before + (n + 1) / 2))
                before += n
            ranks = spark.createDataFrame(table, f"_rank_v{k} double, _rank_s{k} double")
            rows = rows.join(F.broadcast(ranks), F.col(c).cast("double") == F.col(f"_rank_v{k}")).withColumn(columns[c], F.col(f"_rank_s{k}")).drop(f"_rank_v{k}", f"_rank_s{k}")
    if not large:
        return rows
    buckets = max(2, min(1000, -(-sizes.n // bucket_rows)))
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    bounds = df.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(c, shares, 10 * buckets))).alias(f"_q{k}") for k, c in enumerate(large)]).first()

    def bucket(c: str, marks: list) -> Column:
        q = F.array(*[F.lit(float(x)) for x in marks])
        own = lambda u: 2 * u - (F.get(q, u - 1) == F.col(c)).cast("int")
        return F.coalesce(F.get(F.transform(F.array(how_many_up_to(q, F.col(c), len(marks))), own), F.lit(0)), F.lit(0))

    rows = rows.withColumns({f"_b{k}": bucket(c, bounds[f"_q{k}"]) for k, c in enumerate(large)})
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_b{k}").alias("b")) for k in range(len(large))])
    found = rows.select(F.inline(pairs)).groupBy("k", "b").agg(F.count("*").alias("n")).collect()  # a number a bucket
    for k, c in enumerate(large):
        before, table = 0, []
        for b, n in sorted((r.b, r.n) for r in found if r.k == k):
            table.append((b, before, n))
            before += n
        rows = rows.join(F.broadcast(spark.createDataFrame(table, f"_b{k} int, _o long, _m long")), f"_b{k}")
        lone = F.col(f"_b{k}") % 2 == 1
        rows = rows.withColumn("_lot", F.when(lone, F.pmod(F.xxhash64(*names), F.lit(64))).otherwise(0))
        # so many tasks as rows need: a partition's bytes, by which Spark would join them, are few where values repeat
        rows = rows.repartition(max(1, -(-sizes.n // TASK_ROWS)), f"_b{k}", "_lot")
        ordered = Window.partitionBy(f"_b{k}", "_lot").orderBy(c)
        among = F.col("_o") + F.rank().over(ordered) + (F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
        rows = rows.withColumn(columns[c], F.when(lone, F.col("_o") + (F.col("_m") + 1) / 2).otherwise(among)).drop("_lot", "_o", "_m", f"_b{k}")
    return rows
