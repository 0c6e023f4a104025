"""Curves through scattered points: locally weighted regression (E-14) and global cubic splines (C-07).

The spline's banded system is solved over chunks of a series: each chunk is solved by itself and for the two unknowns on either
side of it, which leaves a small system of the chunks' ends, and then with these ends known. The result does not depend on
where the chunks are cut, and no task holds a series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import bucketed, neighbours
from tuyere.functions.quantiles import cumulative, how_many_up_to, quantiles
from tuyere.functions.storage import stored
from tuyere.operators.impute import ORDER, TASK_ROWS


def _known(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _anchors(rows: DataFrame, most: int) -> list[float]:
    """All distinct x, or ``most`` of them in equal steps of rank, the least and the largest among them."""
    few = [r.x for r in rows.select("x").distinct().limit(most + 1).collect()]
    if len(few) <= most:
        return sorted(few)
    shares = F.array(*[F.lit(k / (most - 1)) for k in range(most)])
    return sorted(set(rows.agg(F.percentile_approx("x", shares, 20 * most)).first()[0]) | set(rows.agg(F.min("x"), F.max("x")).first()))


def _reach(rows: DataFrame, anchors: list[float], k: int) -> list[float]:
    """The distance of each anchor's k-th nearest row. The k rows from one value on end at some other; of these stretches, whose
    middles rise, the two around an anchor hold its k nearest rows."""
    table = stored(cumulative(rows.select(F.col("x").alias("_v"))), "lowess-ranks")
    values = table.select(F.lit(0).alias("key"), F.col("_before").alias("t"), F.lit(0).alias("id"), F.col("_v").alias("x"), F.lit(None).cast("double").alias("start"))
    ends = table.select(F.lit(0).alias("key"), (F.col("_before") + k - 1).alias("t"), F.lit(1).alias("id"), F.lit(None).cast("double").alias("x"), F.col("_v").alias("start"))
    n = rows.count()
    found = neighbours(values.unionByName(ends.where(F.col("t") < n)), "key", "t", ["t", "id"], F.col("x").isNotNull(), F.struct("x")).where("start is not null")
    places = F.array(*[F.lit(a) for a in anchors])
    middle = (F.col("start") + F.col("prev.x")) / 2
    stretch = F.struct(middle.alias("m"), F.col("start").alias("a"), F.col("prev.x").alias("b"))
    by = found.select(stretch.alias("s"), how_many_up_to(places, middle, len(anchors)).alias("p")).groupBy("p").agg(F.max("s").alias("last"), F.min("s").alias("first")).collect()  # no more than anchors
    out = []
    for j, x in enumerate(anchors):
        near = [max((r.last for r in by if r.p <= j), default=None), min((r.first for r in by if r.p > j), default=None)]
        out.append(min(max(x - s.a, s.b - x) for s in near if s))
    return out


def lowess(df: DataFrame, x: str, y: str, share: float = 0.3, rounds: int = 3, points: int = 200) -> DataFrame:
    """x, fitted: at each distinct x (or at ``points`` of them, between which the curve is a line) the value of the line fitted
    to the nearest share of the rows with tricube weights; in ``rounds`` more passes rows far off the curve count less
    (bisquare of the residual over six medians of all). Rows without x or y, or with NaN, are left out.

    A pass adds five sums per point in each task; medians of residuals are exact."""
    rows = stored(df.select(_known(x).alias("x"), _known(y).alias("y")).where("x is not null and y is not null"), "lowess")
    n, spark = rows.count(), df.sparkSession
    if not n:
        return spark.createDataFrame([], "x double, fitted double")
    anchors = _anchors(rows, points)
    reach = _reach(rows, anchors, max(1, int(share * n + 1e-10)))
    at, h = np.array(anchors), np.array(reach)
    step = max(1, 200_000 // len(at))

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((5, len(at)))
        for batch in batches:
            xs, ys, ws = (c.to_numpy() for c in batch.columns)
            for k in range(0, len(xs), step):
                d = xs[k : k + step, None] - at
                with np.errstate(divide="ignore", invalid="ignore"):
                    u = np.where(d == 0, 0.0, np.abs(d) / h)
                w = np.where(u < 1, (1 - np.minimum(u, 1) ** 3) ** 3, 0.0) * ws[k : k + step, None]
                wy = w * ys[k : k + step, None]
                total += np.stack([w.sum(0), (w * d).sum(0), (w * d * d).sum(0), wy.sum(0), (wy * d).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at)), pa.int32()), *[pa.array(t) for t in total]], names=["k", "s", "sx", "sxx", "sy", "sxy"])

    weight, fitted = F.lit(1.0), at * 0
    for r in range(rounds + 1):
        parts = rows.select("x", "y", weight.alias("w")).mapInArrow(sums, "k int, s double, sx double, sxx double, sy double, sxy double")
        got = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("s", "sx", "sxx", "sy", "sxy")]).orderBy("k").collect()  # a row a point
        s, sx, sxx, sy, sxy = (np.array([g[c] for g in got]) for c in ("s", "sx", "sxx", "sy", "sxy"))
        det = s * sxx - sx * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            fitted = np.where(det > 1e-12 * s * np.maximum(sxx, 1e-300), (sxx * sy - sx * sxy) / det, sy / s)
        if r == rounds:
            break
        curve = [F.array(*[F.lit(float(v)) for v in c]) for c in (at, fitted)]
        p = F.greatest(F.lit(1), F.least(how_many_up_to(curve[0], F.col("x"), len(at)), F.lit(len(at) - 1)))
        (a, b), (u, v) = ((F.get(c, p - 1), F.get(c, p)) for c in curve)
        line = F.coalesce(u + (v - u) * F.try_divide(F.col("x") - a, b - a), u)
        off = stored(rows.select("x", "y", F.abs(F.col("y") - line).alias("off")), "lowess-residuals")
        median = quantiles(off, {"off": F.col("off")}, [0.5]).first().q[0]
        far = F.least(F.col("off") / (6 * median), F.lit(1.0)) if median > 0 else (F.col("off") > 0).cast("double")
        rows, weight = off, F.pow(1 - far * far, 2)
    return spark.createDataFrame(list(zip(at.tolist(), fitted.tolist(), strict=True)), "x double, fitted double")


def equations(i: np.ndarray, y: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """The five diagonals (two before to two after) and the right side of the equations for the second derivatives at all
    points but the first two and last two given, which may lie beyond the chunk (NaN where the series has ended)."""
    h = np.diff(i)
    w = 1 / h
    n = len(i) - 4
    a, b, c, d = (h[k : k + n] for k in range(4))  # the steps around point j: j-2, j-1 | j, j+1
    wa, wb, wc, wd = (w[k : k + n] for k in range(4))
    band = np.zeros((n, 5))
    band[:, 2] = (b + c) / 3 + smoothing * (wb**2 + (wb + wc) ** 2 + wc**2)
    band[:, 1] = b / 6 - smoothing * ((wa + wb) * wb + wb * (wb + wc))
    band[:, 3] = c / 6 - smoothing * ((wb + wc) * wc + wc * (wc + wd))
    band[:, 0], band[:, 4] = smoothing * wa * wb, smoothing * wc * wd
    right = (y[3:-1] - y[2:-2]) * wc - (y[2:-2] - y[1:-3]) * wb
    end = np.isnan(b) | np.isnan(c)  # the series' first and last point bend by nothing
    band[end], right[end] = (0, 0, 1, 0, 0), 0
    return np.nan_to_num(band), right


def _eliminate(band: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of systems of equal size: band (systems, rows, columns -2..2), right (systems, rows, right sides), by elimination without
    exchange of rows, a row of all systems at a time. What a band has outside its system does not count."""
    n, wide = band.shape[1], band[:, :, [0, 4]].any()
    rows, x = (np.array(v.transpose(1, 2, 0), float, order="C") for v in (band, right))
    for k in range(n):
        for below in (1, 2) if wide else (1,):
            if k + below < n:
                f = rows[k + below, 2 - below] / rows[k, 2]
                rows[k + below, 3 - below] -= f * rows[k, 3]
                rows[k + below, 4 - below] -= f * rows[k, 4]
                x[k + below] -= f * x[k]
    for k in range(n - 1, -1, -1):
        for above in (1, 2) if wide else (1,):
            if k + above < n:
                x[k] -= rows[k, 2 + above] * x[k + above]
        x[k] /= rows[k, 2]
    return x.transpose(2, 0, 1)


def _tie(m: np.ndarray) -> np.ndarray:
    """Of each part in a row of parts the unknowns two before and two after it, for each right side. m has for a part's first two
    and last two unknowns the values of the right sides alone and what each of these four neighbours takes from them:
    u[c] = g[c] - v[c] last[c-1] - w[c] first[c+1]."""
    n, g, v, w = len(m), m[:, :, :-4], m[:, :, -4:-2], m[:, :, -2:]
    a, b = [None] * n, [None] * n
    for c in range(n):  # forward: u[c] = a[c] - b[c] first[c+1]
        left, over = np.eye(4), g[c]
        if c:
            left[:, :2] -= v[c] @ b[c - 1][2:]
            over = over - v[c] @ a[c - 1][2:]
        both = np.linalg.solve(left, np.concatenate([over, w[c]], 1))
        a[c], b[c] = both[:, :-2], both[:, -2:]
    out = np.zeros((n, 4, g.shape[2]))
    later = None
    for c in range(n - 1, -1, -1):
        u = a[c] if later is None else a[c] - b[c] @ later
        if c:
            out[c - 1, 2:] = u[:2]
        if c + 1 < n:
            out[c + 1, :2] = u[2:]
        later = u[:2]
    return out


def solve_banded(band: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of five diagonals (rows by columns -2..2) and several right sides: rows are cut into as many blocks as a block has rows,
    which are solved at once, and then tied like the chunks of a series."""
    n, size = len(band), max(8, int(len(band) ** 0.5))
    if n <= 4 * size:
        return _eliminate(band[None], right[None])[0]
    blocks = -(-n // size)
    rows, over = np.zeros((blocks * size, 5)), np.zeros((blocks * size, right.shape[1]))
    rows[:, 2] = 1  # unknowns that fill the last block, and are 0
    rows[:n], over[:n] = band, right
    rows[0, :2] = rows[1, 0] = rows[n - 1, 3:] = rows[n - 2, 4] = 0
    rows, over = rows.reshape(blocks, size, 5), over.reshape(blocks, size, -1)
    x = _eliminate(rows, np.concatenate([over, np.stack([_ends(b) for b in rows])], 2))
    return (x[:, :, :-4] - x[:, :, -4:] @ _tie(x[:, [0, 1, -2, -1]])).reshape(blocks * size, -1)[:n]


def _chunk(table, smoothing: float):
    """(rows of the chunk in order, their diagonals, right side, the whole i and y with two more points on either side)."""
    i, y, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("at", "y", "home"))
    order = np.argsort(i)
    i, y, home = i[order].astype(float), y[order], home[order].astype(bool)
    first, last = np.flatnonzero(home)[[0, -1]]
    pad = lambda v: np.concatenate([np.full(2 - first, np.nan), v, np.full(2 - (len(v) - 1 - last), np.nan)])
    i, y = pad(i), pad(y)
    band, right = equations(i, y, smoothing)
    return band, right, i, y


def _ends(band: np.ndarray) -> np.ndarray:
    """What the two unknowns before and the two after the chunk put into its equations, as columns."""
    n = len(band)
    out = np.zeros((n, 4))
    out[0, 0], out[0, 1] = band[0, 0], band[0, 1]
    out[n - 1, 3], out[n - 1, 2] = band[-1, 4], band[-1, 3]
    out[1, 1] = band[1, 0]
    out[n - 2, 2] = band[-2, 4]
    return out


def _placed(df: DataFrame) -> DataFrame:
    """df with _v (the known value), _i (the row's number in its series), _of (the number of the last row with a known value up to
    it, or -1), _j (how many known values there are up to it) and _m (how many the series has). Rows are put in order once; what
    lies before a bucket comes from a row per bucket."""
    rows, many = bucketed(df.withColumn("_v", _known("v")), "series", "t")
    keys = ["series", "_b"] if many else ["series"]
    if many:  # so many tasks as rows need, as their bytes are few
        rows = rows.repartition(-(-df.count() // TASK_ROWS), *keys)
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_i", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.withColumn("_of", F.last(F.when(F.col("_v").isNotNull(), F.col("_i")), True).over(upto)).withColumn("_j", F.count("_v").over(upto))
    if not many:
        rows = rows.withColumn("_m", F.count("_v").over(Window.partitionBy("series")))
        return stored(rows.withColumn("_of", F.coalesce("_of", F.lit(-1))).drop("_b"), "spline-rows")
    rows = stored(rows, "spline-rows")
    sums = rows.groupBy(F.col("series").alias("_key"), F.col("_b").alias("_bucket")).agg(F.count("*").alias("n"), F.count("_v").alias("m"), F.max("_of").alias("last"))
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket, not per point
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select("_key", "_bucket", "last", earlier("n").alias("_rows"), earlier("m").alias("_known"), F.sum("m").over(whole).alias("_m"))
    sums = stored(sums.withColumn("_last", F.last(F.col("_rows") + F.col("last"), True).over(before)).drop("last"), "spline-buckets")
    rows = rows.join(sums, F.col("series").eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")))
    rows = rows.withColumns({"_i": F.col("_i") + F.col("_rows"), "_of": F.coalesce(F.col("_of") + F.col("_rows"), "_last", F.lit(-1)), "_j": F.col("_j") + F.col("_known")})
    return rows.drop("_key", "_bucket", "_rows", "_known", "_last", "_b")


def pieces(known: DataFrame, smoothing: float, chunk: int) -> DataFrame:
    """key, at, y, j (number among the known), m (known of the series) -> the pieces of the curve that gaps need: key, of (the known
    point before the gap, -1 before the first), at, g (the curve there), c (its second derivative), the same of the next known
    point (at1, g1, c1), or the slope of the line beyond the first and last."""
    if chunk < 2:
        raise ValueError("a chunk has two points at least")
    key_type = known.schema["key"].dataType.simpleString()
    chunks = F.greatest(F.lit(1), F.floor(F.col("m") / chunk))
    own = F.least(F.floor(F.col("j") / chunk), chunks - 1)
    before = F.when((own > 0) & (F.col("j") - own * chunk < 2), own - 1)
    after = F.when((own < chunks - 1) & ((own + 1) * chunk - F.col("j") <= 2), own + 1)
    copies = F.array_compact(F.array(own, before, after))
    dealt = stored(known.select("key", "at", "y", own.alias("own"), F.explode(copies).alias("part")).select("key", "part", "at", "y", (F.col("own") == F.col("part")).alias("home")), "spline-chunks")
    tasks = max(1, -(-dealt.count() // TASK_ROWS))
    by_part = lambda df: df.repartition(tasks, "key", "part").groupBy("key", "part")

    def by_itself(key, table):
        import pyarrow as pa

        band, right, _, _ = _chunk(table, smoothing)
        m = np.zeros((4, 5))
        if len(band) > 1:  # else the series has one point
            m = solve_banded(band, np.column_stack([right, _ends(band)]))[[0, 1, -2, -1]]
        return pa.table([pa.array([key[0].as_py()], key[0].type), pa.array([key[1].as_py()], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["key", "part", "m"])

    def join_ends(key, table):
        import pyarrow as pa

        part = table.column("part").to_numpy()
        order = np.argsort(part)
        m = np.asarray(table.column("m").combine_chunks().flatten(), float).reshape(-1, 4, 5)[order]
        ends = _tie(m)[:, :, 0].tolist()
        return pa.table([pa.array([key[0].as_py()] * len(m), key[0].type), pa.array(part[order], pa.int64()), pa.array(ends, pa.list_(pa.float64()))], names=["key", "part", "ends"])

    def with_ends(key, table, found):
        import pyarrow as pa

        band, right, i, y = _chunk(table, smoothing)
        ends = np.asarray(found.column("ends").combine_chunks().flatten(), float)
        own = np.zeros(1) if len(band) == 1 else solve_banded(band, (right - _ends(band) @ ends)[:, None])[:, 0]
        around = np.concatenate([ends[:2], own, ends[2:]])
        w = np.nan_to_num(1 / np.diff(i))
        # the points of the chunk and the next one
        g = y[2:-1] - smoothing * (around[1:-2] * w[1:-1] - (w[1:-1] + w[2:]) * around[2:-1] + around[3:] * w[2:])
        at, c, n = i[2:-1], around[2:-1], len(own)
        gap = np.flatnonzero(np.diff(at) > 1)  # not where the series has ended
        of, here, there = at[gap], gap, gap + 1
        slope = np.full(len(gap), np.nan)
        h = np.diff(at)
        if np.isnan(i[1]):  # the first point of the series
            of, here, there = np.append(of, -1), np.append(here, 0), np.append(there, -1)
            slope = np.append(slope, (g[1] - g[0]) / h[0] - h[0] / 6 * (2 * c[0] + c[1]) if n > 1 else 0.0)
        if np.isnan(i[-2]):  # the last one
            of, here, there = np.append(of, at[n - 1]), np.append(here, n - 1), np.append(there, -1)
            slope = np.append(slope, (g[n - 1] - g[n - 2]) / h[n - 2] + h[n - 2] / 6 * (c[n - 2] + 2 * c[n - 1]) if n > 1 else 0.0)
        line = there < 0
        whole = lambda v, mask=None: pa.array(np.nan_to_num(v).astype(np.int64), mask=mask)
        columns = [whole(of), whole(at[here]), pa.array(g[here]), pa.array(c[here]), whole(at[there], line), pa.array(g[there], mask=line), pa.array(c[there], mask=line), pa.array(slope, mask=~line)]
        return pa.table([pa.array([key[0].as_py()] * len(of), key[0].type), *columns], names=["key", "of", "at", "g", "c", "at1", "g1", "c1", "slope"])

    parts = stored(by_part(dealt).applyInArrow(by_itself, f"key {key_type}, part long, m array<double>"), "spline-parts")
    ends = stored(parts.groupBy("key").applyInArrow(join_ends, f"key {key_type}, part long, ends array<double>"), "spline-ends")
    return by_part(dealt).cogroup(by_part(ends)).applyInArrow(with_ends, f"key {key_type}, of long, at long, g double, c double, at1 long, g1 double, c1 double, slope double")


def fill_spline(df: DataFrame, smoothing: float = 0.0, chunk: int = 50_000) -> DataFrame:
    """Adds filled: gaps get the natural cubic spline, in the row number, through all known values of the series; with
    smoothing above 0 the curve that weighs squared residuals against smoothing times the integral of the squared second
    derivative. Beyond the first and last known value the curve goes on as a line. A series of one known value is filled with
    it; one of none stays empty. NaN is no value."""
    rows = _placed(df)
    known = rows.where("_v is not null").withColumn("filled", F.col("_v"))
    points = known.select(F.col("series").alias("key"), F.col("_i").alias("at"), F.col("_v").alias("y"), (F.col("_j") - 1).alias("j"), F.col("_m").alias("m"))
    gaps = rows.where("_v is null").join(stored(pieces(points, smoothing, chunk), "spline"), F.col("series").eqNullSafe(F.col("key")) & (F.col("_of") == F.col("of")), "left")
    s, e, h = F.col("_i") - F.col("at"), F.col("at1") - F.col("_i"), F.col("at1") - F.col("at")
    inside = (s * F.col("g1") + e * F.col("g")) / h - s * e / 6 * ((1 + s / h) * F.col("c1") + (1 + e / h) * F.col("c"))
    gaps = gaps.withColumn("filled", F.when(F.col("at1").isNotNull(), inside).otherwise(F.col("g") + s * F.col("slope")))
    return known.select(*df.columns, "filled").unionByName(gaps.select(*df.columns, "filled"))
