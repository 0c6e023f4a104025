"""Counting of inversions (discordant pairs) without comparing all pairs.

Values of either column lie in buckets between approximate quantiles; a value that is a bound has a bucket of its own, so a
frequent value shares its bucket with no other. Pairs of rows in different buckets of both columns follow from the counts of
the cells, which are at most ``(2 * BUCKETS + 1) ** 2``; pairs in one bucket of either column are counted in the task that has
the bucket. Buckets of one value have no inversions and are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.functions.quantiles import how_many_up_to
from tuyere.functions.storage import stored

BUCKETS, ROWS = 500, 50_000


def weighted_inversions(ranks: np.ndarray, weights: np.ndarray) -> int:
    """The sum of w[i] * w[j] over i < j with ranks[i] > ranks[j]. Ranks are compared by their leading bits: at each bit, within
    groups of equal bits before it, ones before zeros are inversions."""
    total = 0
    wide = float(weights.sum()) ** 2 < 2.0**62
    w = weights.astype(np.int64) if wide else weights.astype(object)
    r = ranks
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        group = r >> (bit + 1)
        one = (r >> bit & 1).astype(bool)
        ones = np.cumsum(np.where(one, w, 0))
        first = np.ones(len(r), bool)
        first[1:] = group[1:] != group[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        before = ones - (ones - np.where(one, w, 0))[start]
        total += int((w * before)[~one].sum())
        order = np.argsort(r >> bit, kind="stable")
        r, w = r[order], w[order]
    return total


def _bucket(column: str, bounds) -> F.Column:
    """Even numbers for values between bounds, odd ones for the bounds themselves."""
    up_to = how_many_up_to(bounds, F.col(column), BUCKETS)
    return (2 * up_to - (F.get(bounds, up_to - 1) == F.col(column)).cast("int")).alias(f"b{column}")


def inversions(pairs: DataFrame) -> int:
    """How many pairs of rows have x < x' and y > y', of distinct (x, y) that occur w times each."""
    pairs = stored(pairs.select("x", "y", "w"), "pairs")
    n = min(BUCKETS, -(-pairs.count() // ROWS))
    shares = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else None
    if shares is None:
        bounds = pairs.sparkSession.range(1).select(*[F.array().cast(f"array<{pairs.schema[c].dataType.simpleString()}>").alias(f"q{c}") for c in "xy"])
    else:
        bounds = pairs.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(c, shares, 20 * n))).alias(f"q{c}") for c in "xy"])
    dealt = pairs.crossJoin(F.broadcast(bounds))  # one row
    dealt = stored(dealt.select("x", "y", "w", *[F.coalesce(_bucket(c, F.col(f"q{c}")), F.lit(0)).alias(f"b{c}") for c in "xy"]), "pair-buckets")
    cells = dealt.groupBy("bx", "by").agg(F.sum("w").alias("w")).toArrow()  # a number a cell
    grid = np.zeros((2 * BUCKETS + 2, 2 * BUCKETS + 2), dtype=object)
    grid[cells.column("bx").to_numpy(), cells.column("by").to_numpy()] = cells.column("w").to_pylist()
    above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]  # at or above this bucket of y
    before = np.cumsum(above, axis=0)
    total = int((grid[1:, :-1] * before[:-1, 1:]).sum())

    def count(key, table):
        import pyarrow as pa

        first, y, w = (table.column(c).to_numpy() for c in ("first", "y", "w"))
        order = np.lexsort((y, first))
        found = weighted_inversions(np.unique(y[order], return_inverse=True)[1], w[order])
        return pa.table({"n": pa.array([str(found)])})

    # in one bucket of x: by x, then y; in one bucket of y and several of x: by the bucket of x, then y
    for own, first in (("bx", "x"), ("by", "bx")):
        rows = dealt.where(f"{own} % 2 = 0").select(own, F.col(first).cast("double").alias("first"), F.col("y").cast("double").alias("y"), "w")
        found = rows.groupBy(own).applyInArrow(count, "n string").agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0]
        total += int(found or 0)
    return total
