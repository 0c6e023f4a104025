"""Kendall's rank correlation from counted inversions (E-06)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.functions.inversions import inversions
from tuyere.functions.storage import stored


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, tau, p over rows complete in both columns (NaN is no value): tau-b, null where a column is constant; p is
    exact for up to 33 rows without ties, as it is with next to no discordant pair, else that of the normal distribution with
    the variance for ties."""
    x, y = (F.col(f"`{c}`").cast("double") for c in (a, b))
    rows = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    pairs = stored(rows.groupBy("x", "y").agg(F.count("*").alias("w")), "kendall")
    ties = []
    for by in (["x", "y"], ["x"], ["y"]):
        k = F.sum("w").cast("decimal(18,0)")
        d = F.col("k").cast("double")
        ties.append(pairs.groupBy(*by).agg(k.alias("k")).agg(F.sum("k").alias("n"), F.sum((F.col("k") * (F.col("k") - 1)).cast("decimal(38,0)")).alias("two"), F.sum(d * (d - 1) * (d - 2)).alias("three"), F.sum(d * (d - 1) * (2 * d + 5)).alias("five")).first())
    n = int(ties[0].n or 0)
    pairs_all = n * (n - 1) // 2
    both, in_x, in_y = (int(t.two or 0) // 2 for t in ties)
    discordant = inversions(pairs) if n > 1 else 0
    s = pairs_all - in_x - in_y + both - 2 * discordant
    spread = (pairs_all - in_x) * (pairs_all - in_y)
    tau = s / math.sqrt(spread) if spread else None
    found = None if tau is None else p_value(n, s, discordant, pairs_all, in_x, in_y, ties[1], ties[2])
    return df.sparkSession.createDataFrame([(a, b, n, tau, found)], "a string, b string, n long, tau double, p double")


def p_value(n: int, s: int, discordant: int, pairs_all: int, in_x: int, in_y: int, x, y) -> float:
    if not in_x and not in_y and (n <= 33 or min(discordant, pairs_all - discordant) <= 1):
        return exact_p(n, min(discordant, pairs_all - discordant))
    m = n * (n - 1.0)
    variance = (m * (2 * n + 5) - x.five - y.five) / 18 + 2.0 * in_x * in_y / m
    if n > 2:
        variance += x.three * y.three / (9 * m * (n - 2))
    return math.erfc(abs(s) / math.sqrt(variance) / math.sqrt(2)) if variance > 0 else 1.0


def exact_p(n: int, c: int) -> float:
    """Twice the share of the orders of n values with at most c inversions, 1 at most."""
    if c <= 1:
        return min(1.0, 2 * (1 if c == 0 else n) / math.factorial(n)) if n < 170 else 0.0
    counts = [1]
    for size in range(2, n + 1):  # the largest value adds 0 to size - 1 inversions
        counts = [sum(counts[max(0, k - size + 1) : k + 1]) for k in range(min(c, size * (size - 1) // 2) + 1)]
    return min(1.0, 2 * sum(counts) / math.factorial(n))
