"""Fills of several columns at a time: nearest rows and chained equations (C-12, C-13). Rows are (id, numeric columns...)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.nearest import nearest
from tuyere.functions.storage import stored

#: Pairs of patterns of known columns, each with a column to fill, that are searched apart.
SPACES = 20_000


def known_values(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as doubles; NaN is no value."""
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    return [F.when(~F.isnan(v), v) for v in values]


def _spaces(patterns: list[int], n: int) -> list[tuple[str, int, int, int, int]]:
    """(space, pattern of the row to fill, pattern of the row to fill from, column, columns that both know)."""
    out = []
    for want in patterns:
        for c in range(n):
            if not want >> c & 1:
                out += [(f"{want}:{c}:{want & have}", want, have, c, want & have) for have in patterns if have >> c & 1 and want & have]
    return out


def fill_from_nearest(df: DataFrame, id_col: str, columns: list[str], k: int = 5, weights: str = "uniform") -> DataFrame:
    """df with the gaps of the columns filled by the mean of the k nearest rows that know the column (by distance weights: the
    nearer count more, and rows at no distance alone). Distances are Euclidean over the columns that both rows know, scaled to
    all columns; equal ones go by id. A row that shares no known column with any such row gets the column's mean.

    Rows fall into patterns of known columns. Each (pattern with a gap, column to fill, columns known to both) is a space of its
    own for the exact search in cells, so rows with gaps give to each other as well as whole rows do. Equal rows are searched
    once, and of equal givers only the k first are kept, which are the only ones that can count. Ids must be unique."""
    n = len(columns)
    values = known_values(df, columns)
    mask = sum((F.when(v.isNotNull(), 1 << k).otherwise(0) for k, v in enumerate(values)), F.lit(0))
    rows = stored(df.select(F.col(f"`{id_col}`").alias("id"), mask.alias("mask"), F.array(*values).alias("v")), "knn-rows")
    patterns = [r.mask for r in rows.select("mask").distinct().limit(SPACES).collect()]
    spaces = _spaces(sorted(patterns), n)
    if len(spaces) > SPACES:
        raise ValueError("too many patterns of gaps; fill fewer columns at a time")
    means = df.agg(*[F.avg(v).alias(f"m{k}") for k, v in enumerate(values)])  # one row
    found = None
    if spaces:
        table = df.sparkSession.createDataFrame(spaces, "space string, want int, have int, c int, both int")
        asks = rows.join(F.broadcast(table.select("space", "want", "c", "both").distinct()), F.col("mask") == F.col("want")).select("space", "id", "c", "both", _masked().alias("x"))
        asks = stored(asks, "knn-asks")
        gives = rows.join(F.broadcast(table), F.col("mask") == F.col("have")).select("space", F.col("id").alias("i"), _masked().alias("x"), F.get("v", F.col("c")).alias("y"))
        gives = gives.withColumn("r", F.row_number().over(Window.partitionBy("space", "x").orderBy("i"))).where(F.col("r") <= k).drop("r")
        gives = stored(gives, "knn-gives")
        queries = stored(asks.groupBy("space", "x").agg(F.min("id").alias("q")), "knn-queries")
        near = nearest(queries, gives.select("space", "i", "x"), k).join(gives.select("space", "i", "y"), ["space", "i"])
        of_query = stored(near.groupBy("space", "q").agg(F.collect_list(F.struct("d", "i", "y")).alias("near")), "knn-near")  # no more than k
        of_rows = asks.join(queries, ["space", "x"]).join(of_query, ["space", "q"])
        scale = F.sqrt(F.lit(float(n)) / F.bit_count("both"))
        best = of_rows.select("id", "c", F.transform("near", lambda e: F.struct((e["d"] * scale).alias("d"), e["i"].alias("i"), e["y"].alias("y"))).alias("near"))
        best = best.groupBy("id", "c").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # k for each pattern
        at = lambda e: F.when(F.get("near", F.lit(0))["d"] > 0, 1 / e["d"]).otherwise((e["d"] == 0).cast("double"))
        weight = at if weights == "distance" else lambda e: F.lit(1.0)
        total = lambda f: F.aggregate("near", F.lit(0.0), lambda s, e: s + f(e))
        filled = best.select("id", "c", (total(lambda e: weight(e) * e["y"]) / total(weight)).alias("y"))
        found = filled.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "y"))).alias("_found"))
    out = df.crossJoin(F.broadcast(means))
    if found is None:
        out = out.withColumn("_found", F.lit(None).cast("map<int,double>"))
    else:
        out = out.join(found.withColumnRenamed("id", "_id"), F.col(f"`{id_col}`") == F.col("_id"), "left").drop("_id")
    for k_, (c, v) in enumerate(zip(columns, values, strict=True)):
        out = out.withColumn(c, F.coalesce(v, F.try_element_at("_found", F.lit(k_)), F.col(f"m{k_}")))
    return out.select(*[f"`{c}`" for c in df.columns])


def _masked() -> Column:
    """The values of the columns that both know; others are 0 on either side and do not add to a distance."""
    return F.transform("v", lambda x, j: F.when(F.expr("both").bitwiseAND(F.pow(F.lit(2), j).cast("int")) > 0, x).otherwise(0.0))


def fill_by_equations(df: DataFrame, id_col: str, columns: list[str], rounds: int = 10, tolerance: float = 1e-3, estimator: str = "forest", trees: int = 100, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """df with the gaps of the columns filled by chained equations, and the largest change of each round.

    Gaps start at their column's mean. In each round every column with gaps, those with fewer first, is regressed on all the
    others over the rows that know it, and its gaps get the prediction. Rounds end when no gap moves by more than ``tolerance``
    times the largest known value. Estimators: "forest", regression trees of Spark; "linear", least squares from one
    aggregation of means and covariances. Each column's state is stored, so that no round computes the ones before it again."""
    values = known_values(df, columns)
    own = [f"x{k}" for k in range(len(columns))]
    gaps = [f"g{k}" for k in range(len(columns))]
    first = df.select(F.col(f"`{id_col}`").alias("id"), *[v.alias(c) for v, c in zip(values, own, strict=True)])
    sums = first.agg(*[f(c).alias(f"{n}{c}") for c in own for n, f in (("n", lambda c: F.count_if(F.col(c).isNull())), ("m", F.avg), ("a", lambda c: F.max(F.abs(F.col(c)))))]).first()
    order = sorted((k for k, c in enumerate(own) if sums[f"n{c}"] and sums[f"m{c}"] is not None), key=lambda k: (sums[f"n{own[k]}"], k))
    largest = max([sums[f"a{own[k]}"] for k in range(len(own)) if sums[f"a{own[k]}"] is not None], default=0.0)
    state = stored(first.select("id", *[F.coalesce(c, F.lit(sums[f"m{c}"]).cast("double")).alias(c) for c in own], *[F.col(c).isNull().alias(g) for c, g in zip(own, gaps, strict=True)]), "mice")
    predictors = [c for c in own if sums[f"m{c}"] is not None]
    changes: list[float] = []
    for _ in range(rounds if len(predictors) > 1 else 0):
        moved = 0.0
        for k in order:
            others = [c for c in predictors if c != own[k]]
            if estimator == "linear":
                new = _least_squares(state.where(~F.col(gaps[k])), own[k], others)
                state = state.withColumn("_new", new)
            else:
                from pyspark.ml.feature import VectorAssembler
                from pyspark.ml.regression import RandomForestRegressor

                rows = VectorAssembler(inputCols=others, outputCol="_in").transform(state)
                model = RandomForestRegressor(featuresCol="_in", labelCol=own[k], predictionCol="_new", numTrees=trees, maxDepth=10, seed=seed).fit(rows.where(~F.col(gaps[k])))
                state = model.transform(rows).drop("_in")
            state = state.withColumn("_was", F.col(own[k])).withColumn(own[k], F.when(F.col(gaps[k]), F.col("_new")).otherwise(F.col(own[k])))
            state = stored(state.drop("_new"), "mice")
            moved = max(moved, state.agg(F.max(F.abs(F.col(own[k]) - F.col("_was")))).first()[0] or 0.0)
            state = state.drop("_was")
        changes.append(moved)
        if moved <= tolerance * largest:
            break
    filled = state.select(F.col("id").alias("_id"), *own)
    joined = df.join(filled, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")))
    return joined.select(*[F.coalesce(values[columns.index(c)], F.col(own[columns.index(c)])).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]), changes


def _least_squares(rows: DataFrame, y: str, others: list[str]) -> Column:
    names = [*others, y]
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    s = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    cov = {**{(a, b): s[f"{a}_{b}"] for a, b in pairs}, **{(b, a): s[f"{a}_{b}"] for a, b in pairs}}
    slopes = np.linalg.lstsq(np.array([[cov[a, b] for b in others] for a in others]), np.array([cov[a, y] for a in others]), rcond=1e-12)[0]
    return sum((F.lit(float(w)) * (F.col(c) - F.lit(s[f"m_{c}"])) for w, c in zip(slopes, others, strict=True)), F.lit(s[f"m_{y}"]))
