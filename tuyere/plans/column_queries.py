"""Queries of the operators on several columns, on vectors and on curves, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.operators import concordance, impute_columns, outliers, smoothing
from tuyere.sources.testdata import GAPPY_SQL, gappy, table

QUERIES, ORACLE_SQL = {}, {}


def _r(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


#: Four figures of each part's line items, of which the key decides what is missing.
_GAPS = {"a": ("avg(l_quantity) / 50", "l_partkey % 7 <> 1"), "b": ("avg(l_extendedprice) / 100000", "l_partkey % 5 <> 2"), "c": ("10 * avg(l_discount)", "l_partkey % 11 <> 3 and l_partkey % 10 <> 2"), "d": ("count(*) / 30", "l_partkey % 13 <> 4")}
COLUMNS = list(_GAPS)


def figures(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_partkey").agg(*[F.expr(v).cast("double").alias(c) for c, (v, _) in _GAPS.items()])
    return rows.select(F.col("l_partkey").alias("id"), *[F.when(F.expr(known), F.col(c)).alias(c) for c, (_, known) in _GAPS.items()])


_FIGURES = "w AS (SELECT l_partkey AS id, " + ", ".join(f"CASE WHEN {known} THEN ({value})::DOUBLE END AS {c}" for c, (value, known) in _GAPS.items()) + " FROM lineitem GROUP BY l_partkey)"

for name, weights in (("impute_knn", "uniform"), ("impute_knn_distance", "distance")):
    QUERIES[name] = lambda spark, sf, weights=weights: impute_columns.fill_from_nearest(figures(spark, sf), "id", COLUMNS, 5, weights).select("id", *_r(*COLUMNS))
    _n = " + ".join(f"(x.{c} IS NOT NULL AND y.{c} IS NOT NULL)::INT" for c in COLUMNS)
    _s = " + ".join(f"coalesce((x.{c} - y.{c}) * (x.{c} - y.{c}), 0)" for c in COLUMNS)
    _near = " UNION ALL ".join(f"SELECT x.id, '{c}' AS c, y.id AS j, y.{c} AS v, sqrt(4.0::DOUBLE / nullif({_n}, 0) * ({_s})) AS d FROM w x, w y WHERE x.{c} IS NULL AND y.{c} IS NOT NULL" for c in COLUMNS)
    _mean = "avg(v)" if weights == "uniform" else "CASE WHEN min(d) = 0 THEN avg(v) FILTER (d = 0) ELSE sum(v / d) / sum(1 / d) END"
    ORACLE_SQL[name] = (
        f"WITH {_FIGURES}, p AS ({_near}), k AS (SELECT *, row_number() OVER (PARTITION BY id, c ORDER BY d, j) AS r FROM p WHERE d IS NOT NULL), f AS (SELECT id, c, {_mean} AS v FROM k WHERE r <= 5 GROUP BY 1, 2) "
        "SELECT id, " + ", ".join(f"round(coalesce({c}, (SELECT v FROM f WHERE f.id = w.id AND f.c = '{c}'), (SELECT avg({c}) FROM w)), 6) AS {c}" for c in COLUMNS) + " FROM w"
    )

ROUNDS, THREE = 3, ["a", "b", "c"]
QUERIES["impute_mice"] = lambda spark, sf: impute_columns.fill_by_equations(figures(spark, sf).select("id", *THREE), "id", THREE, rounds=ROUNDS, tolerance=0.0, estimator="linear")[0].select("id", *_r(*THREE))
_STATES, _last = [], 0
for _ in range(ROUNDS):
    for y in ("a", "c", "b"):  # by number of gaps
        u, v = (c for c in THREE if c != y)
        det = f"(var_pop({u}) * var_pop({v}) - covar_pop({u}, {v}) * covar_pop({u}, {v}))"
        slope = lambda p, q: f"(covar_pop({p}, {y}) * var_pop({q}) - covar_pop({q}, {y}) * covar_pop({u}, {v})) / {det}"  # noqa: B023, E731
        _STATES.append(
            f"s{_last + 1} AS MATERIALIZED (SELECT id, ga, gb, gc, {u}, {v}, CASE WHEN g{y} THEN my + wu * ({u} - mu) + wv * ({v} - mv) ELSE {y} END AS {y} "
            f"FROM s{_last}, (SELECT avg({y}) AS my, avg({u}) AS mu, avg({v}) AS mv, {slope(u, v)} AS wu, {slope(v, u)} AS wv FROM s{_last} WHERE NOT g{y}))"
        )
        _last += 1
ORACLE_SQL["impute_mice"] = (
    f"WITH {_FIGURES}, s0 AS (SELECT id, a IS NULL AS ga, b IS NULL AS gb, c IS NULL AS gc, " + ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM w)) AS {c}" for c in THREE) + f" FROM w), {', '.join(_STATES)} "
    f"SELECT id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM s{_last}"
)
QUERIES["impute_mice_forest"] = lambda spark, sf: impute_columns.fill_by_equations(figures(spark, sf), "id", COLUMNS, rounds=2, trees=20)[0].select("id", *_r(*COLUMNS))

QUERIES["lof_scores"] = lambda spark, sf: outliers.local_outlier_factor(table(spark, sf, "embeddings"), "vec_id", "embedding", 10).select("vec_id", *_r("lof", digits=4))
_LOF = (
    "WITH p AS (SELECT vec_id AS i, embedding::DOUBLE[] AS x, min(vec_id) OVER (PARTITION BY embedding) AS l FROM embeddings WHERE embedding IS NOT NULL), "
    "near AS (SELECT a.i, b.i AS j, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.x, b.x), b.l, b.i) AS r FROM p a JOIN p b ON a.i <> b.i QUALIFY r <= 10), "
    "k AS (SELECT i AS j, max(d) AS kd FROM near GROUP BY 1), l AS (SELECT i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN k USING (j) GROUP BY 1), "
    "f AS (SELECT near.i AS vec_id, avg(o.lrd) / any_value(m.lrd) AS lof FROM near JOIN l o ON near.j = o.i JOIN l m ON near.i = m.i GROUP BY 1)"
)
ORACLE_SQL["lof_scores"] = f"{_LOF} SELECT vec_id, round(lof, 4) AS lof FROM f"
QUERIES["lof_outliers"] = lambda spark, sf: outliers.lof_outliers(table(spark, sf, "embeddings"), "vec_id", "embedding", 10, 0.05).select("vec_id", "is_outlier")
ORACLE_SQL["lof_outliers"] = f"{_LOF} SELECT vec_id, lof > (SELECT quantile_cont(lof, 0.95) FROM f) AS is_outlier FROM f"

_items = lambda spark, sf: table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount"), F.col("l_quantity").cast("double").alias("quantity"))
#: Nearly all prices differ, so all pairs of their values would be the square of the rows; the twin counts the other way round,
#: by the few discounts.
QUERIES["corr_kendall_price"] = lambda spark, sf: concordance.kendall(_items(spark, sf), "price", "discount").select("a", "b", "n", *_r("tau"), *_r("p", digits=4))
ORACLE_SQL["corr_kendall_price"] = (
    "WITH c AS (SELECT l_extendedprice::DOUBLE AS x, l_discount::DOUBLE AS y, count(*) AS w FROM lineitem GROUP BY 1, 2), ys AS (SELECT DISTINCT y FROM c), "
    "g AS (SELECT c.x, ys.y, sum(c.w) FILTER (c.y = ys.y) AS own, sum(c.w) FILTER (c.y > ys.y) AS above FROM c, ys GROUP BY 1, 2), "
    "o AS (SELECT y, own, sum(above) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g), "
    "e AS (SELECT sum(own::DOUBLE * before) AS discordant FROM o), n AS (SELECT sum(w)::DOUBLE AS n, sum(w * (w - 1.0)) / 2 AS b FROM c), "
    "tx AS (SELECT sum(k * (k - 1.0)) / 2 AS t, sum(k * (k - 1.0) * (k - 2)) AS t3, sum(k * (k - 1.0) * (2 * k + 5)) AS t5 FROM (SELECT sum(w)::DOUBLE AS k FROM c GROUP BY x)), "
    "ty AS (SELECT sum(k * (k - 1.0)) / 2 AS t, sum(k * (k - 1.0) * (k - 2)) AS t3, sum(k * (k - 1.0) * (2 * k + 5)) AS t5 FROM (SELECT sum(w)::DOUBLE AS k FROM c GROUP BY y)), "
    "s AS (SELECT n, n * (n - 1) / 2 AS pairs, n * (n - 1) / 2 - tx.t - ty.t + b - 2 * discordant AS s, tx.t AS tx, ty.t AS ty, "
    "(n * (n - 1) * (2 * n + 5) - tx.t5 - ty.t5) / 18 + 2 * tx.t * ty.t / (n * (n - 1)) + tx.t3 * ty.t3 / (9 * n * (n - 1) * (n - 2)) AS var FROM e, n, tx, ty), "
    # the complementary error function, by a rational approximation with an error below 1.2e-7 in proportion
    "z AS (SELECT *, abs(s) / sqrt(2 * var) AS z, 1 / (1 + 0.5 * abs(s) / sqrt(2 * var)) AS t FROM s) "
    "SELECT 'price' AS a, 'discount' AS b, n::BIGINT AS n, round(s / sqrt((pairs - tx) * (pairs - ty)), 6) AS tau, "
    "round(t * exp(-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))), 4) AS p FROM z"
)

QUERIES["lowess"] = lambda spark, sf: smoothing.lowess(_items(spark, sf), "quantity", "price", 0.3, 3).select("x", *_r("fitted", digits=3))
_FITS = []
for _k in range(4):
    _rows = "r" if not _k else f"(SELECT x, y, CASE WHEN off < 6 * med THEN (1 - (off / (6 * med)) ** 2) ** 2 ELSE 0 END AS w FROM (SELECT x, y, off, median(off) OVER () AS med FROM (SELECT x, y, abs(y - fitted) AS off FROM r JOIN f{_k - 1} USING (x))))"
    _FITS.append(
        f"f{_k} AS MATERIALIZED (SELECT a AS x, CASE WHEN s * sxx - sx * sx > 1e-12 * s * sxx THEN (sxx * sy - sx * sxy) / (s * sxx - sx * sx) ELSE sy / s END AS fitted FROM (SELECT a, sum(w) AS s, sum(w * d) AS sx, sum(w * d * d) AS sxx, sum(w * y) AS sy, sum(w * y * d) AS sxy "
        f"FROM (SELECT a, x - a AS d, y, w * (1 - (abs(x - a) / h) ** 3) ** 3 AS w FROM {_rows} q JOIN h ON abs(x - a) < h) GROUP BY a))"
    )
ORACLE_SQL["lowess"] = (
    "WITH r AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, 1.0::DOUBLE AS w FROM lineitem), k AS (SELECT floor(0.3 * count(*) + 1e-10)::BIGINT AS k FROM r), c AS (SELECT x, count(*) AS n FROM r GROUP BY x), "
    "g AS (SELECT a.x AS a, abs(b.x - a.x) AS d, sum(b.n) OVER (PARTITION BY a.x ORDER BY abs(b.x - a.x) RANGE UNBOUNDED PRECEDING) AS upto FROM c a, c b), "
    f"h AS (SELECT a, min(d) AS h FROM g, k WHERE upto >= k GROUP BY a), {', '.join(_FITS)} SELECT x, round(fitted, 3) AS fitted FROM f3"
)

QUERIES["impute_spline_global"] = lambda spark, sf: smoothing.fill_spline(gappy(spark, sf)).select("id", *_r("filled"))
ORACLE_SQL["impute_spline_global"] = f"""WITH RECURSIVE {GAPPY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, id) - 1 AS i FROM s),
    k AS (SELECT series, i, v, row_number() OVER w - 1 AS j, i - lag(i) OVER w AS h0, lead(i) OVER w - i AS h1, (v - lag(v) OVER w) / (i - lag(i) OVER w) AS s0, (lead(v) OVER w - v) / (lead(i) OVER w - i) AS s1 FROM n WHERE v IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY i)),
    l AS MATERIALIZED (SELECT series, list({{'a': h0 / 6.0::DOUBLE, 'b': (h0 + h1) / 3.0::DOUBLE, 'c': h1 / 6.0::DOUBLE, 'd': s1 - s0}} ORDER BY j) AS x FROM k GROUP BY series),
    down AS (SELECT series, 0::BIGINT AS j, 0.0::DOUBLE AS cp, 0.0::DOUBLE AS dp FROM l
             UNION ALL SELECT series, j + 1, coalesce(y.c / (y.b - y.a * cp), 0), coalesce((y.d - y.a * dp) / (y.b - y.a * cp), 0) FROM (SELECT down.series, down.j, cp, dp, l.x[down.j + 2] AS y FROM down JOIN l USING (series) WHERE down.j + 1 < len(l.x))),
    e0 AS MATERIALIZED (SELECT series, list({{'c': cp, 'd': dp}} ORDER BY j) AS z FROM down GROUP BY series),
    up AS (SELECT series, len(z) - 1 AS j, 0.0::DOUBLE AS m FROM e0
           UNION ALL SELECT series, j - 1, y.d - y.c * m FROM (SELECT up.series, up.j, m, e0.z[up.j] AS y FROM up JOIN e0 USING (series) WHERE up.j > 0)),
    p AS (SELECT k.series, k.i, k.v, up.m, k.j, max(k.j) OVER (PARTITION BY k.series) AS last FROM k JOIN up ON k.series = up.series AND k.j = up.j),
    e AS (SELECT series, i, v, m, lead(i) OVER w AS i1, lead(v) OVER w AS v1, lead(m) OVER w AS m1, j, last FROM p WINDOW w AS (PARTITION BY series ORDER BY j)),
    x AS (SELECT n.id, n.v AS own, n.i AS here, e.*, f.i AS fi, f.v AS fv, (f.v1 - f.v) / (f.i1 - f.i) - (f.i1 - f.i) / 6.0 * (2 * f.m + f.m1) AS fs,
                 (q.v1 - q.v) / (q.i1 - q.i) + (q.i1 - q.i) / 6.0 * (q.m + 2 * q.m1) AS ls
          FROM n ASOF LEFT JOIN e ON n.series = e.series AND n.i >= e.i LEFT JOIN e f ON f.series = n.series AND f.j = 0 LEFT JOIN e q ON q.series = n.series AND q.j = q.last - 1)
    SELECT id, round(CASE WHEN own IS NOT NULL THEN own WHEN i IS NULL THEN fv - (fi - here) * fs WHEN i1 IS NULL THEN v + (here - i) * ls
        ELSE ((here - i) * v1 + (i1 - here) * v) / (i1 - i) - (here - i) * (i1 - here) / 6.0 * ((1 + (here - i) / (i1 - i)) * m1 + (1 + (i1 - here) / (i1 - i)) * m) END, 6) AS filled FROM x"""
QUERIES["impute_spline"], ORACLE_SQL["impute_spline"] = QUERIES["impute_spline_global"], ORACLE_SQL["impute_spline_global"]
