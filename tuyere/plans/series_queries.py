"""Queries of the series operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.operators import align, impute, outliers, scale
from tuyere.sources.testdata import GAPPY_SQL, SERIES_SQL, gappy, series, table

QUERIES, ORACLE_SQL = {}, {}


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _aligned(method: str, **options):
    return lambda spark, sf: align.align(series(spark, sf), method=method, **options).select("series", "t", *_r("v"), "status", "is_outlier")


H, GAP = align.HOUR, 6 * align.HOUR
_POINTS = f"{SERIES_SQL}, p AS (SELECT series, t, arg_min(v, id) AS v FROM s WHERE v IS NOT NULL GROUP BY 1, 2), e AS (SELECT series, min(t) a, max(t) b FROM p GROUP BY 1), g AS (SELECT series, unnest(range(a, b + 1, {H})) AS t FROM e)"
_BRACKET = f"{_POINTS}, l AS (SELECT g.series, g.t, a.t AS ta, a.v AS va FROM g ASOF LEFT JOIN p a ON g.series = a.series AND g.t >= a.t), k AS (SELECT l.*, b.t AS tb, b.v AS vb FROM l ASOF LEFT JOIN p b ON l.series = b.series AND l.t <= b.t)"
_STATUS = f"CASE WHEN ta = t THEN 'EXACT_MATCH' WHEN ta IS NULL THEN 'BEFORE_FIRST' WHEN tb IS NULL THEN 'AFTER_LAST' WHEN tb - ta > {GAP} THEN 'GAP_TOO_LARGE' ELSE '{{done}}' END"
_FINISH = "SELECT series, t, round(v, 6) AS v, status, coalesce(count(v) OVER w >= 3 AND abs(v - avg(v) OVER w) > 3 * stddev_pop(v) OVER w, false) AS is_outlier FROM i WINDOW w AS (PARTITION BY series)"
_LINEAR = "va + (vb - va) * ((t - ta)::DOUBLE / (tb - ta))"


def _align_sql(value: str, done: str) -> str:
    return f"WITH {_BRACKET}, x AS (SELECT *, {_STATUS.format(done=done)} AS status FROM k), i AS (SELECT series, t, CASE WHEN status = 'EXACT_MATCH' THEN va WHEN status = '{done}' THEN {value} END AS v, status FROM x) {_FINISH}"


QUERIES["align_linear_hourly"] = _aligned("linear")
ORACLE_SQL["align_linear_hourly"] = _align_sql(_LINEAR, "LINEAR_INTERPOLATED")
QUERIES["align_nearest"] = _aligned("nearest")
ORACLE_SQL["align_nearest"] = _align_sql("CASE WHEN t - ta < tb - t THEN va ELSE vb END", "NEAREST_NEIGHBOR")
QUERIES["align_cubic"] = _aligned("cubic")
_X = ["(t0 - ta) / 1e6", "0.0", "(tb - ta) / 1e6", "(t3 - ta) / 1e6"]
_V = ["v0", "va", "vb", "v3"]
_CUBIC = " + ".join(_V[i] + "".join(f" * (((t - ta) / 1e6 - {_X[j]}) / ({_X[i]} - {_X[j]}))" for j in range(4) if j != i) for i in range(4))
ORACLE_SQL["align_cubic"] = (
    f"WITH {_BRACKET}, q AS (SELECT series, t AS ta, lag(t) OVER w AS t0, lag(v) OVER w AS v0, lead(t, 2) OVER w AS t3, lead(v, 2) OVER w AS v3 FROM p WINDOW w AS (PARTITION BY series ORDER BY t)), "
    f"x AS (SELECT k.*, t0, v0, t3, v3, {_STATUS.format(done='CUBIC_INTERPOLATED')} AS status FROM k LEFT JOIN q USING (series, ta)), "
    f"i AS (SELECT series, t, CASE WHEN status = 'EXACT_MATCH' THEN va WHEN status = 'CUBIC_INTERPOLATED' THEN CASE WHEN t0 IS NULL OR t3 IS NULL THEN {_LINEAR} ELSE {_CUBIC} END END AS v, status FROM x) {_FINISH}"
)
for name, method, near, first, last in (("align_ffill", "forward_fill", "a", "ta IS NULL", "BEFORE_FIRST"), ("align_bfill", "backward_fill", "b", "tb IS NULL", "AFTER_LAST")):
    QUERIES[name] = _aligned(method)
    ORACLE_SQL[name] = (
        f"WITH {_BRACKET}, x AS (SELECT *, CASE WHEN ta = t THEN 'EXACT_MATCH' WHEN {first} THEN '{last}' WHEN abs(t - t{near}) > {GAP} THEN 'GAP_TOO_LARGE' ELSE '{method.upper()}ED' END AS status FROM k), "
        f"i AS (SELECT series, t, CASE WHEN status = 'EXACT_MATCH' THEN va WHEN status = '{method.upper()}ED' THEN v{near} END AS v, status FROM x) {_FINISH}"
    )
QUERIES["align_summary"] = lambda spark, sf: align.summary(align.align(series(spark, sf)))
ORACLE_SQL["align_summary"] = f"WITH f AS ({ORACLE_SQL['align_linear_hourly']}) SELECT series, count(*) AS n_points, count(*) FILTER (WHERE status LIKE '%INTERPOLATED%') AS n_interpolated, count(*) - count(v) AS n_missing, count(*) FILTER (WHERE is_outlier) AS n_outliers FROM f GROUP BY 1"
QUERIES["multi_source_offset"] = lambda spark, sf: align.time_offsets(series(spark, sf)).select("series", "n", "lag", *_r("r2"))


def ts_normalize_formats(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 4 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, F.floor(F.unix_micros(t) / 1_000_000).cast("string")).when(F.col("event_id") % 4 == 2, F.floor(F.unix_micros(t) / 1000).cast("string")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    return align.parse_times(table(spark, sf, "events").select("event_id", raw.alias("raw"))).select("event_id", "kind", "t")


QUERIES["ts_normalize_formats"] = ts_normalize_formats
ORACLE_SQL["ts_normalize_formats"] = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ISO_8601' WHEN 1 THEN 'UNIX_S' WHEN 2 THEN 'UNIX_MS' ELSE 'DB_DATETIME' END AS kind, CASE event_id % 4 WHEN 2 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) // 1000000 * 1000000 END AS t FROM events"

_FLAGGED = {
    "zscore": "SELECT *, coalesce(abs(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) > 3, false) AS o FROM s WINDOW w AS (PARTITION BY series)",
    "iqr": "SELECT s.*, coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), false) AS o FROM s JOIN (SELECT series, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 FROM s GROUP BY 1) USING (series)",
    "rolling_mad": "SELECT * EXCLUDE (d, m), coalesce(d > 3 * m, false) AS o FROM (SELECT *, median(d) OVER w AS m FROM (SELECT *, abs(v - median(v) OVER w) AS d FROM s WINDOW w AS (PARTITION BY series ORDER BY t, id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) WINDOW w AS (PARTITION BY series ORDER BY t, id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))",
    "moving_average": "SELECT *, coalesce(abs(v - avg(v) OVER w) > 3 * stddev_samp(v) OVER w, false) AS o FROM s WINDOW w AS (PARTITION BY series ORDER BY t, id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)",
}
for m, sql in _FLAGGED.items():
    QUERIES[f"outlier_{m}"] = lambda spark, sf, m=m: outliers.METHODS[m](series(spark, sf)).select("id", "series", "is_outlier")
    ORACLE_SQL[f"outlier_{m}"] = f"WITH {SERIES_SQL} SELECT id, series, o AS is_outlier FROM ({sql})"
QUERIES["outlier_ewm"] = lambda spark, sf: outliers.exponential(series(spark, sf)).select("id", "series", "is_outlier")
ORACLE_SQL["outlier_ewm"] = f"""WITH RECURSIVE {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, id) AS i FROM s),
    e AS (SELECT series, i, id, v, v::DOUBLE AS num, 1.0::DOUBLE AS den FROM n WHERE i = 1
          UNION ALL SELECT n.series, n.i, n.id, n.v, e.num * 0.7 + n.v, e.den * 0.7 + 1 FROM e JOIN n ON n.series = e.series AND n.i = e.i + 1),
    r AS (SELECT *, abs(v - num / den) AS r FROM e)
    SELECT id, series, coalesce(r > 3 * avg(r) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), false) AS is_outlier FROM r"""
QUERIES["outlier_ensemble"] = lambda spark, sf: outliers.ensemble(series(spark, sf)).select("id", "votes", "is_outlier")
_VOTES = " JOIN ".join(f"(SELECT id, o::INT AS o{k} FROM ({sql})) t{k}" + ("" if k == 0 else " USING (id)") for k, sql in enumerate(_FLAGGED.values()))
ORACLE_SQL["outlier_ensemble"] = f"WITH {SERIES_SQL} SELECT id, o0 + o1 + o2 + o3 AS votes, o0 + o1 + o2 + o3 > 2 AS is_outlier FROM {_VOTES}"
_F = f"{SERIES_SQL}, f AS ({_FLAGGED['iqr']})"
_W5 = "WINDOW w AS (PARTITION BY series ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_REPLACE = {
    "median": "SELECT id, CASE WHEN o THEN x ELSE v END AS fixed FROM f JOIN (SELECT series, median(v) FILTER (WHERE NOT o) AS x FROM f GROUP BY 1) USING (series)",
    "mean": "SELECT id, CASE WHEN o THEN x ELSE v END AS fixed FROM f JOIN (SELECT series, avg(v) FILTER (WHERE NOT o) AS x FROM f GROUP BY 1) USING (series)",
    "clip": "SELECT id, CASE WHEN o THEN greatest(least(v, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) ELSE v END AS fixed FROM f JOIN (SELECT series, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 FROM f GROUP BY 1) USING (series)",
    "rolling_median": f"SELECT id, CASE WHEN o THEN median(CASE WHEN NOT o THEN v END) OVER w ELSE v END AS fixed FROM f {_W5}",
}


def _line_sql(source: str, at: str) -> str:
    return (
        f"n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, id) - 1 AS i FROM ({source})), "
        "b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'i': i, 't': t, 'x': v} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, "
        "first_value(CASE WHEN v IS NOT NULL THEN {'i': i, 't': t, 'x': v} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM n WINDOW w AS (PARTITION BY series ORDER BY t, id)), "
        f"y AS (SELECT *, coalesce(v, p.x + (q.x - p.x) * coalesce((({at} - p.{at})::DOUBLE / nullif(q.{at} - p.{at}, 0)), 0), p.x, q.x) AS line FROM b)"
    )


_REPLACE["interpolation"] = f"WITH {_line_sql('SELECT id, series, t, CASE WHEN NOT o THEN v END AS v FROM f', 'i')} SELECT id, CASE WHEN o THEN line ELSE f.v END AS fixed FROM f JOIN (SELECT id, line FROM y) USING (id)"
for m, sql in _REPLACE.items():
    QUERIES[f"outlier_replace_{m}"] = lambda spark, sf, m=m: outliers.replace(outliers.iqr(series(spark, sf)), m).select("id", *_r("fixed"))
    ORACLE_SQL[f"outlier_replace_{m}"] = f"WITH {_F} SELECT id, round(fixed, 6) AS fixed FROM ({sql})"
QUERIES["outlier_stats"] = lambda spark, sf: outliers.statistics(outliers.iqr(series(spark, sf))).select("series", "n", "n_outliers", *_r("rate", "out_mean", "out_std", "out_min", "out_max", "in_mean", "in_std", "in_min", "in_max"))
ORACLE_SQL["outlier_stats"] = f"WITH {_F} SELECT series, count(*) AS n, count(*) FILTER (WHERE o) AS n_outliers, round(avg(o::INT), 6) AS rate, " + ", ".join(f"round({f}(v) FILTER (WHERE {'o' if k == 'out' else 'NOT o'}), 6) AS {k}_{a}" for k in ("out", "in") for a, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM f GROUP BY series"
QUERIES["rolling_stats"] = lambda spark, sf: outliers.rolling(series(spark, sf)).select("id", *_r("roll_mean", "roll_std", "roll_median"))
ORACLE_SQL["rolling_stats"] = f"WITH {SERIES_SQL} SELECT id, " + ", ".join(f"CASE WHEN count(v) OVER w = 5 THEN round({f}(v) OVER w, 6) END AS roll_{n}" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"))) + f" FROM s {_W5}"

_FILL = {
    "linear": ("i", "line"),
    "time": ("t", "line"),
    "nearest": ("i", "CASE WHEN v IS NOT NULL THEN v WHEN p IS NOT NULL AND q IS NOT NULL THEN CASE WHEN i - p.i <= q.i - i THEN p.x ELSE q.x END END"),
    "ffill": ("i", "p.x"),
    "bfill": ("i", "q.x"),
    "kalman": ("i", "avg(line) OVER (PARTITION BY series ORDER BY t, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
}
for m, (at, value) in _FILL.items():
    QUERIES[f"impute_{m}"] = lambda spark, sf, m=m: impute.METHODS[m](gappy(spark, sf)).select("id", *_r("filled"))
    ORACLE_SQL[f"impute_{m}"] = f"WITH {GAPPY_SQL}, {_line_sql('SELECT * FROM s', at)} SELECT id, round({value}, 6) AS filled FROM y"
for m, stat in (("mean", "avg(v) OVER w"), ("median", "median(v) OVER w")):
    QUERIES[f"impute_{m}"] = lambda spark, sf, m=m: impute.fill_statistic(gappy(spark, sf), m).select("id", *_r("filled"))
    ORACLE_SQL[f"impute_{m}"] = f"WITH {GAPPY_SQL} SELECT id, round(coalesce(v, {stat}), 6) AS filled FROM s WINDOW w AS (PARTITION BY series)"
QUERIES["impute_mode"] = lambda spark, sf: impute.fill_statistic(gappy(spark, sf).withColumn("v", F.floor("v").cast("double")), "mode").select("id", "filled")
ORACLE_SQL["impute_mode"] = f"WITH {GAPPY_SQL}, c AS (SELECT series, floor(v) AS v, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY 1, 2), m AS (SELECT series, arg_min(v, (-n, v)) AS x FROM c GROUP BY 1) SELECT id, coalesce(floor(v), x) AS filled FROM s JOIN m USING (series)"
QUERIES["impute_stats"] = lambda spark, sf: impute.fill_statistics(impute.fill_linear(gappy(spark, sf))).select("series", "n_filled", *_r("rate", "mean", "std", "least", "largest"))
ORACLE_SQL["impute_stats"] = f"WITH {GAPPY_SQL}, {_line_sql('SELECT * FROM s', 'i')}, z AS (SELECT series, CASE WHEN v IS NULL THEN line END AS x FROM y) SELECT series, count(x) AS n_filled, round(count(x) / count(*), 6) AS rate, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS largest FROM z GROUP BY 1"

# the same with a series without a name, and values that are not numbers
_ODD = "s AS (SELECT CASE WHEN event_type <> (SELECT min(event_type) FROM events) THEN event_type ELSE '?' END AS series, epoch_us(ts) AS t, event_id AS id, CASE WHEN event_id % 89 <> 7 THEN value END AS v FROM events)"


def odd_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = series(spark, sf)
    first = rows.agg(F.min("series").alias("first"))  # one row
    return rows.crossJoin(F.broadcast(first)).select(F.when(F.col("series") != F.col("first"), F.col("series")).alias("series"), "t", "id", F.when(F.col("id") % 89 != 7, F.col("v")).otherwise(float("nan")).alias("v"))


QUERIES["odd_zscore"] = lambda spark, sf: outliers.zscore(odd_series(spark, sf)).select("id", "series", "is_outlier")
QUERIES["odd_ensemble"] = lambda spark, sf: outliers.ensemble(odd_series(spark, sf)).select("id", "series", "votes", "is_outlier")
QUERIES["odd_mean_fill"] = lambda spark, sf: impute.fill_statistic(odd_series(spark, sf), "mean").select("id", *_r("filled"))
QUERIES["odd_align"] = lambda spark, sf: align.align(odd_series(spark, sf)).select("series", "t", *_r("v"), "status", "is_outlier")
QUERIES["odd_scale_grouped"] = lambda spark, sf: scale.within_groups(odd_series(spark, sf), ["series"], "v").select("id", *_r("scaled"))
_NAMED = "nullif(series, '?') AS series"
ORACLE_SQL["odd_zscore"] = f"WITH {_ODD} SELECT id, {_NAMED}, o AS is_outlier FROM ({_FLAGGED['zscore']})"
ORACLE_SQL["odd_ensemble"] = f"SELECT id, {_NAMED}, votes, is_outlier FROM ({ORACLE_SQL['outlier_ensemble'].replace(SERIES_SQL, _ODD)}) JOIN (SELECT event_id AS id, CASE WHEN event_type <> (SELECT min(event_type) FROM events) THEN event_type ELSE '?' END AS series FROM events) USING (id)"
ORACLE_SQL["odd_mean_fill"] = f"WITH {_ODD} SELECT id, round(coalesce(v, avg(v) OVER (PARTITION BY series)), 6) AS filled FROM s"
ORACLE_SQL["odd_align"] = f"SELECT {_NAMED}, t, v, status, is_outlier FROM ({ORACLE_SQL['align_linear_hourly'].replace(SERIES_SQL, _ODD)})"
ORACLE_SQL["odd_scale_grouped"] = f"WITH {_ODD} SELECT id, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 6) AS scaled FROM s WINDOW w AS (PARTITION BY series)"
