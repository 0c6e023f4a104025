"""Queries of the scaling, statistics, dictionary, graph, mapping and metric operators, with their SQL twins.

The dictionary's five levels are played by the parts: type, type and brand, size class, name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.functions import names
from tuyere.functions.storage import stored
from tuyere.operators import concordance, dictionary, graph, imports, impute, knowledge, mapping, metrics, retrieval, scale, stats
from tuyere.sources import catalog
from tuyere.sources.testdata import SERIES_SQL, series, table

QUERIES, ORACLE_SQL = {}, {}
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in NUMBERS])


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_type").alias("work_type"), F.concat_ws(" - ", "p_type", "p_brand").alias("category"), F.concat(F.lit("size "), (F.col("p_size") % 10).cast("string")).alias("pool"), F.col("p_name").alias("dataset"), F.col("p_partkey").alias("ordinal"))


PARTS = "d AS (SELECT p_type AS work_type, p_type || ' - ' || p_brand AS category, 'size ' || (p_size % 10) AS pool, p_name AS dataset, p_partkey AS ordinal FROM part)"
KEY = "l_orderkey, l_linenumber"

# scaling
_STATS = {
    "zscore": lambda c: (f"avg({c})", f"stddev_samp({c})"),
    "minmax": lambda c: (f"min({c})", f"max({c}) - min({c})"),
    "robust": lambda c: (f"quantile_cont({c}, 0.5)", f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "mad": lambda c: (f"median({c})", f"mad({c})"),
}
for m, ab in _STATS.items():
    QUERIES[f"scale_{m}"] = lambda spark, sf, m=m: scale.apply(_items(spark, sf), scale.parameters(_items(spark, sf), NUMBERS, m), NUMBERS).select("l_orderkey", "l_linenumber", *_r(*NUMBERS))
    ORACLE_SQL[f"scale_{m}"] = f"WITH i AS (SELECT {KEY}, {', '.join(f'{c}::DOUBLE AS {c}' for c in NUMBERS)} FROM lineitem), p AS (SELECT {', '.join(f'{ab(c)[0]} AS a{k}, coalesce(nullif({ab(c)[1]}, 0), 1) AS b{k}' for k, c in enumerate(NUMBERS))} FROM i) SELECT {KEY}, {', '.join(f'round(({c} - a{k}) / b{k}, 6) AS {c}' for k, c in enumerate(NUMBERS))} FROM i, p"


def scale_inverse(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    p = scale.parameters(items, NUMBERS, "robust")
    return scale.apply(scale.apply(items, p, NUMBERS), p, NUMBERS, inverse=True).select("l_orderkey", "l_linenumber", *_r(*NUMBERS, digits=4))


QUERIES["scale_inverse"] = scale_inverse
ORACLE_SQL["scale_inverse"] = f"SELECT {KEY}, {', '.join(f'round({c}::DOUBLE, 4) AS {c}' for c in NUMBERS)} FROM lineitem"
QUERIES["scale_log"] = lambda spark, sf: scale.log_scale(scale.log_scale(_items(spark, sf), "l_extendedprice"), "l_discount").select("l_orderkey", "l_linenumber", *_r("l_extendedprice", "l_discount"))
ORACLE_SQL["scale_log"] = f"SELECT {KEY}, round(ln(l_extendedprice::DOUBLE), 6) AS l_extendedprice, round(ln(1 + greatest(l_discount::DOUBLE, 1e-10)), 6) AS l_discount FROM lineitem"
QUERIES["scale_grouped"] = lambda spark, sf: scale.within_groups(series(spark, sf), ["series"], "v").select("id", *_r("scaled"))
ORACLE_SQL["scale_grouped"] = f"WITH {SERIES_SQL} SELECT id, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 6) AS scaled FROM s WINDOW w AS (PARTITION BY series)"
QUERIES["scale_quantile"] = lambda spark, sf: scale.quantile_scale(_items(spark, sf), "l_extendedprice").select("l_orderkey", "l_linenumber", *_r("scaled"))
_POINTS = "(SELECT least(1000, count(x)) AS m FROM i)"
_Q1000 = f"WITH i AS (SELECT {KEY}, l_extendedprice::DOUBLE AS x FROM lineitem), m AS {_POINTS}, g AS (SELECT unnest(range(m)) AS k, m FROM m), a AS (SELECT list(x ORDER BY x) AS xs, count(*) AS n FROM i), "
_Q1000 += "q AS (SELECT k, m, xs[floor(k::DOUBLE / (m - 1) * (n - 1))::BIGINT + 1] + (xs[least(n, floor(k::DOUBLE / (m - 1) * (n - 1))::BIGINT + 2)] - xs[floor(k::DOUBLE / (m - 1) * (n - 1))::BIGINT + 1]) * (k::DOUBLE / (m - 1) * (n - 1) - floor(k::DOUBLE / (m - 1) * (n - 1))) AS v FROM g, a), "
_Q1000 += "s AS (SELECT v, min(k) AS lo, max(k) AS hi, any_value(m) AS m FROM q GROUP BY v), t AS (SELECT *, lead(v) OVER (ORDER BY v) AS v2, lead(lo) OVER (ORDER BY v) AS lo2, row_number() OVER (ORDER BY v) AS place FROM s) "
ORACLE_SQL["scale_quantile"] = _Q1000 + f"SELECT {KEY}, round(CASE WHEN place = 1 AND v = x THEN 0 WHEN v2 IS NULL THEN m - 1 WHEN v = x THEN (lo + hi) / 2.0::DOUBLE ELSE hi + (lo2 - hi) * (x - v) / (v2 - v) END / (m - 1), 6) AS scaled FROM i ASOF JOIN t ON i.x >= t.v"
QUERIES["scale_yeo_johnson"] = lambda spark, sf: scale.yeo_johnson(_items(spark, sf), "l_extendedprice")[0].select("l_orderkey", "l_linenumber", *_r("scaled", digits=3))

# statistics
_MOMENTS = "count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, avg((x - m) ** 3) / nullif(stddev_pop(x) ** 3, 0) AS skew, avg((x - m) ** 4) / nullif(var_pop(x) ** 2, 0) - 3 AS kurt"
_LONG = "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS param, {c}::DOUBLE AS x FROM lineitem" for c in NUMBERS) + ")"
_DESCRIBE = f"WITH {_LONG}, c AS (SELECT *, avg(x) OVER (PARTITION BY param) AS m FROM u), q AS (SELECT param, {_MOMENTS} FROM c GROUP BY 1) SELECT param, n, round(mean, 4) AS mean, round(std, 4) AS std, round(CASE WHEN mean = 0 THEN 0 ELSE std / mean * 100 END, 4) AS cv, round(skew, 4) AS skew, round(kurt, 4) AS kurt FROM q"
QUERIES["describe_metrics"] = lambda spark, sf: stats.describe(_items(spark, sf), NUMBERS)
ORACLE_SQL["describe_metrics"] = _DESCRIBE
QUERIES["describe_report"] = lambda spark, sf: stats.interpret(stats.describe(_items(spark, sf), NUMBERS))
ORACLE_SQL["describe_report"] = f"WITH t AS ({_DESCRIBE}) SELECT param, CASE WHEN skew > 0.5 THEN 'right-skewed' WHEN skew < -0.5 THEN 'left-skewed' ELSE 'symmetric' END AS skew_label, CASE WHEN kurt > 1 THEN 'peaked' WHEN kurt < -1 THEN 'flat' ELSE 'normal' END AS kurt_label, row_number() OVER (ORDER BY cv DESC, param)::INT AS cv_rank FROM t"
_TS = ["mean", "std", "least", "largest", "median", "q25", "q75"]
QUERIES["table_stats"] = lambda spark, sf: stats.table_statistics(_items(spark, sf), NUMBERS).select("param", "n", "missing", *_r(*_TS))
ORACLE_SQL["table_stats"] = f"WITH {_LONG} SELECT param, count(x) AS n, count(*) - count(x) AS missing, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS largest, round(median(x), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75 FROM u GROUP BY 1"


def _holes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 20 != 0, F.col("event_type")).alias("event_type"))


_HOLES = "h AS (SELECT CASE WHEN event_id % 10 <> 0 THEN value END AS value, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 20 <> 0 THEN event_type END AS event_type FROM events)"
QUERIES["missing_pattern"] = lambda spark, sf: impute.missing_pattern(_holes(spark, sf), ["value", "user_id", "event_type"])
ORACLE_SQL["missing_pattern"] = f"WITH {_HOLES} SELECT (value IS NULL)::INT::VARCHAR || (user_id IS NULL)::INT::VARCHAR || (event_type IS NULL)::INT::VARCHAR AS pattern, count(*) AS n FROM h GROUP BY 1 ORDER BY pattern DESC LIMIT 10"
QUERIES["missing_rates"] = lambda spark, sf: impute.missing_rates(_holes(spark, sf), ["value", "user_id", "event_type"]).select("column_name", "n_missing", *_r("rate"))
ORACLE_SQL["missing_rates"] = f"WITH {_HOLES} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 6) AS rate FROM h" for c in ("value", "user_id", "event_type"))
QUERIES["missing_mechanism"] = lambda spark, sf: impute.missing_mechanism(_holes(spark, sf), "value", ["user_id", "event_type"]).select(*_r("mean_corr"), "mechanism")
ORACLE_SQL["missing_mechanism"] = f"WITH {_HOLES}, c AS (SELECT (abs(corr((user_id IS NOT NULL)::INT, (value IS NULL)::INT)) + abs(corr((event_type IS NOT NULL)::INT, (value IS NULL)::INT))) / 2 AS r FROM h) SELECT round(r, 6) AS mean_corr, CASE WHEN r < 0.1 THEN 'MCAR' WHEN r < 0.3 THEN 'MAR' ELSE 'MNAR' END AS mechanism FROM c"
QUERIES["quality_report"] = lambda spark, sf: stats.quality_report(_holes(spark, sf).select("user_id", "event_type")).select("n_rows", "n_columns", "n_repeated", "n_missing", *_r("missing_rate"))
ORACLE_SQL["quality_report"] = f"WITH {_HOLES}, g AS (SELECT user_id, event_type, count(*) AS n FROM h GROUP BY 1, 2) SELECT sum(n)::BIGINT AS n_rows, 2 AS n_columns, sum(n - 1)::BIGINT AS n_repeated, sum(n * ((user_id IS NULL)::INT + (event_type IS NULL)::INT))::BIGINT AS n_missing, round(sum(n * ((user_id IS NULL)::INT + (event_type IS NULL)::INT)) / (2 * sum(n)), 6) AS missing_rate FROM g"
QUERIES["column_types"] = lambda spark, sf: stats.column_types(table(spark, sf, "events").select("event_id", "ts", "event_type", "value", F.col("user_id").cast("string").alias("user_text")))
ORACLE_SQL["column_types"] = "SELECT 'event_id' AS column_name, CASE WHEN count(DISTINCT event_id) < 20 THEN 'categorical_numeric' ELSE 'numeric' END AS kind FROM events UNION ALL SELECT 'ts', 'datetime' UNION ALL SELECT 'event_type', CASE WHEN count(DISTINCT event_type) / count(*) < 0.05 THEN 'categorical' ELSE 'text' END FROM events UNION ALL SELECT 'value', CASE WHEN count(DISTINCT value) < 20 THEN 'categorical_numeric' ELSE 'numeric' END FROM events UNION ALL SELECT 'user_text', CASE WHEN count(DISTINCT user_id) < 20 THEN 'categorical_numeric' ELSE 'numeric' END FROM events"

# correlation
_PAIRS = [(a, b) for k, a in enumerate(NUMBERS) for b in NUMBERS[k + 1 :]]


def _corr_sql(pairs, source: str, digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM {source}" for a, b in pairs)


_T = "round(r, 6) AS r, round(r * sqrt((n - 2) / nullif(1 - r * r, 0)), 4) AS t"
QUERIES["corr_pearson"] = lambda spark, sf: stats.pearson(_items(spark, sf), NUMBERS).select("a", "b", "n", *_r("r"), *_r("t", digits=4))
ORACLE_SQL["corr_pearson"] = f"SELECT a, b, n, {_T} FROM ({_corr_sql(_PAIRS, 'lineitem')})"
QUERIES["corr_target"] = lambda spark, sf: stats.pearson(_items(spark, sf), NUMBERS, "l_extendedprice").select("a", "b", "n", *_r("r"), *_r("t", digits=4))
ORACLE_SQL["corr_target"] = f"SELECT a, b, n, {_T} FROM ({_corr_sql([(c, 'l_extendedprice') for c in NUMBERS if c != 'l_extendedprice'], 'lineitem')})"
QUERIES["corr_top_pairs"] = lambda spark, sf: stats.top_pairs(stats.pearson(_items(spark, sf), NUMBERS), 3).select("a", "b", "n", *_r("r"))
ORACLE_SQL["corr_top_pairs"] = f"SELECT a, b, n, round(r, 6) AS r FROM ({_corr_sql(_PAIRS, 'lineitem')}) ORDER BY abs(r) DESC, a, b LIMIT 3"
QUERIES["corr_spearman"] = lambda spark, sf: stats.spearman(_items(spark, sf), NUMBERS[:3]).select("a", "b", "n", *_r("r"))
_RANKED = "k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS[:3]) + " FROM lineitem)"
ORACLE_SQL["corr_spearman"] = f"WITH {_RANKED} SELECT a, b, n, round(r, 6) AS r FROM ({_corr_sql([p for p in _PAIRS if 'l_tax' not in p], 'k')})"
QUERIES["corr_kendall"] = lambda spark, sf: concordance.kendall(_items(spark, sf), "l_quantity", "l_discount").select("a", "b", "n", *_r("tau"))
ORACLE_SQL["corr_kendall"] = "WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS w FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(p.w * q.w * sign(q.y - p.y)) AS s FROM c p JOIN c q ON p.x < q.x), n AS (SELECT sum(w) AS n FROM c), tx AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT sum(w) AS k FROM c GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT sum(w) AS k FROM c GROUP BY y)) SELECT 'l_quantity' AS a, 'l_discount' AS b, n::BIGINT AS n, round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS tau FROM s, n, tx, ty"
QUERIES["regression_metrics"] = lambda spark, sf: stats.regression_metrics(_items(spark, sf).withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p").select("n", *_r("r2"), *_r("rmse", "mae", digits=3))
ORACLE_SQL["regression_metrics"] = "WITH i AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE * 1500 AS p FROM lineitem) SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae FROM i"
QUERIES["histogram"] = lambda spark, sf: stats.histogram(_items(spark, sf), "l_quantity", 7)
ORACLE_SQL["histogram"] = "WITH i AS (SELECT l_quantity::DOUBLE AS x FROM lineitem), e AS (SELECT min(x) lo, max(x) hi FROM i) SELECT least(floor((x - lo) / (hi - lo) * 7) + 1, 7)::INT AS bin, count(*) AS n FROM i, e GROUP BY 1"

# dictionary
Q = dictionary
W1, B2, C2 = "ECONOMY", ["ECONOMY - Brand#11", "ECONOMY - Brand#12"], ["size 1", "size 4", "size 7"]
_IN = lambda c, v: f"{c} IN ({', '.join(repr(x) for x in v)})"
_ALL = "work_type, category, pool, dataset, ordinal"
QUERIES["dict_chain_filter"] = lambda spark, sf: Q.chain_filter(parts(spark, sf), W1, B2[0])
ORACLE_SQL["dict_chain_filter"] = f"WITH {PARTS} SELECT {_ALL} FROM d WHERE work_type = '{W1}' AND category = '{B2[0]}'"
QUERIES["dict_retrieve"] = lambda spark, sf: Q.retrieve(parts(spark, sf), pools=C2, keyword="A", fields=("dataset", "category"))
ORACLE_SQL["dict_retrieve"] = f"WITH {PARTS} SELECT {_ALL} FROM d WHERE {_IN('pool', C2)} AND (contains(lower(dataset), 'a') OR contains(lower(category), 'a'))"
QUERIES["dict_retrieve_task"] = lambda spark, sf: Q.retrieve_task(parts(spark, sf), [W1], B2, C2).select(*_ALL.split(", "))
ORACLE_SQL["dict_retrieve_task"] = f"WITH {PARTS}, l AS (SELECT {_ALL} FROM d WHERE work_type = '{W1}' AND {_IN('category', B2)}) SELECT * FROM l UNION ALL SELECT {_ALL} FROM d WHERE work_type = '{W1}' AND {_IN('pool', C2)} AND dataset NOT IN (SELECT dataset FROM l)"
QUERIES["dict_chain_query"] = lambda spark, sf: Q.chain_query(parts(spark, sf), "conom", "brand#1", "SIZE")
ORACLE_SQL["dict_chain_query"] = f"WITH {PARTS} SELECT {_ALL} FROM d WHERE contains(lower(work_type), 'conom') AND contains(lower(category), 'brand#1') AND contains(lower(pool), 'size')"
QUERIES["dict_tree"] = lambda spark, sf: Q.tree(parts(spark, sf))
ORACLE_SQL["dict_tree"] = f"WITH {PARTS} SELECT work_type, category, pool, count(*) AS n, string_agg(dataset, ',' ORDER BY ordinal, dataset) AS datasets FROM d GROUP BY 1, 2, 3"
QUERIES["dict_search"] = lambda spark, sf: Q.search(parts(spark, sf), "2")
ORACLE_SQL["dict_search"] = f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT DISTINCT '{x}' AS level, {x} AS name FROM d WHERE contains(lower({x}), '2')" for x in Q.KEY)
QUERIES["dict_search_text"] = lambda spark, sf: Q.search_text(parts(spark, sf), " ring ", ["pool", "dataset"], 50)
ORACLE_SQL["dict_search_text"] = f"WITH {PARTS} SELECT {_ALL} FROM d WHERE contains(lower(pool), 'ring') OR contains(lower(dataset), 'ring') ORDER BY ordinal LIMIT 50"
QUERIES["dict_stats"] = lambda spark, sf: Q.statistics(parts(spark, sf))
ORACLE_SQL["dict_stats"] = f"WITH {PARTS} SELECT 'work_type' AS level, work_type AS name, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'pool', pool, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM d"
QUERIES["dict_top_categories"] = lambda spark, sf: Q.top_categories(parts(spark, sf))
ORACLE_SQL["dict_top_categories"] = f"WITH {PARTS} SELECT category, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, category LIMIT 10"
QUERIES["dict_cascade_delete"] = lambda spark, sf: Q.cascade_delete(parts(spark, sf), "category", parts(spark, sf).where(F.col("category").isin(B2)).select("category")).select(*_ALL.split(", "))
ORACLE_SQL["dict_cascade_delete"] = f"WITH {PARTS} SELECT {_ALL} FROM d WHERE NOT {_IN('category', B2)}"


def _half(spark: SparkSession, sf: str, rest: int) -> DataFrame:
    return parts(spark, sf).where(F.col("ordinal") % 3 != rest)


QUERIES["dict_import_merge"] = lambda spark, sf: Q.import_new(Q.import_new(_half(spark, sf, 0), _half(spark, sf, 1)), _half(spark, sf, 1)).select(*_ALL.split(", "))
ORACLE_SQL["dict_import_merge"] = f"WITH {PARTS}, l AS (SELECT {_ALL} FROM d WHERE ordinal % 3 <> 0), r AS (SELECT {_ALL}, row_number() OVER (PARTITION BY work_type, category, pool, dataset ORDER BY ordinal) AS k FROM d WHERE ordinal % 3 <> 1) SELECT * FROM l UNION ALL SELECT {_ALL} FROM r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM l WHERE l.work_type = r.work_type AND l.category = r.category AND l.pool = r.pool AND l.dataset = r.dataset)"
QUERIES["dict_bulk_add"] = lambda spark, sf: Q.bulk_add(_half(spark, sf, 0), parts(spark, sf)).groupBy(F.coalesce("error", F.lit("added")).alias("outcome")).agg(F.count("*").alias("n"))
ORACLE_SQL["dict_bulk_add"] = f"WITH {PARTS}, k AS (SELECT *, row_number() OVER (PARTITION BY work_type, category, pool, dataset ORDER BY ordinal) AS r FROM d) SELECT CASE WHEN trim(dataset) = '' THEN 'empty name' WHEN work_type NOT IN (SELECT work_type FROM d WHERE ordinal % 3 <> 0) THEN 'unknown work type' WHEN EXISTS (SELECT 1 FROM d WHERE ordinal % 3 <> 0 AND d.work_type = k.work_type AND d.category = k.category AND d.pool = k.pool AND d.dataset = k.dataset) THEN 'exists already' WHEN r > 1 THEN 'repeated in the batch' ELSE 'added' END AS outcome, count(*) AS n FROM k GROUP BY 1"
QUERIES["dict_validate"] = lambda spark, sf: Q.validate(parts(spark, sf), C2).groupBy("is_valid", F.concat_ws(";", "warnings").alias("warnings")).agg(F.count("*").alias("n"))
ORACLE_SQL["dict_validate"] = f"WITH {PARTS} SELECT true AS is_valid, CASE WHEN {_IN('pool', C2)} THEN '' ELSE 'pool not standard' END AS warnings, count(*) AS n FROM d GROUP BY 2"
QUERIES["dict_backfill"] = lambda spark, sf: Q.backfill(parts(spark, sf).withColumn("zh", F.when(F.col("ordinal") % 2 == 0, F.lower("category"))), parts(spark, sf).select("category", F.upper("category").alias("zh")).distinct(), ["category"], "zh").select("ordinal", "zh")
ORACLE_SQL["dict_backfill"] = f"WITH {PARTS} SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN lower(category) ELSE upper(category) END AS zh FROM d"
QUERIES["dict_database_stats"] = lambda spark, sf: Q.database_statistics(parts(spark, sf))
ORACLE_SQL["dict_database_stats"] = f"WITH {PARTS} SELECT work_type, pool, count(*) AS n_rows, count(DISTINCT dataset) AS n_datasets FROM d GROUP BY ROLLUP (work_type, pool)"
QUERIES["dict_enrich"] = lambda spark, sf: Q.enrich(parts(spark, sf), parts(spark, sf).groupBy("work_type").agg(F.min("ordinal").alias("wt_first")), parts(spark, sf).groupBy("work_type", "category").agg(F.max("ordinal").alias("cat_last")), parts(spark, sf).where(F.col("pool").isin(C2)).select("pool", F.lower("pool").alias("pool_label")).distinct()).select("ordinal", "wt_first", "cat_last", "pool_label")
ORACLE_SQL["dict_enrich"] = f"WITH {PARTS} SELECT ordinal, min(ordinal) OVER (PARTITION BY work_type) AS wt_first, max(ordinal) OVER (PARTITION BY work_type, category) AS cat_last, CASE WHEN {_IN('pool', C2)} THEN lower(pool) END AS pool_label FROM d"

# names
# every reserved word takes an ending, and words that are none stay
_KEPT = ["values", "key", "row", "view", "set", "name", "time"]


def norm_names(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in [*names.RESERVED, *_KEPT]])
    rows = table(spark, sf, "part").withColumn("word", F.get(words, F.pmod(F.col("p_partkey"), F.size(words)).cast("int")))
    bracketed = F.concat(F.lit("  9("), "p_name", F.lit(")【"), "p_brand", F.lit("】% "))
    return rows.select("p_partkey", names.normalise_name(F.concat_ws(" - ", "p_type", "p_brand", "p_name")).alias("name"), names.normalise_name(F.upper("word")).alias("word"), names.normalise_name(bracketed).alias("bracketed"))


QUERIES["norm_names"] = norm_names
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\s&%#\-./\\]+', '_', 'g'), '[()（）【】]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_CUT = "CASE WHEN length({0}) > 50 THEN regexp_replace(left({0}, 50), '_+$', '') ELSE {0} END"
_JOINED, _BRACKETED = "p_type || ' - ' || p_brand || ' - ' || p_name", "'9(' || p_name || ')【' || p_brand || '】'"
_NO_RESERVED = ", ".join(f"'{w}'" for w in _KEPT)
_ALL_WORDS = "[" + ", ".join(f"'{w}'" for w in [*names.RESERVED, *_KEPT]) + "]"
ORACLE_SQL["norm_names"] = (
    f"WITH w AS (SELECT {_ALL_WORDS} AS words), x AS (SELECT p_partkey, {_STRIPPED.format(_JOINED)} AS a, words[p_partkey % len(words) + 1] AS b, 't_' || {_STRIPPED.format(_BRACKETED)} AS c FROM part, w) "
    f"SELECT p_partkey, {_CUT.format('a')} AS name, CASE WHEN b IN ({_NO_RESERVED}) THEN b ELSE b || '_col' END AS word, {_CUT.format('c')} AS bracketed FROM x"
)
# names with every keyword, and the type they must have
_TYPED = {
    "timestamp": "Creation_time Timestamp_utc 采样时间 日期 mean_time",
    "decimal(18,4)": "Value Mean_x Average Threshold Limit Valid_range Frequency Interval Duration Period Cycle Deviation Quantile Latency Delay Ratio Rate Score Upper Lower Min Max 标准 阈值 周期 threshold_index",
    "boolean": "Normal_status State Flag Enabled Valid Available Mapped Triggered Aligned Async is_on has_x can_y 状态 有效 触发",
    "json": "Label Keyword Tag_list Mapping Offset_ 规则",
    "int": "Row_count Number Priority Level Index 优先级 序号 计数",
    "string": "Name date std num Remark",
}
#: Each part's first word before one of the names, so that the result follows the table; the words of parts hold no keyword but
#: those that the twin's own test finds as well.
_ENDS = [x for words in _TYPED.values() for x in words.split()]
QUERIES["infer_types"] = lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.concat_ws("_", F.regexp_replace(F.split("p_name", " ")[0], "[^a-z]", ""), F.get(F.array(*[F.lit(x) for x in _ENDS]), (F.col("p_partkey") % len(_ENDS)).cast("int"))).alias("name")).select("p_partkey", "name", names.inferred_type(F.col("name")).alias("kind"))
_RULES = " ".join("WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in names.TYPE_RULES)
ORACLE_SQL["infer_types"] = f"WITH n AS (SELECT p_partkey, concat_ws('_', regexp_replace(string_split(p_name, ' ')[1], '[^a-z]', '', 'g'), {_ENDS!r}[(p_partkey % {len(_ENDS)})::INT + 1]) AS name FROM part) SELECT p_partkey, name, CASE {_RULES} ELSE 'string' END AS kind FROM n"
QUERIES["table_names"] = lambda spark, sf: parts(spark, sf).select("ordinal", names.table_name("work_type", "category", "pool", "dataset").alias("table_name"))
QUERIES["name_collisions"] = lambda spark, sf: Q.collisions(parts(spark, sf), ["category", "pool"])
ORACLE_SQL["name_collisions"] = f"WITH {PARTS} SELECT category, pool, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, category, pool LIMIT 5"

# graph
_NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{p}:' || {t} AS id, '{t}' AS type, {t} AS name FROM d" for p, t in (("wt", "work_type"), ("cat", "category"), ("pool", "pool"), ("ds", "dataset"))) + ")"
_CO = lambda g, k: f"SELECT 'ds:' || a.dataset AS src, 'ds:' || b.dataset AS dst, 'co_{g}' AS type, {k} AS seq FROM f_{g} a JOIN f_{g} b ON a.{g} = b.{g} AND b.r BETWEEN a.r + 1 AND a.r + 9"
_FIRST = lambda g: f"f_{g} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY o, dataset) AS r FROM (SELECT {g}, dataset, min(ordinal) AS o FROM d GROUP BY 1, 2)) WHERE r <= 50)"
_EDGES = f"{_FIRST('category')}, {_FIRST('pool')}, edges AS (SELECT src, dst, arg_max(type, seq) AS type FROM (SELECT 'wt:' || work_type AS src, 'cat:' || category AS dst, 'hierarchical' AS type, 0 AS seq FROM d UNION ALL SELECT 'cat:' || category, 'ds:' || dataset, 'hierarchical', 1 FROM d UNION ALL SELECT 'pool:' || pool, 'ds:' || dataset, 'cross', 2 FROM d UNION ALL {_CO('category', 3)} UNION ALL {_CO('pool', 4)}) GROUP BY 1, 2)"
_GRAPH = f"WITH {PARTS}, {_NODES}, {_EDGES}"
TASK = ([W1], B2, C2, ["blue", "green"])


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = parts(spark, sf)
    return d, graph.nodes_of(d), graph.edges_of(d)


def _scores(spark: SparkSession, sf: str, hops: int) -> DataFrame:
    d, n, e = _graph(spark, sf)
    return graph.pass_messages(graph.initial_scores(d, n, *TASK), e, hops)


_INIT = f"""s0 AS (SELECT n.id, n.type, n.name, CASE type WHEN 'work_type' THEN CASE WHEN name = '{W1}' THEN 1.0 ELSE 0.05 END
    WHEN 'category' THEN CASE WHEN {_IN('name', B2)} THEN 0.8 WHEN (SELECT max((work_type = '{W1}')::INT) FROM d WHERE category = n.name) = 1 THEN 0.5 ELSE 0.1 END
    WHEN 'pool' THEN CASE WHEN {_IN('name', C2)} THEN 0.7 ELSE 0.05 END ELSE g.g END::DOUBLE AS s FROM nodes n LEFT JOIN (SELECT 'ds:' || dataset AS id, least(1.0, max(0.05 + 0.5 * (work_type = '{W1}')::INT + 0.3 * ({_IN('category', B2)})::INT + 0.2 * ({_IN('pool', C2)})::INT + 0.3 * (contains(lower(dataset), 'blue')::INT + contains(lower(dataset), 'green')::INT)))::DOUBLE AS g FROM d GROUP BY 1) g ON n.id = g.id)"""
_W = "CASE type WHEN 'hierarchical' THEN 1.0 WHEN 'cross' THEN 0.8 ELSE 0.3 END"
_BOTH = f"both_ways AS (SELECT src, dst, {_W}::DOUBLE AS w FROM edges UNION ALL SELECT dst, src, {_W}::DOUBLE * 0.5 FROM edges)"
_HOP = lambda k: f"s{k} AS (SELECT p.id, p.type, p.name, CASE WHEN m IS NULL THEN s ELSE s + 0.1 * (0.6 * s + 0.4 * m - s) END AS s FROM s{k - 1} p LEFT JOIN (SELECT dst AS id, avg(q.s * w) AS m FROM both_ways JOIN s{k - 1} q ON q.id = src GROUP BY 1) USING (id))"
_PASSED = f"{_GRAPH}, {_INIT}, {_BOTH}, {_HOP(1)}, {_HOP(2)}, {_HOP(3)}"
QUERIES["graph_build"] = lambda spark, sf: _graph(spark, sf)[2]
ORACLE_SQL["graph_build"] = f"{_GRAPH} SELECT src, dst, type FROM edges"
QUERIES["graph_stats"] = lambda spark, sf: graph.statistics(*_graph(spark, sf)[1:])
ORACLE_SQL["graph_stats"] = f"{_GRAPH} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2"
QUERIES["graph_init_scores"] = lambda spark, sf: _scores(spark, sf, 0).select("id", *_r("s"))
ORACLE_SQL["graph_init_scores"] = f"{_GRAPH}, {_INIT} SELECT id, round(s, 6) AS s FROM s0"
QUERIES["graph_message_pass"] = lambda spark, sf: _scores(spark, sf, 3).select("id", *_r("s"))
ORACLE_SQL["graph_message_pass"] = f"{_PASSED} SELECT id, round(s, 6) AS s FROM s3"
QUERIES["graph_rank_topk"] = lambda spark, sf: graph.rank(_scores(spark, sf, 3), 10)
ORACLE_SQL["graph_rank_topk"] = f"{_PASSED} SELECT name, round(s, 6) AS s FROM s3 WHERE type = 'dataset' ORDER BY s DESC, name LIMIT 10"


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """pool, attribute, ordinal: the pools' attributes, played by the nations."""
    n = table(spark, sf, "nation")
    return n.select(F.concat(F.lit("size "), (F.col("n_nationkey") % 12).cast("string")).alias("pool"), F.col("n_name").alias("attribute"), F.col("n_nationkey").alias("ordinal"))


ATTRIBUTES = "attrs AS (SELECT 'size ' || (n_nationkey % 12) AS pool, n_name AS attribute, n_nationkey AS ordinal FROM nation)"
CONFIG = dict(zip(("work_types", "categories", "pools", "keywords"), TASK, strict=True))


def query_by_config(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.query_by_config(parts(spark, sf), CONFIG, 20, attributes(spark, sf)).select("place", "dataset", "ordinal", *_r("relevance"))


def query_by_template(spark: SparkSession, sf: str) -> DataFrame:
    stored = spark.createDataFrame([("t1", CONFIG), ("t2", {"pools": ["size 1"]})], "template_id string, task_config struct<work_types:array<string>,categories:array<string>,pools:array<string>,keywords:array<string>>")
    return retrieval.query_by_template(parts(spark, sf), stored, "t1", 20, attributes(spark, sf)).select("place", "dataset", "ordinal", *_r("relevance"))


def query_by_text(spark: SparkSession, sf: str) -> DataFrame:
    text = f"Which green or blue data of {W1}?"
    return retrieval.query(parts(spark, sf), text, {"green": "green", "blue": "blue"}, 20, attributes(spark, sf)).select("place", "dataset", "ordinal", *_r("relevance"))


_GRAPH_A = _GRAPH.replace("nodes AS (", f"{ATTRIBUTES}, nodes AS (SELECT DISTINCT 'attr:' || pool || '::' || attribute AS id, 'attribute' AS type, attribute AS name FROM attrs UNION ALL ").replace("edges AS (SELECT src, dst, arg_max(type, seq) AS type FROM (", "edges AS (SELECT src, dst, arg_max(type, seq) AS type FROM (SELECT 'pool:' || pool AS src, 'attr:' || pool || '::' || attribute AS dst, 'cross' AS type, 2 AS seq FROM attrs UNION ALL ")
_INIT_A = _INIT.replace("ELSE g.g END", "ELSE coalesce(g.g, 0) END")
_RELEVANT = f"{_GRAPH_A}, {_INIT_A}, {_BOTH}, {_HOP(1)}, {_HOP(2)}, {_HOP(3)}, f AS (SELECT *, 0 AS part FROM d WHERE work_type = '{W1}' AND {_IN('category', B2)} UNION ALL SELECT *, 1 FROM d WHERE work_type = '{W1}' AND {_IN('pool', C2)} AND dataset NOT IN (SELECT dataset FROM d WHERE work_type = '{W1}' AND {_IN('category', B2)}))"
ORACLE_SQL["query_by_config"] = f"{_RELEVANT}, r AS (SELECT f.dataset, f.ordinal, part, round(s, 9) AS relevance FROM f JOIN s3 ON s3.id = 'ds:' || dataset) SELECT row_number() OVER o::INT AS place, dataset, ordinal, round(relevance, 6) AS relevance FROM r WINDOW o AS (ORDER BY relevance DESC, part, ordinal) ORDER BY place LIMIT 20"
ORACLE_SQL["query_by_template"] = ORACLE_SQL["query_by_config"]
for _f in (query_by_config, query_by_template, query_by_text):
    QUERIES[_f.__name__] = _f


def dict_full_chain(spark: SparkSession, sf: str) -> DataFrame:
    chain = Q.full_chain(parts(spark, sf), W1, attributes(spark, sf)).select("category", "ordinal", F.posexplode("pools").alias("place", "p"))
    return chain.select("category", "ordinal", "place", "p.pool", F.concat_ws(",", "p.datasets").alias("datasets"), F.concat_ws(",", "p.attributes").alias("attributes"))


QUERIES["dict_full_chain"] = dict_full_chain
ORACLE_SQL["dict_full_chain"] = (
    f"WITH {PARTS}, {ATTRIBUTES}, b AS (SELECT category, pool, string_agg(dataset, ',' ORDER BY ordinal, dataset) AS datasets, min(ordinal) AS o FROM d WHERE work_type = '{W1}' GROUP BY 1, 2), a AS (SELECT pool, string_agg(attribute, ',' ORDER BY ordinal) AS attributes FROM attrs GROUP BY 1) "
    "SELECT category, min(o) OVER (PARTITION BY category) AS ordinal, (row_number() OVER (PARTITION BY category ORDER BY pool) - 1)::INT AS place, pool, datasets, coalesce(attributes, '') AS attributes FROM b LEFT JOIN a USING (pool)"
)


def _knowledge(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return knowledge.build(parts(spark, sf), attributes(spark, sf))


_PLACE = lambda kind, key, source: f"{kind}_ AS (SELECT {key}, '{kind}_' || row_number() OVER (ORDER BY min(ordinal), {key}) AS id FROM {source} GROUP BY {key})"
_KNOWN = (
    f"WITH {PARTS}, {ATTRIBUTES}, {_PLACE('work_type', 'work_type', 'd')}, {_PLACE('category', 'work_type, category', 'd')}, {_PLACE('pool', 'pool', 'd')}, {_PLACE('attribute', 'pool, attribute', 'attrs')}, "
    "v AS (SELECT id, 'work_type' AS type, work_type AS name, 0 AS level FROM work_type_ UNION ALL SELECT id, 'category', category, 1 FROM category_ UNION ALL SELECT id, 'pool', pool, 2 FROM pool_ UNION ALL SELECT 'dataset_' || ordinal, 'dataset', dataset, 3 FROM d UNION ALL SELECT id, 'attribute', attribute, 4 FROM attribute_), "
    "e AS (SELECT w.id AS src, c.id AS dst, 'hierarchical' AS type, 1.0::DOUBLE AS weight FROM category_ c JOIN work_type_ w USING (work_type) UNION ALL SELECT c.id, 'dataset_' || ordinal, 'hierarchical', 1 FROM d JOIN category_ c USING (work_type, category) UNION ALL SELECT 'dataset_' || ordinal, p.id, 'cross', 1 FROM d JOIN pool_ p USING (pool) "
    "UNION ALL SELECT * FROM (SELECT 'dataset_' || ordinal, 'dataset_' || lead(ordinal) OVER (PARTITION BY work_type, category ORDER BY ordinal) AS dst, 'cross', 0.5 FROM d) WHERE dst IS NOT NULL UNION ALL SELECT p.id, a.id, 'hierarchical', 1 FROM attribute_ a JOIN pool_ p USING (pool))"
)
QUERIES["kg_build"] = lambda spark, sf: _knowledge(spark, sf)[1]
ORACLE_SQL["kg_build"] = f"{_KNOWN} SELECT * FROM e"
QUERIES["kg_nodes"] = lambda spark, sf: _knowledge(spark, sf)[0]
ORACLE_SQL["kg_nodes"] = f"{_KNOWN} SELECT * FROM v"


def kg_children(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _knowledge(spark, sf)
    ids = knowledge.of_type(nodes, "pool")
    return knowledge.children(edges, ids, "hierarchical").select("id", F.col("child").alias("other"), F.lit("child").alias("way")).unionByName(knowledge.parents(edges, ids).select("id", F.col("parent").alias("other"), F.lit("parent").alias("way")))


QUERIES["kg_children"] = kg_children
ORACLE_SQL["kg_children"] = f"{_KNOWN} SELECT src AS id, dst AS other, 'child' AS way FROM e WHERE src LIKE 'pool%' AND type = 'hierarchical' UNION ALL SELECT dst, src, 'parent' FROM e WHERE dst LIKE 'pool%'"
QUERIES["kg_subgraph_pool"] = lambda spark, sf: knowledge.subgraph_of_pool(*_knowledge(spark, sf), "pool_2")[1]
ORACLE_SQL["kg_subgraph_pool"] = f"{_KNOWN}, k AS (SELECT src AS id FROM e WHERE dst = 'pool_2' AND type = 'cross'), u AS (SELECT id FROM k UNION SELECT src FROM e JOIN k ON dst = k.id WHERE type = 'hierarchical' UNION SELECT 'pool_2' UNION SELECT dst FROM e WHERE src = 'pool_2' AND type = 'hierarchical') SELECT * FROM e WHERE src IN (FROM u) AND dst IN (FROM u)"
QUERIES["kg_subgraph_work_type"] = lambda spark, sf: knowledge.subgraph_of_work_type(*_knowledge(spark, sf), "work_type_3")[0]
ORACLE_SQL["kg_subgraph_work_type"] = f"{_KNOWN}, k AS (SELECT dst AS id FROM e WHERE src = 'work_type_3'), u AS (SELECT 'work_type_3' AS id UNION SELECT id FROM k UNION SELECT dst FROM e JOIN k ON src = k.id WHERE type = 'hierarchical') SELECT * FROM v WHERE id IN (FROM u)"


def kg_marks(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = _knowledge(spark, sf)
    first = knowledge.mark_anomalies(nodes, nodes.where("type = 'pool'").select("id", F.lit(0.7).alias("score")))
    return knowledge.mark_anomalies(first, nodes.where("name like '%blue%' or id = 'pool_1'").select("id", F.lit(0.9).alias("score"))).select("id", "is_anomaly", "anomaly_score")


QUERIES["kg_marks"] = kg_marks
ORACLE_SQL["kg_marks"] = f"{_KNOWN} SELECT id, type = 'pool' OR name LIKE '%blue%' AS is_anomaly, CASE WHEN id = 'pool_1' OR name LIKE '%blue%' THEN 0.9 WHEN type = 'pool' THEN 0.7 ELSE 0 END::DOUBLE AS anomaly_score FROM v"


def kg_put_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = stored(_knowledge(spark, sf)[1], "knowledge-edges")
    row = lambda src, dst, kind, weight: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))
    new = F.array(row("src", "dst", "coupling", 0.8), row("dst", "src", "propagation", 0.6), row("src", "dst", "coupling", 0.1))
    new = edges.where("type = 'cross' and weight = 0.5").select(F.explode(new).alias("e")).select("e.*")
    return knowledge.clear_anomalies(spark.range(0).select(F.lit("x").alias("id")), knowledge.put_edges(edges, new))[1]


QUERIES["kg_put_edges"] = kg_put_edges
ORACLE_SQL["kg_put_edges"] = f"{_KNOWN} SELECT src, dst, CASE WHEN weight = 0.5 THEN 'coupling' ELSE type END AS type, CASE WHEN weight = 0.5 THEN 0.8 ELSE weight END AS weight FROM e"
QUERIES["kg_near"] = lambda spark, sf: knowledge.near(_knowledge(spark, sf)[1], spark.createDataFrame([("category_2",)], "id string"), 2)
ORACLE_SQL["kg_near"] = f"{_KNOWN}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), o AS (SELECT DISTINCT dst AS id FROM b WHERE src = 'category_2'), w AS (SELECT DISTINCT dst AS id FROM b JOIN o ON src = id) SELECT 'category_2' AS id, 0 AS hops UNION ALL SELECT id, 1 FROM o UNION ALL SELECT id, 2 FROM w WHERE id <> 'category_2' AND id NOT IN (FROM o)"
QUERIES["graph_subgraph"] = lambda spark, sf: graph.induced(*_graph(spark, sf)[1:], _graph(spark, sf)[1].where((F.col("type") == "dataset") & F.col("name").contains("blue")))
ORACLE_SQL["graph_subgraph"] = f"{_GRAPH} SELECT src, dst, type FROM edges WHERE src LIKE 'ds:%blue%' AND dst LIKE 'ds:%blue%'"
QUERIES["kg_degree_anomaly"] = lambda spark, sf: graph.degree_anomalies(*_graph(spark, sf)[1:])
ORACLE_SQL["kg_degree_anomaly"] = f"{_GRAPH}, deg AS (SELECT id, type, (SELECT count(*) FROM edges WHERE dst = id) + (SELECT count(*) FROM edges WHERE src = id) AS d FROM nodes), z AS (SELECT id, type, round(abs(d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w, 0), 6) AS z FROM deg WINDOW w AS (PARTITION BY type)) SELECT * FROM z WHERE z > 2"
QUERIES["kg_data_anomaly"] = lambda spark, sf: graph.data_anomalies(series(spark, sf))
ORACLE_SQL["kg_data_anomaly"] = f"WITH {SERIES_SQL}, a AS (SELECT series, arg_max(v, (t, id)) AS l, avg(v) AS m, stddev_pop(v) AS sd FROM s GROUP BY 1) SELECT series, round(abs(l - m) / sd, 6) AS z, round(least(abs(l - m) / sd / 5, 1), 6) AS score, abs(l - m) / sd > 2.5 AS is_anomaly FROM a WHERE sd >= 1e-10"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Edges region -> nation -> supplier; every tenth supplier is coupled to the next."""
    n, s, r = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"), F.lit("hierarchical").alias("type"))
    sup = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("src"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"), F.lit("hierarchical").alias("type"))
    k = s.where(F.col("s_suppkey") % 10 == 0).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("dst"), F.lit("coupling").alias("type"))
    return e.unionByName(sup).unionByName(k).withColumn("weight", F.lit(1.0))


_PLACES = "edges AS (SELECT r_name AS src, n_name AS dst, 'hierarchical' AS type, 1.0::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 's' || s_suppkey, 'hierarchical', 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey + 1), 'coupling', 1.0 FROM supplier WHERE s_suppkey % 10 = 0)"


def kg_causal_trace(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")
    odd = table(spark, sf, "nation").where(F.col("n_nationkey") % 2 == 1).select(F.col("n_name").alias("id")).unionByName(s.where(F.col("s_suppkey") % 5 == 0).select(name))
    return graph.trace(_places(spark, sf), s.where(F.col("s_suppkey") % 4 == 1).select(name), odd, hops=4)


QUERIES["kg_causal_trace"] = kg_causal_trace
ORACLE_SQL["kg_causal_trace"] = f"""WITH RECURSIVE {_PLACES},
    steps AS (SELECT dst AS node, src AS nxt, weight * CASE type WHEN 'coupling' THEN 0.8 ELSE 0.6 END::DOUBLE AS w FROM edges UNION ALL SELECT src, dst, weight * 0.8::DOUBLE FROM edges WHERE type = 'coupling'),
    odd AS (SELECT n_name AS id FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0),
    r AS (SELECT 's' || s_suppkey AS root, 's' || s_suppkey AS node, 1.0::DOUBLE AS score, ['s' || s_suppkey] AS path, 0 AS k FROM supplier WHERE s_suppkey % 4 = 1
          UNION ALL SELECT root, nxt, (score + CASE WHEN nxt IN (SELECT id FROM odd) THEN 0.2 ELSE 0 END::DOUBLE) * w * 0.9::DOUBLE, list_append(path, nxt), k + 1 FROM r JOIN steps USING (node)
          WHERE k < 4 AND NOT list_contains(path, nxt) AND (score + CASE WHEN nxt IN (SELECT id FROM odd) THEN 0.2 ELSE 0 END::DOUBLE) * w * 0.9::DOUBLE >= 0.3),
    b AS (SELECT root, node, max((score, array_to_string(path, ' → '), k)) AS x FROM r WHERE k > 0 GROUP BY 1, 2),
    o AS (SELECT root, node, round(x[1], 6) AS score, x[3]::INT AS hop_count, x[2] AS path FROM b)
    SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY root ORDER BY score DESC, node) <= 10"""
QUERIES["kg_descendants"] = lambda spark, sf: graph.descendants(_places(spark, sf), table(spark, sf, "region").select(F.col("r_name").alias("id")))
ORACLE_SQL["kg_descendants"] = f"WITH RECURSIVE {_PLACES}, r AS (SELECT r_name AS root, r_name AS id, 0 AS hops FROM region UNION SELECT root, dst, hops + 1 FROM r JOIN edges ON src = id) SELECT root, id, min(hops)::INT AS hops FROM r WHERE hops > 0 GROUP BY 1, 2"


def kg_descendants_deep(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of all parts in which number k is below k / 2."""
    keys = table(spark, sf, "part").where("p_partkey > 1")
    edges = keys.select(F.floor(F.col("p_partkey") / 2).cast("string").alias("src"), F.col("p_partkey").cast("string").alias("dst"))
    return graph.descendants(edges, spark.createDataFrame([("1",), ("3",)], "id string"))


QUERIES["kg_descendants_deep"] = kg_descendants_deep
ORACLE_SQL["kg_descendants_deep"] = "WITH RECURSIVE e AS (SELECT (p_partkey // 2)::VARCHAR AS src, p_partkey::VARCHAR AS dst FROM part WHERE p_partkey > 1), r AS (SELECT x AS root, x AS id, 0 AS hops FROM (VALUES ('1'), ('3')) v(x) UNION ALL SELECT root, dst, hops + 1 FROM r JOIN e ON src = id) SELECT root, id, hops::INT AS hops FROM r WHERE hops > 0"

# mapping, messages, metrics
QUERIES["map_apply"] = lambda spark, sf: mapping.apply_rules(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax"), {"l_quantity": ("quantity", 1.0), "l_tax": ("tax_percent", 100.0), "l_orderkey": ("order_no", 1.0)})[0].select("order_no", "quantity", *_r("tax_percent"))
ORACLE_SQL["map_apply"] = "SELECT l_orderkey::DOUBLE AS order_no, l_quantity::DOUBLE AS quantity, round(l_tax::DOUBLE * 100, 6) AS tax_percent FROM lineitem"
# columns named as a type with underscores, without its last two or eight letters, by its last two words in turned order, and as one letter
_NAMED = ["replace(lower(p_type), ' ', '_')", "substring(p_type, 1, length(p_type) - 2)", "substring(p_type, 1, length(p_type) - 8)", "split_part(p_type, ' ', 3) || '-' || split_part(p_type, ' ', 2)", "lower(p_type) || ' x2'", "substring(p_type, 1, 1)"]


def map_discover(spark: SparkSession, sf: str) -> DataFrame:
    types = table(spark, sf, "part")
    columns = types.select(F.explode(F.array(*[F.expr(x) for x in _NAMED])).alias("source")).distinct()
    targets = types.groupBy(F.col("p_type").alias("target")).agg(F.min("p_partkey").alias("ordinal"))
    short = spark.createDataFrame([("co2", -3), ("co", -2), ("h2 o", -1)], "target string, ordinal int")
    asked = spark.createDataFrame([("CO",), ("co2",), ("c02",), ("h2_o",), ("h",), ("o h2",)], "source string")
    return mapping.discover(columns.unionByName(asked), targets.unionByName(short))


QUERIES["map_discover"] = map_discover
_WORD_LIST = "list_distinct(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
ORACLE_SQL["map_discover"] = (
    "WITH c AS (SELECT DISTINCT unnest([" + ", ".join(_NAMED) + "]) AS source FROM part UNION SELECT unnest(['CO', 'co2', 'c02', 'h2_o', 'h', 'o h2'])), "
    "t AS (SELECT p_type AS target, min(p_partkey) AS ordinal FROM part GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('co2', -3), ('co', -2), ('h2 o', -1)) v(a, b)), "
    f"x AS (SELECT source, target, ordinal, translate(lower(source), '_-', '  ') AS x, lower(target) AS y FROM c, t), w AS (SELECT *, {_WORD_LIST.format('x')} AS p, {_WORD_LIST.format('y')} AS q FROM x), "
    "s AS (SELECT *, CASE WHEN x = y THEN 1.0::DOUBLE ELSE greatest(CASE WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y))::DOUBLE / greatest(length(x), length(y)) ELSE 0 END, len(list_intersect(p, q))::DOUBLE / greatest(len(p), len(q))) END AS score FROM w) "
    "SELECT source, target, round(score, 6) AS score FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY source ORDER BY x = y DESC, score DESC, ordinal, target) = 1"
)
QUERIES["feature_assemble"] = lambda spark, sf: mapping.assemble(_items(spark, sf), NUMBERS[:2]).select("l_orderkey", "l_linenumber", *[F.round(F.col("features")[k].cast("double"), 4).alias(f"f{k}") for k in range(2)])
ORACLE_SQL["feature_assemble"] = f"WITH p AS (SELECT avg(l_quantity::DOUBLE) a0, stddev_pop(l_quantity::DOUBLE) b0, avg(l_extendedprice::DOUBLE) a1, stddev_pop(l_extendedprice::DOUBLE) b1 FROM lineitem) SELECT {KEY}, round(((l_quantity::DOUBLE - a0) / b0)::FLOAT::DOUBLE, 4) AS f0, round(((l_extendedprice::DOUBLE - a1) / b1)::FLOAT::DOUBLE, 4) AS f1 FROM lineitem, p"
_BUS = lambda spark, sf: mapping.messages(table(spark, sf, "events").select("event_id", "event_type", "props"), F.lit("event"), F.col("event_type"), F.lit("table"), F.col("event_id"))
QUERIES["bus_filter_stats"] = lambda spark, sf: mapping.channel_statistics(_BUS(spark, sf).where(F.col("channel") != "click"))
ORACLE_SQL["bus_filter_stats"] = "SELECT event_type AS channel, count(*) AS n, min(event_id) AS first_at, max(event_id) AS last_at FROM events WHERE event_type <> 'click' GROUP BY 1"
QUERIES["bus_history"] = lambda spark, sf: mapping.history(_BUS(spark, sf), ["at"]).select("at", "channel", F.get_json_object("payload", "$.props").alias("props"))
ORACLE_SQL["bus_history"] = "SELECT event_id AS at, event_type AS channel, props FROM events ORDER BY event_id DESC LIMIT 1000"
QUERIES["sankey_links"] = lambda spark, sf: metrics.sankey(parts(spark, sf), ["work_type", "category", "pool"])
ORACLE_SQL["sankey_links"] = f"WITH {PARTS} SELECT work_type AS source, category AS target, count(*) AS n FROM d GROUP BY 1, 2 UNION ALL SELECT category, pool, count(*) FROM d GROUP BY 1, 2"
QUERIES["overlap_classes"] = lambda spark, sf: metrics.overlap(table(spark, sf, "events").select("event_type", "user_id"), "event_type", "user_id", ["click", "purchase", "view"])
ORACLE_SQL["overlap_classes"] = "WITH m AS (SELECT user_id, concat_ws('&', CASE WHEN bool_or(event_type = 'click') THEN 'click' END, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' END, CASE WHEN bool_or(event_type = 'view') THEN 'view' END) AS membership FROM events WHERE user_id IS NOT NULL GROUP BY 1) SELECT membership, count(*) AS n FROM m WHERE membership <> '' GROUP BY 1"
QUERIES["pool_matrix"] = lambda spark, sf: metrics.matrix(parts(spark, sf), "category", "pool", C2).select("category", *[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in C2])
ORACLE_SQL["pool_matrix"] = f"WITH {PARTS} SELECT category, " + ", ".join(f"max((pool = '{c}')::INT) AS {c.lower().replace(' ', '_')}" for c in C2) + " FROM d GROUP BY 1"
QUERIES["metric_ratio"] = lambda spark, sf: metrics.pooled_ratio(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_discount").cast("double"), F.col("l_quantity").cast("double")).select("l_returnflag", *_r("ratio"))
ORACLE_SQL["metric_ratio"] = "SELECT l_returnflag, round(sum(l_discount::DOUBLE) / sum(l_quantity::DOUBLE), 6) AS ratio FROM lineitem GROUP BY 1"
QUERIES["metric_reuse"] = lambda spark, sf: metrics.reuse(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey", 25).select("n_items", *_r("share"))
ORACLE_SQL["metric_reuse"] = "SELECT count(*) AS n_items, round(avg((n >= 25)::INT), 6) AS share FROM (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)"
QUERIES["metric_two_level"] = lambda spark, sf: metrics.two_level(table(spark, sf, "events"), "event_type", "user_id", F.col("value")).select("event_type", "n", *_r("mean", "sd"))
ORACLE_SQL["metric_two_level"] = "SELECT event_type, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1"
QUERIES["metric_improvement"] = lambda spark, sf: table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.improvement(F.avg(F.col("l_discount").cast("double")), F.avg(F.col("l_tax").cast("double"))), 6).alias("percent"))
ORACLE_SQL["metric_improvement"] = "SELECT l_returnflag, round((avg(l_tax::DOUBLE) - avg(l_discount::DOUBLE)) / avg(l_discount::DOUBLE) * 100, 6) AS percent FROM lineitem GROUP BY 1"
QUERIES["metric_completion"] = lambda spark, sf: metrics.completion(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_quantity") < 25, F.col("l_discount").cast("double") > 0.05).select("l_returnflag", *_r("rate"))
ORACLE_SQL["metric_completion"] = "SELECT l_returnflag, round(avg((l_quantity < 25 AND l_discount::DOUBLE > 0.05)::INT), 6) AS rate FROM lineitem GROUP BY 1"
QUERIES["metric_durations"] = lambda spark, sf: metrics.durations(table(spark, sf, "events"), "event_type", F.col("value") * 60).select("event_type", "n", *_r("mean_s", "sd_s", digits=4))
ORACLE_SQL["metric_durations"] = "SELECT event_type, count(value) AS n, round(avg(value * 60), 4) AS mean_s, round(stddev_samp(value * 60), 4) AS sd_s FROM events GROUP BY 1"
QUERIES["metric_adaptation"] = lambda spark, sf: metrics.adaptation(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_tax").cast("double"), F.col("l_discount").cast("double")).select("l_returnflag", *_r("rate"))
ORACLE_SQL["metric_adaptation"] = "SELECT l_returnflag, round(avg((l_tax::DOUBLE >= l_discount::DOUBLE)::INT), 6) AS rate FROM lineitem GROUP BY 1"


# imports and settings: a sheet with known, new, repeated and blank rows, and pools written with underscores
def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    work_type = F.when(k % 11 == 0, F.concat(F.lit("NEW "), F.col("p_brand"))).otherwise(F.col("p_type"))
    pool = F.when(k % 7 == 0, F.concat(F.lit("size_"), (F.col("p_size") % 10).cast("string"))).when(k % 13 == 0, "no pool").otherwise(F.concat(F.lit(" size "), (F.col("p_size") % 10).cast("string")))
    dataset = F.when(k % 5 == 0, F.concat(F.lit("extra "), (k % 40).cast("string"))).when(k % 17 == 0, "  ").otherwise(F.col("p_name"))
    return p.select(k.alias("ordinal"), work_type.alias("work_type"), F.concat_ws(" - ", "p_type", "p_brand").alias("category"), pool.alias("pool"), dataset.alias("dataset"))


def _imported(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = parts(spark, sf)
    types = d.groupBy("work_type").agg(F.min("ordinal").alias("no"))
    return imports.template_import(d, types, d.select("pool").distinct(), _sheet(spark, sf))


QUERIES["import_template"] = lambda spark, sf: _imported(spark, sf)[0]
QUERIES["import_template_types"] = lambda spark, sf: _imported(spark, sf)[1]
QUERIES["import_template_counts"] = lambda spark, sf: _imported(spark, sf)[2]
_SHEET = (
    f"WITH {PARTS}, h AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 11 = 0 THEN 'NEW ' || p_brand ELSE p_type END AS work_type, p_type || ' - ' || p_brand AS category, "
    "CASE WHEN p_partkey % 7 = 0 THEN 'size_' || (p_size % 10) WHEN p_partkey % 13 = 0 THEN 'no pool' ELSE 'size ' || (p_size % 10) END AS raw, "
    "CASE WHEN p_partkey % 5 = 0 THEN 'extra ' || (p_partkey % 40) WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS dataset FROM part), "
    "k AS (SELECT DISTINCT pool FROM d), s AS (SELECT h.* EXCLUDE (raw), coalesce(k.pool, raw) AS pool, CASE WHEN dataset = '' THEN 'blank' WHEN k.pool IS NULL THEN 'unknown pool' END AS bad FROM h LEFT JOIN k ON replace(raw, ' ', '_') = replace(k.pool, ' ', '_')), "
    "r AS (SELECT *, CASE WHEN bad IS NOT NULL THEN 'skipped: ' || bad WHEN EXISTS (SELECT 1 FROM d WHERE d.work_type = s.work_type AND d.category = s.category AND d.pool = s.pool AND d.dataset = s.dataset) OR row_number() OVER (PARTITION BY work_type, category, pool, dataset, bad IS NULL ORDER BY ordinal) > 1 THEN 'skipped: known' ELSE 'added' END AS status FROM s), "
    "w AS (SELECT work_type, min(ordinal) AS first FROM r WHERE bad IS NULL AND work_type NOT IN (SELECT work_type FROM d) GROUP BY 1)"
)
ORACLE_SQL["import_template"] = f"{_SHEET} SELECT work_type, category, pool, dataset, ordinal, status FROM r"
ORACLE_SQL["import_template_types"] = f"{_SHEET} SELECT work_type, (SELECT max(n) FROM (SELECT min(ordinal) AS n FROM d GROUP BY work_type)) + row_number() OVER (ORDER BY first) AS no FROM w"
ORACLE_SQL["import_template_counts"] = (
    f"{_SHEET} SELECT (SELECT count(*) FROM w) AS work_types_added, (SELECT count(*) FROM (SELECT work_type, category FROM r WHERE bad IS NULL EXCEPT SELECT work_type, category FROM d)) AS categories_added, "
    "(SELECT count(*) FROM r WHERE status = 'added') AS datasets_added, (SELECT count(*) FROM r WHERE status <> 'added') AS rows_skipped"
)


def _settings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    attributes = s.select(k.alias("dataset_id"), F.lit("grid").alias("time_alignment_strategy"), F.when(k % 2 == 0, "Asia/Shanghai").when(k % 3 == 0, "").alias("default_timezone"), F.when(k % 5 == 0, "unix").alias("timestamp_format"), (k % 60).cast("int").alias("sampling_interval_seconds"), (k % 2 == 0).alias("allow_interpolation"), F.lit("linear").alias("interpolation_method"))
    return attributes, s.select(k.alias("dataset_id"), F.concat(F.lit("t"), (F.col("s_nationkey")).cast("string")).alias("table_name"))


def align_settings(spark: SparkSession, sf: str) -> DataFrame:
    return imports.alignment_settings(*_settings(spark, sf), "t3")


def align_settings_update(spark: SparkSession, sf: str) -> DataFrame:
    return imports.update_alignment_settings(*_settings(spark, sf), "t3", {"time_alignment_strategy": "nearest", "sampling_interval_seconds": 5})


QUERIES["align_settings"], QUERIES["align_settings_update"] = align_settings, align_settings_update
_SET = "a AS (SELECT s_suppkey AS dataset_id, 't' || s_nationkey AS table_name, 'grid' AS time_alignment_strategy, CASE WHEN s_suppkey % 2 = 0 THEN 'Asia/Shanghai' WHEN s_suppkey % 3 = 0 THEN '' END AS default_timezone, CASE WHEN s_suppkey % 5 = 0 THEN 'unix' END AS timestamp_format, (s_suppkey % 60)::INT AS sampling_interval_seconds, s_suppkey % 2 = 0 AS allow_interpolation, 'linear' AS interpolation_method FROM supplier)"
ORACLE_SQL["align_settings"] = f"WITH {_SET} SELECT dataset_id, time_alignment_strategy, coalesce(nullif(default_timezone, ''), 'UTC') AS default_timezone, coalesce(timestamp_format, 'ISO8601') AS timestamp_format, sampling_interval_seconds, allow_interpolation, interpolation_method FROM a WHERE table_name = 't3'"
ORACLE_SQL["align_settings_update"] = f"WITH {_SET} SELECT dataset_id, CASE WHEN table_name = 't3' THEN 'nearest' ELSE time_alignment_strategy END AS time_alignment_strategy, CASE WHEN table_name = 't3' THEN 'UTC' ELSE default_timezone END AS default_timezone, CASE WHEN table_name = 't3' THEN 'ISO8601' ELSE timestamp_format END AS timestamp_format, CASE WHEN table_name = 't3' THEN 5 ELSE sampling_interval_seconds END AS sampling_interval_seconds, CASE WHEN table_name <> 't3' THEN allow_interpolation END AS allow_interpolation, CASE WHEN table_name <> 't3' THEN interpolation_method END AS interpolation_method FROM a"


def model_registry(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    make = lambda rows, name: rows.select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("model_id"), F.concat(F.lit(name), "n_name").alias("name"), F.col("n_nationkey").alias("created"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("tags"))
    models = imports.register_model(make(n.where("n_nationkey < 15"), "first "), make(n.where("n_nationkey >= 10"), "second "))
    models = imports.unregister_models(imports.register_model(models, make(n.where("n_nationkey < 3"), "third "), overwrite=True), ["m2", "m99"])
    return mapping.registry_list(models, ("region", "1")).select("model_id", "name", "created")


QUERIES["model_registry"] = model_registry
ORACLE_SQL["model_registry"] = "SELECT 'm' || n_nationkey AS model_id, CASE WHEN n_nationkey < 3 THEN 'third ' WHEN n_nationkey < 15 THEN 'first ' ELSE 'second ' END || n_name AS name, n_nationkey AS created FROM nation WHERE n_nationkey <> 2 AND n_regionkey = 1"

# queries of operators that had none
QUERIES["graph_degrees"] = lambda spark, sf: graph.degrees(*_graph(spark, sf)[1:])
ORACLE_SQL["graph_degrees"] = f"{_GRAPH} SELECT id, type, (SELECT count(*) FROM edges WHERE dst = id) AS n_in, (SELECT count(*) FROM edges WHERE src = id) AS n_out FROM nodes"
QUERIES["attribute_fields"] = lambda spark, sf: Q.distinct_attributes(table(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.substring("n_name", 1, 2))))).alias("fields")))
ORACLE_SQL["attribute_fields"] = "SELECT count(DISTINCT left(n_name, 2)) AS n FROM nation WHERE n_nationkey % 4 <> 0"
QUERIES["survey_links"] = lambda spark, sf: metrics.survey_links(table(spark, sf, "part").select(F.col("p_name").alias("question"), F.col("p_size").cast("string").alias("yes"), F.when(F.col("p_partkey") % 9 > 0, (F.col("p_partkey") % 7).cast("string")).otherwise("-").alias("no"), (F.col("p_size") + F.col("p_partkey") % 7 + (F.col("p_partkey") % 3 == 0).cast("int")).cast("string").alias("total")))
ORACLE_SQL["survey_links"] = "SELECT p_name AS question, unnest(['Yes', 'No']) AS answer, unnest([p_size, p_partkey % 7])::INT AS n FROM part WHERE p_partkey % 9 > 0 AND p_partkey % 3 > 0"
QUERIES["read_raw"] = lambda spark, sf: catalog.read_raw(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").cast("double").alias("customer")), "o_orderkey", limit=50)
ORACLE_SQL["read_raw"] = "WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) SELECT o_orderkey, 'price' AS series, o_totalprice::DOUBLE AS v FROM o UNION ALL SELECT o_orderkey, 'customer', o_custkey::DOUBLE FROM o"
QUERIES["read_table"] = lambda spark, sf: catalog.read_table(table(spark, sf, "part"), ["p_partkey", "p_name", "p_size"], "p_size > 25 and p_type like '%TIN%'")
ORACLE_SQL["read_table"] = "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25 AND p_type LIKE '%TIN%'"
