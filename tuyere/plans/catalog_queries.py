"""Queries of charts' tables, stored scalers, registers, logs and exports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.operators import align, autoencoder, graph, knowledge, layout, mapping, models, plots, registry, scalers
from tuyere.plans import preprocessing
from tuyere.plans.series_queries import ORACLE_SQL as SERIES_ORACLE
from tuyere.plans.table_queries import NUMBERS, QUERIES as TABLE_QUERIES, _items, _knowledge, parts
from tuyere.sources import catalog
from tuyere.sources.testdata import SERIES_SQL, series, table

QUERIES, ORACLE_SQL = {}, {}


def _r(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


# charts
_DESCRIBED = " UNION ALL ".join(f"SELECT '{c}' AS param, {k} AS place, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std, stddev_samp({c}::DOUBLE) / avg({c}::DOUBLE) * 100 AS cv FROM lineitem" for k, c in enumerate(NUMBERS))
QUERIES["plot_bars"] = lambda spark, sf: plots.bars(_items(spark, sf), NUMBERS)
ORACLE_SQL["plot_bars"] = f"SELECT param, place, round(mean, 4) AS mean, round(std, 4) AS std FROM ({_DESCRIBED})"
QUERIES["plot_by_variation"] = lambda spark, sf: plots.by_variation(_items(spark, sf), NUMBERS)
ORACLE_SQL["plot_by_variation"] = f"SELECT param, row_number() OVER (ORDER BY cv, param) - 1 AS place, round(cv, 4) AS cv, round(0.2 + 0.6 * (row_number() OVER (ORDER BY cv, param) - 1) / 3, 6) AS shade FROM ({_DESCRIBED})"
QUERIES["plot_heat"] = lambda spark, sf: plots.heat(_items(spark, sf), NUMBERS, ["l_orderkey", "l_linenumber", *NUMBERS]).select("row", "param", *_r("z"))
ORACLE_SQL["plot_heat"] = (
    "WITH f AS (SELECT *, row_number() OVER o - 1 AS row FROM lineitem WINDOW o AS (ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) QUALIFY row < 50) "
    + " UNION ALL ".join(f"SELECT row, '{c}' AS param, round(({c}::DOUBLE - (SELECT avg({c}::DOUBLE) FROM lineitem)) / (SELECT stddev_samp({c}::DOUBLE) FROM lineitem), 6) AS z FROM f" for c in NUMBERS)
)

# scalers: the figures before and after, and back again through parameters found by name and method
_TWO = ["l_quantity", "l_extendedprice"]


def scale_before_after(spark: SparkSession, sf: str) -> DataFrame:
    return scalers.normalise(_items(spark, sf), _TWO, "minmax")[2].select("stage", "name", *_r("mean", "std", "least", "largest", "median"))


QUERIES["scale_before_after"] = scale_before_after
_FIGURES = "round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS largest, round(median(x), 6) AS median"
ORACLE_SQL["scale_before_after"] = " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, '{c}' AS name, {_FIGURES} FROM (SELECT {x} AS x FROM lineitem)" for c in _TWO for stage, x in (("before", f"{c}::DOUBLE"), ("after", f"({c}::DOUBLE - (SELECT min({c}) FROM lineitem)::DOUBLE) / (SELECT max({c}) - min({c}) FROM lineitem)::DOUBLE"))
)


def scale_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Each column by a method of its own, and back."""
    rows = _items(spark, sf)
    for c, method in zip(NUMBERS, ("robust", "log", "zscore", "minmax"), strict=True):
        p = scalers.fit(rows, [c], method)
        rows = scalers.transform(scalers.transform(rows, p, [c], method), p, [c], method, inverse=True)
    return rows.select("l_orderkey", "l_linenumber", *_r(*NUMBERS, digits=4))


QUERIES["scale_round_trip"] = scale_round_trip
ORACLE_SQL["scale_round_trip"] = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}::DOUBLE, 4) AS {c}" for c in NUMBERS) + " FROM lineitem"


# registers: suppliers as entries under nations
def register_add(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_name", F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("no"))
    new = s.withColumn("nation", F.when(F.col("no") % 3 == 0, F.lit(99)).otherwise(F.col("nation"))).where("no % 2 = 0")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    return registry.add_under(s.where("no % 4 = 0"), new, ["s_name"], nations, "nation")[1].select("s_name", "no", "ok", "reason")


QUERIES["register_add"] = register_add
ORACLE_SQL["register_add"] = "SELECT s_name, s_suppkey AS no, s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AS ok, CASE WHEN s_suppkey % 4 = 0 THEN 'exists already' WHEN s_suppkey % 3 = 0 THEN 'unknown nation' END AS reason FROM supplier WHERE s_suppkey % 2 = 0"


def register_update(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_name", F.col("s_suppkey").alias("no"), F.col("s_acctbal").cast("double").alias("balance"))
    changes = s.where("no % 3 = 0").select("s_name", F.when(F.col("no") % 2 == 0, F.concat("s_name", F.lit("!"))).alias("new_s_name"), (F.col("balance") + 1).alias("new_balance"))
    return registry.update(s, changes, ["s_name"])[0].select("s_name", "no", *_r("balance", digits=2))


QUERIES["register_update"] = register_update
ORACLE_SQL["register_update"] = "SELECT s_name, s_suppkey AS no, round(s_acctbal::DOUBLE + (s_suppkey % 3 = 0 AND s_suppkey % 2 = 1)::INT, 2) AS balance FROM supplier"


def template_compare(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").groupBy(F.col("p_size").alias("pool")).agg(F.map_from_entries(F.collect_set(F.struct("p_brand", F.lit("x")))).alias("fields"))
    q = table(spark, sf, "part").where("p_size > 3").groupBy(F.col("p_size").alias("pool")).agg(F.map_from_entries(F.collect_set(F.struct(F.when(F.col("p_size") % 5 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")), F.lit("x")))).alias("fields"))
    return registry.compare_templates(p.where("pool < 40"), q)


QUERIES["template_compare"] = template_compare
ORACLE_SQL["template_compare"] = "SELECT p_size AS pool, CASE WHEN p_size <= 3 THEN 'removed' WHEN p_size >= 40 THEN 'added' WHEN p_size % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM (SELECT DISTINCT p_size FROM part)"


# logs and exports
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a log of runs, a run per order and its priority as the table."""
    log = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("table_name"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    return catalog.run_summary(log, ["1-URGENT", "3-MEDIUM"]).select("table_name", "run", "status")


QUERIES["run_summary"] = run_summary
ORACLE_SQL["run_summary"] = "SELECT o_orderpriority AS table_name, o_orderkey AS run, o_orderstatus AS status FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') ORDER BY o_orderdate DESC"
_ALIGNED = SERIES_ORACLE["align_linear_hourly"]
QUERIES["align_export"] = lambda spark, sf: catalog.export_alignment(align.align(series(spark, sf))).select("series", F.unix_micros("timestamp").alias("t"), *_r("value"), "is_interpolated")
ORACLE_SQL["align_export"] = f"SELECT series, t, v AS value, v IS NULL AS is_interpolated FROM ({_ALIGNED})"
QUERIES["align_log"] = lambda spark, sf: catalog.alignment_log(align.align(series(spark, sf)), "events", "b1", "linear")
ORACLE_SQL["align_log"] = f"SELECT 'events' AS table_name, 'b1' AS batch_id, series, CASE WHEN status = 'EXACT_MATCH' THEN t END AS source_t, t AS aligned_t, 'linear' AS method, status LIKE '%INTERPOLATED%' AS is_interpolated FROM ({_ALIGNED})"
QUERIES["align_batch"] = lambda spark, sf: catalog.batch_summary(align.align(series(spark, sf)), "events", "b1", table(spark, sf, "events").count(), frequency="1h", method="linear")
ORACLE_SQL["align_batch"] = f"""SELECT 'b1' AS batch_id, 'events' AS table_name, min(t) AS start_t, max(t) AS end_t, (SELECT count(*) FROM events) AS n_source, count(*) AS n_aligned, count(*) FILTER (WHERE status LIKE '%INTERPOLATED%') AS n_interpolated, count(*) - count(v) AS n_missing, '{{"frequency": "1h", "method": "linear"}}' AS config FROM ({_ALIGNED})"""


def align_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two value columns of a wide table on one grid of six hours; the second has values at every third time."""
    rows = series(spark, sf).groupBy("t").agg(F.min_by("v", "id").alias("a"), F.min("id").alias("i")).select("t", "a", F.when(F.col("i") % 3 == 0, F.col("a") * 2).alias("b"))
    return align.table_align(rows, "t", ["a", "b"], 6 * align.HOUR, max_gap=24 * align.HOUR).select("t", *_r("a", "b"))


QUERIES["align_table"] = align_table
_COLUMN = lambda c: f"""{c} AS (SELECT g.t, CASE WHEN p.t = g.t THEN p.v WHEN q.t - p.t <= {24 * align.HOUR} THEN p.v + (q.v - p.v) * ((g.t - p.t)::DOUBLE / (q.t - p.t)) END AS v
    FROM g ASOF LEFT JOIN (SELECT t, {c} AS v FROM w WHERE {c} IS NOT NULL) p ON g.t >= p.t ASOF LEFT JOIN (SELECT t, {c} AS v FROM w WHERE {c} IS NOT NULL) q ON g.t <= q.t)"""  # noqa: E731
ORACLE_SQL["align_table"] = f"""WITH {SERIES_SQL}, o AS (SELECT t, arg_min(v, id) AS a, min(id) AS i FROM s WHERE v IS NOT NULL GROUP BY t), w AS (SELECT t, a, CASE WHEN i % 3 = 0 THEN a * 2 END AS b FROM o),
    e AS (SELECT min(t) AS lo, max(t) AS hi FROM w), g AS (SELECT unnest(range(lo, hi + 1, {6 * align.HOUR})) AS t FROM e), {_COLUMN('a')}, {_COLUMN('b')}
    SELECT t, round(a.v, 6) AS a, round(b.v, 6) AS b FROM a JOIN b USING (t)"""
QUERIES["kg_propagation"] = lambda spark, sf: graph.propagation_edges(TABLE_QUERIES["kg_causal_trace"](spark, sf)).select("src", "dst", *_r("weight"))
QUERIES["multi_source_sync"] = lambda spark, sf: align.synchronise(series(spark, sf)).select("series", "n", "lag", "warning")
_SYNC = f"""WITH {SERIES_SQL}, n AS (SELECT series, count(*) AS n FROM s GROUP BY 1), b AS (SELECT series AS base FROM n ORDER BY n DESC, series LIMIT 1),
    r AS (SELECT series, t / 1e6 AS t, row_number() OVER (PARTITION BY series ORDER BY t, id) - 1 AS i FROM s), f AS (SELECT * FROM r WHERE i < 1000),
    m AS (SELECT series, count(*) AS k, avg(t) AS m, stddev_pop(t) AS sd FROM f GROUP BY 1), z AS (SELECT f.series, i, CASE WHEN sd > 0 THEN (t - m) / sd ELSE 0 END AS z, k FROM f JOIN m USING (series)),
    a AS (SELECT z.* FROM z, b WHERE series = base), c AS (SELECT z.series, a.i - z.i AS lag, round(sum(a.z * z.z), 6) AS c FROM a, z GROUP BY 1, 2),
    l AS (SELECT series, arg_min(lag, (-c, lag)) AS lag FROM c GROUP BY 1),
    q AS (SELECT z.series, any_value(a.k) AS ka, any_value(z.k) AS kz, sum(a.z * z.z) / any_value(a.k) AS r FROM a JOIN z ON a.i = z.i GROUP BY 1),
    o AS (SELECT l.series, n.n, CASE WHEN ka < 10 OR kz < 10 THEN 0 ELSE lag END AS lag, CASE WHEN ka < 10 OR kz < 10 OR ka <> kz THEN 0 ELSE r * r END AS r2 FROM l JOIN n USING (series) JOIN q USING (series))"""
ORACLE_SQL["multi_source_sync"] = f"{_SYNC} SELECT series, n, lag, CASE WHEN n = (SELECT max(n) FROM o) AND r2 < 0.8 THEN 'weak match: r2 ' || format('{{:.3f}}', r2) END AS warning FROM o"
#: For multi_source_offset, which is with the series queries.
OFFSET_SQL = f"{_SYNC} SELECT series, n, lag, round(r2, 6) AS r2 FROM o"

# models and places
_numbers = lambda spark, sf: table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *[F.col(c).cast("double").alias(c) for c in NUMBERS])
#: Rounds of the query; the operator's default is 50.
QUERIES["outlier_autoencoder"] = lambda spark, sf: autoencoder.autoencoder(_numbers(spark, sf), NUMBERS, rounds=15).select("id", *_r("error"), "is_outlier")
QUERIES["outlier_axes"] = lambda spark, sf: models.linear_autoencoder(_numbers(spark, sf), NUMBERS).select("id", *_r("error"), "is_outlier")


def kg_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 children of each kind of every node of the knowledge graph, in layers."""
    return layout.layered(*layout.first_children(*_knowledge(spark, sf), 20), 4)


QUERIES["kg_layout"] = kg_layout


def map_table(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the line items by one rule and by what their names are like."""
    names = spark.createDataFrame([("l discount", 1), ("quantity", 2), ("l tax rate", 3)], "target string, ordinal int")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax")
    return mapping.map_table(rows, {"l_orderkey": ("order", 1.0), "l_linenumber": ("line", 1.0), "l_tax": ("tax", 100.0)}, names)[0]


QUERIES["map_table"] = map_table
ORACLE_SQL["map_table"] = 'SELECT l_orderkey::DOUBLE AS "order", l_linenumber::DOUBLE AS line, (l_tax * 100)::DOUBLE AS tax, l_discount::DOUBLE AS "l discount", l_quantity::DOUBLE AS quantity FROM lineitem'


def table_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with gaps: the price by time, the status by its most frequent value."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("double")).alias("price"), F.col("o_orderdate").cast("timestamp").alias("order_time"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))
    return preprocessing.fill_table(rows, "id")[0].select("id", *_r("price"), "status")


QUERIES["table_fill"] = table_fill
ORACLE_SQL["table_fill"] = """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DOUBLE END AS price, o_orderdate AS t, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders),
    n AS (SELECT *, row_number() OVER (ORDER BY t, id) AS i FROM o), k AS (SELECT i, price FROM n WHERE price IS NOT NULL), m AS (SELECT status AS most FROM o WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)
    SELECT id, round(coalesce(n.price, p.price + (q.price - p.price) * ((n.i - p.i)::DOUBLE / (q.i - p.i)), p.price, q.price), 6) AS price, coalesce(status, (SELECT most FROM m)) AS status FROM n ASOF LEFT JOIN k p ON n.i >= p.i ASOF LEFT JOIN k q ON n.i <= q.i"""
