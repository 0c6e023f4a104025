"""Queries that write tables, documents and exports to the shared folder and read them back, and of whole pipelines, with their
SQL twins."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.functions.storage import folder, stored
from tuyere.operators import align, impute, imports, mapping, stats
from tuyere.operators.registry import joined_key
from tuyere.plans import preprocessing
from tuyere.plans.series_queries import ORACLE_SQL as SERIES_ORACLE
from tuyere.plans.table_queries import NUMBERS, ORACLE_SQL as TABLE_ORACLE, PARTS, _items, _knowledge, _r, parts
from tuyere.sources import catalog
from tuyere.sources.testdata import GAPPY_SQL, SERIES_SQL, gappy, series, table
from tuyere.streaming import streams

QUERIES, ORACLE_SQL = {}, {}


def _path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/tuyere/{name}-{uuid.uuid4().hex}"


def catalog_operations(spark: SparkSession, sf: str) -> DataFrame:
    """What is found after a table is written, added to, backed up, logged and cleared; its tables are dropped in the end."""
    name = f"t{uuid.uuid4().hex[:12]}"
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    try:
        catalog.write_table(p, name, "replace")
        catalog.write_table(p.where("p_size > 25"), name, "append")
        backup = catalog.backup_table(spark, name, datetime(2024, 5, 6, 7, 8, 9))
        catalog.log_run(spark, name, f"{name}_log", "done", spark.table(name).count(), note="x")
        logged = catalog.run_summary(spark.table(f"{name}_log"), [name]).first()
        info = catalog.table_info(spark, name).where(F.col("table_name") == name).agg(F.count("*").alias("n"), F.max("n_rows").alias("rows")).first()
        rows = [("tables", len(catalog.list_tables(spark, name))), ("columns", len(catalog.list_columns(spark, name))), ("backup", spark.table(backup).count()), ("backup named", int(backup == f"{name}_backup_20240506_070809"))]
        rows += [("logged", logged.rows), ("described", info.n), ("rows", info.rows), ("cleared", catalog.clear_table(spark, name)), ("left", spark.table(name).count())]
    finally:
        catalog.drop_tables(spark, name)
    return spark.createDataFrame(rows, "what string, n long")


QUERIES["catalog_operations"] = catalog_operations
_N = "(SELECT count(*) + count(*) FILTER (p_size > 25) FROM part)"
ORACLE_SQL["catalog_operations"] = f"SELECT unnest(['tables', 'columns', 'backup', 'backup named', 'logged', 'described', 'rows', 'cleared', 'left']) AS what, unnest([3, 3, {_N}, 1, {_N}, 3, {_N}, {_N}, 0])::BIGINT AS n"


def aligned_written(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "aligned")
    aligned = stored(align.align(series(spark, sf)), "aligned")
    for batch in ("b1", "b2"):
        catalog.write_aligned(aligned, path, batch)
    return spark.read.parquet(path).groupBy("batch_id", "series", "is_interpolated").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"))


QUERIES["aligned_written"] = aligned_written
ORACLE_SQL["aligned_written"] = f"WITH a AS ({SERIES_ORACLE['align_linear_hourly']}) SELECT batch_id, series, status LIKE '%INTERPOLATED%' AS is_interpolated, count(*) AS n, round(sum(v), 3) AS total FROM a, (SELECT unnest(['b1', 'b2']) AS batch_id) GROUP BY ALL"


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "export") + ".csv"
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_retailprice").cast("double").alias("p_retailprice"), F.when(F.col("p_size") > 9, F.concat(F.lit('a "b", '), "p_brand")).alias("note"))
    catalog.export_csv(rows, path)
    return catalog.read_file(spark, path, "p_partkey long, p_name string, p_retailprice double, note string").select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("p_retailprice"), F.regexp_replace("note", r'\\', "").alias("note"))


QUERIES["csv_round_trip"] = csv_round_trip
ORACLE_SQL["csv_round_trip"] = """SELECT p_partkey, p_name, round(p_retailprice::DOUBLE, 2) AS p_retailprice, CASE WHEN p_size > 9 THEN 'a "b", ' || p_brand END AS note FROM part"""


def sheet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet with other headers, blanks around names, rows without a key and repeated ones."""
    path = _path(spark, "sheet")
    p = table(spark, sf, "part")
    sheet = p.select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("Dataset EN"), F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("brand"))
    sheet.unionByName(sheet.where("length(brand) > 0")).write.option("header", True).csv(path)
    return catalog.read_sheet(spark, path, {"dataset": ["Dataset EN", "name"], "pool": ["Brand"], "zh": ["chinese"]}, ["dataset", "pool"])


QUERIES["sheet_round_trip"] = sheet_round_trip
ORACLE_SQL["sheet_round_trip"] = "SELECT DISTINCT p_name AS dataset, p_brand AS pool, NULL::VARCHAR AS zh FROM part WHERE p_size % 9 <> 0"


def dictionary_document(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary as one document, and its datasets as they are read from it."""
    d, path = stored(parts(spark, sf), "parts"), _path(spark, "dictionary")
    first = lambda *key: d.groupBy(*key).agg(F.min("ordinal").alias("ordinal"))
    none = F.lit(None).cast("string")
    levels = {
        "base_work_types": first("work_type").select("ordinal", F.col("work_type").alias("work_type_en"), none.alias("work_type_zh"), F.col("ordinal").cast("int").alias("no")),
        "categories": first("work_type", "category").select("ordinal", F.col("work_type").alias("work_type_en"), F.col("category").alias("category_en"), none.alias("category_zh")),
        "pools": first("pool").select("ordinal", F.col("pool").alias("pool_en"), none.alias("pool_zh")),
        "datasets": d.select("ordinal", F.col("work_type").alias("work_type_en"), F.col("category").alias("category_en"), F.col("pool").alias("pool_en"), F.col("dataset").alias("dataset_en"), none.alias("dataset_zh"), none.alias("dataset_zh_short")),
    }
    catalog.write_dictionary(levels, first("pool").select(F.col("pool").alias("pool_en"), F.create_map(F.lit("unit"), F.col("pool")).alias("fields")), path)
    back = catalog.read_dictionary(spark, path)
    unit = back["attributes"].select("pool_en", F.try_element_at("fields", F.lit("unit")).alias("unit"))
    return back["datasets"].join(unit, "pool_en").select("work_type_en", "category_en", "pool_en", "dataset_en", "unit")


QUERIES["dictionary_document"] = dictionary_document
ORACLE_SQL["dictionary_document"] = f"WITH {PARTS} SELECT work_type AS work_type_en, category AS category_en, pool AS pool_en, dataset AS dataset_en, pool AS unit FROM d"


def graph_document(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "graph")
    catalog.export_graph(*_knowledge(spark, sf), path)
    return spark.read.schema("src string, dst string, type string, weight double").json(f"{path}/edges")


QUERIES["graph_document"] = graph_document
ORACLE_SQL["graph_document"] = TABLE_ORACLE["kg_build"]


def result_document(spark: SparkSession, sf: str) -> DataFrame:
    """The ten dearest parts as a JSON document, taken apart again."""
    top = table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_name").limit(10).select(F.col("p_name").alias("name"), (F.col("p_retailprice").cast("double") / 3000).alias("s"))
    doc = catalog.results_json(top, "dear").select(F.from_json("document", "query string, n int, results array<struct<rank:int,name:string,score:double>>").alias("d"))
    return doc.select("d.query", F.inline("d.results"))


QUERIES["result_document"] = result_document
ORACLE_SQL["result_document"] = "SELECT 'dear' AS query, row_number() OVER (ORDER BY p_retailprice DESC, p_name)::INT AS rank, p_name AS name, round(p_retailprice::DOUBLE / 3000, 4) AS score FROM part ORDER BY p_retailprice DESC, p_name LIMIT 10"


def fixed_pool_sheet(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("work_type"), F.col("p_brand").alias("category"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" "), "p_name")).alias("dataset"), F.col("p_partkey").alias("text_id"))
    return imports.fixed_pool_sheet(p, "Text data", "text_id")


QUERIES["import_fixed_pool"] = fixed_pool_sheet
ORACLE_SQL["import_fixed_pool"] = "SELECT p_partkey AS ordinal, p_type AS work_type, p_brand AS category, 'Text data' AS pool, CASE WHEN p_size % 3 <> 0 THEN p_name ELSE p_partkey::VARCHAR END AS dataset FROM part"


def build_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the parts are known and the tables of their pools are built; then the other half comes in."""
    d = parts(spark, sf)
    known, new = d.where("ordinal % 2 = 0"), d.where("ordinal % 2 = 1 and pool <> 'size 7'")
    path = _path(spark, "pools")
    tables = spark.createDataFrame([(f"size {k}", "pending") for k in range(9)] + [("size 99", "pending")], "pool string, status string")
    first = imports.build_pending(tables, known, path)
    merged, status = imports.incremental_import(known, new, first, path)
    rows = spark.read.parquet(path).groupBy("pool").agg(F.count("*").alias("n"))
    return status.join(rows, "pool", "left").select("pool", "status", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES["build_tables"] = build_tables
ORACLE_SQL["build_tables"] = f"""WITH {PARTS}, t AS (SELECT 'size ' || unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 99]) AS pool UNION SELECT pool FROM d WHERE ordinal % 2 = 1 AND pool <> 'size 7'),
    w AS (SELECT work_type, category, pool, dataset FROM d WHERE ordinal % 2 = 1 AND pool <> 'size 7' EXCEPT SELECT work_type, category, pool, dataset FROM d WHERE ordinal % 2 = 0),
    n AS (SELECT pool, count(*) AS n FROM (SELECT pool FROM d WHERE ordinal % 2 = 0 UNION ALL SELECT pool FROM w) GROUP BY 1)
    SELECT pool, CASE WHEN n IS NULL THEN 'failed' ELSE 'created' END AS status, coalesce(n, 0) AS n FROM t LEFT JOIN n USING (pool)"""
QUERIES["register_keys"] = lambda spark, sf: parts(spark, sf).select("ordinal", joined_key("work_type", "pool", "dataset").alias("joined"))
ORACLE_SQL["register_keys"] = f"WITH {PARTS} SELECT ordinal, concat_ws(' | ', work_type, pool, dataset) AS joined FROM d"
QUERIES["impute_priority"] = lambda spark, sf: impute.fill_by_priority(gappy(spark, sf), ("nearest", "linear", "ffill"))[0].select("id", *_r("filled"))
ORACLE_SQL["impute_priority"] = SERIES_ORACLE["impute_nearest"]


def corr_network(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = stats.network(stats.pearson(_items(spark, sf), NUMBERS))
    return nodes.select(F.lit("node").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"), F.round("size", 3).alias("size")).unionByName(edges.select(F.lit("edge").alias("kind"), "a", "b", F.round("width", 6).alias("size")))


QUERIES["corr_network"] = corr_network
ORACLE_SQL["corr_network"] = f"""WITH c AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}::DOUBLE, {b}::DOUBLE)) AS r FROM lineitem" for k, a in enumerate(NUMBERS) for b in NUMBERS[k + 1:])}),
    m AS (SELECT a, avg(r) AS s FROM (SELECT a, r FROM c UNION ALL SELECT b, r FROM c) GROUP BY 1)
    SELECT 'node' AS kind, a, '' AS b, round(300 + 700 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 3) AS size FROM m UNION ALL SELECT 'edge', a, b, round(0.5 + 8 * r, 6) FROM c"""
#: For kg_propagation, which is with the catalog queries.
PROPAGATION_SQL = f"""WITH p AS ({TABLE_ORACLE['kg_causal_trace']}), s AS (SELECT root, node AS last, score, string_split(path, ' → ') AS way FROM p),
    e AS (SELECT score, unnest(way) AS dst, unnest(list_append(way[2:], NULL)) AS src, generate_subscripts(way, 1) - 1 AS k FROM s)
    SELECT src, dst, round(max(score * 0.9 ** k), 6) AS weight FROM e WHERE src IS NOT NULL GROUP BY 1, 2"""


def closed_loop(spark: SparkSession, sf: str) -> DataFrame:
    """A batch through the phases; the one that fails leaves what came before it."""
    loop = streams.ClosedLoop(collect=lambda df: df.where("v > 0"), preprocess=lambda df: df.withColumn("v", F.col("v") * 2), analyse=lambda df: df.select("no such column"), decide=lambda df: df.withColumn("act", F.col("v") > 100), feedback=lambda df: df.groupBy("series", "act").agg(F.count("*").alias("n")))
    return loop(series(spark, sf))


QUERIES["closed_loop"] = closed_loop
ORACLE_SQL["closed_loop"] = f"WITH {SERIES_SQL} SELECT series, v * 2 > 100 AS act, count(*) AS n FROM s WHERE v > 0 GROUP BY 1, 2"


def bus_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of the events through a filter and a transformer."""
    e = table(spark, sf, "events")
    m = mapping.messages(e, F.lit("event"), F.col("event_type"), F.lit("test"), F.col("ts"))
    only = F.col("channel") != "click"
    return streams.bus(m, only, lambda df: df.withColumn("payload", F.get_json_object("payload", "$.event_id"))).select("channel", F.col("payload").cast("long").alias("event_id"))


QUERIES["bus_functions"] = bus_functions
ORACLE_SQL["bus_functions"] = "SELECT event_type AS channel, event_id FROM events WHERE event_type <> 'click'"
QUERIES["series_pipeline"] = lambda spark, sf: preprocessing.run(gappy(spark, sf)).select("id", *_r("v", digits=4))
_FILLED = f"s AS (SELECT g.series, g.t, g.id, l.filled AS v FROM (WITH {GAPPY_SQL} SELECT * FROM s) g JOIN ({SERIES_ORACLE['impute_linear']}) l USING (id))"
ORACLE_SQL["series_pipeline"] = f"""WITH {_FILLED}, e AS ({SERIES_ORACLE['outlier_ensemble'].replace(SERIES_SQL, _FILLED)}), m AS (SELECT series, median(v) FILTER (NOT is_outlier) AS med FROM s JOIN e USING (id) GROUP BY 1),
    f AS (SELECT s.id, s.series, CASE WHEN is_outlier THEN med ELSE v END AS v FROM s JOIN e USING (id) JOIN m USING (series))
    SELECT id, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 4) AS v FROM f WINDOW w AS (PARTITION BY series)"""
