"""Queries of the models, attributions, task texts, attention and made tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.functions.storage import stored
from tuyere.operators import attention, attention_training, attribution, boosting, dictionary, graph, models, semantic
from tuyere.plans.series_queries import _r
from tuyere.plans.table_queries import PARTS, _graph, parts
from tuyere.sources import synthetic
from tuyere.sources.testdata import table

QUERIES, ORACLE_SQL = {}, {}
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *[F.col(c).cast("double").alias(c) for c in NUMBERS], "l_returnflag")


_ITEMS = "i AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in NUMBERS) + " FROM lineitem)"

QUERIES["outlier_isolation_forest"] = lambda spark, sf: models.isolation_forest(_items(spark, sf), NUMBERS).select("id", *_r("iso_score"), "is_outlier")
QUERIES["normality"] = lambda spark, sf: models.normality(_items(spark, sf), NUMBERS).select("param", "n", "test", *_r("statistic", "p"), "is_normal")
QUERIES["shap_factorize"] = lambda spark, sf: attribution.factorize(_items(spark, sf).select("id", "l_returnflag"), "l_returnflag", "id")
ORACLE_SQL["shap_factorize"] = f"WITH {_ITEMS}, f AS (SELECT l_returnflag, row_number() OVER (ORDER BY min(id)) - 1 AS code FROM i WHERE l_returnflag IS NOT NULL GROUP BY 1) SELECT id, coalesce(code, -1)::DOUBLE AS l_returnflag FROM i LEFT JOIN f USING (l_returnflag)"


def shap_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid, then what each column adds to the predictions of the best choice, over all rows."""
    rows = stored(attribution.prepare(_items(spark, sf), FEATURES, "l_extendedprice"), "shap-rows")
    model = boosting.fit(rows.where("is_train"), FEATURES, "l_extendedprice")
    return attribution.importance(attribution.explain_cells(rows, model, FEATURES), FEATURES)


QUERIES["shap_ranking"] = shap_ranking

TEXT = "Show PROMO tin readings of Brand#13, size 3 and the trend of small copper"
TERMS = {"trend": "slope", "readings": "value", "absent": "none"}
QUERIES["query_parse"] = lambda spark, sf: semantic.parse_query(semantic.vocabulary(parts(spark, sf)), TEXT, TERMS)
ORACLE_SQL["query_parse"] = (
    f"WITH {PARTS}, w AS (SELECT 'work_type' AS level, work_type AS name, work_type AS alias FROM d UNION ALL SELECT 'pool', pool, pool FROM d UNION ALL SELECT 'category', category, unnest(regexp_split_to_array(category, ' - | -|- |-')) FROM d), "
    f"h AS (SELECT DISTINCT level, name FROM w WHERE trim(alias) <> '' AND contains(lower('{TEXT}'), lower(trim(alias)))), c AS (SELECT * FROM h WHERE level = 'category' ORDER BY name LIMIT 10) "
    f"SELECT level, name FROM h WHERE level <> 'category' UNION ALL SELECT level, name FROM c UNION ALL SELECT 'keyword', unnest(['slope', 'value', '{TEXT}'])"
)


def reply_json(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"work_type": "'), "p_type", F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    k = F.col("p_partkey") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(k == 2, F.concat(F.lit("I think "), body, F.lit(" fits."))).otherwise("no object {here")
    return semantic.parse_replies(table(spark, sf, "part").select("p_partkey", reply.alias("reply")), "reply", "work_type string, size int").select("p_partkey", "parsed.work_type", "parsed.size")


QUERIES["reply_json"] = reply_json
ORACLE_SQL["reply_json"] = "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_type END AS work_type, CASE WHEN p_partkey % 4 < 3 THEN p_size END AS size FROM part"


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("template_id"), F.col("n_name").alias("name_en"), (F.col("n_nationkey") < 6).alias("built_in"))


def template_changes(spark: SparkSession, sf: str) -> DataFrame:
    t = _templates(spark, sf)
    new = t.where("template_id in ('t3', 't7', 't8')").withColumn("name_en", F.concat(F.lit("new "), "name_en"))
    return semantic.delete_templates(semantic.put_templates(t, new), ["t1", "t9"])


QUERIES["template_changes"] = template_changes
ORACLE_SQL["template_changes"] = "SELECT 't' || n_nationkey AS template_id, CASE WHEN n_nationkey IN (7, 8) THEN 'new ' || n_name ELSE n_name END AS name_en, n_nationkey < 6 AS built_in FROM nation WHERE n_nationkey <> 9"

QUERIES["kg_features"] = lambda spark, sf: attention.features(*_graph(spark, sf)[1:]).select("id", F.get("x", F.lit(5)).alias("n_in"), F.get("x", F.lit(6)).alias("n_out"), F.get("x", F.lit(7)).alias("level"))
_E = "SELECT DISTINCT * FROM (SELECT 'wt:' || work_type AS src, 'cat:' || category AS dst FROM d UNION ALL SELECT 'cat:' || category, 'ds:' || dataset FROM d UNION ALL SELECT 'pool:' || pool, 'ds:' || dataset FROM d"
for _g in ("category", "pool"):
    _E += f" UNION ALL SELECT 'ds:' || a.dataset, 'ds:' || b.dataset FROM r_{_g} a JOIN r_{_g} b ON a.{_g} = b.{_g} AND b.r BETWEEN a.r + 1 AND a.r + 9"
_RANKS = ", ".join(f"r_{g} AS (SELECT * FROM (SELECT {g}, dataset, row_number() OVER (PARTITION BY {g} ORDER BY min(ordinal), dataset) AS r FROM d GROUP BY 1, 2) WHERE r <= 50)" for g in ("category", "pool"))
ORACLE_SQL["kg_features"] = (
    f"WITH {PARTS}, {_RANKS}, e AS ({_E})), v AS (SELECT DISTINCT 'wt:' || work_type AS id, 1 AS l FROM d UNION SELECT 'cat:' || category, 2 FROM d UNION SELECT 'pool:' || pool, 3 FROM d UNION SELECT 'ds:' || dataset, 4 FROM d), "
    "a AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1), b AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1) "
    "SELECT id, least(coalesce(a.n, 0), 50) / 50.0::DOUBLE AS n_in, least(coalesce(b.n, 0), 50) / 50.0::DOUBLE AS n_out, l / 4.0::DOUBLE AS level FROM v LEFT JOIN a USING (id) LEFT JOIN b USING (id)"
)


def kg_attention(spark: SparkSession, sf: str) -> DataFrame:
    """One layer of four heads, 16 wide, over the dictionary graph."""
    _, nodes, edges = _graph(spark, sf)
    return attention.attend(attention.features(nodes, edges), edges, attention.random_layer(8)).select("id", F.round(F.get("x", F.lit(0)), 6).alias("first"), F.size("x").alias("width"))


QUERIES["kg_attention"] = kg_attention

#: Steps of training in the query; the operator's own default is 200, each of which takes five rounds of messages.
EPOCHS, RATE = 10, 0.02


def kg_link_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two layers of attention trained on the dictionary graph, and the pairs of datasets that its vectors link but no edge does."""
    _, nodes, edges = _graph(spark, sf)
    known = edges.where(F.col("type").isin(*attention_training.ATTEND))
    found = attention_training.graph_of(attention.features(nodes, edges), known)
    pairs = attention_training.examples(nodes, edges, edges.where(F.col("type").isin(*attention_training.EXAMPLES)))
    model, _ = attention_training.train(found, pairs, epochs=EPOCHS, rate=RATE)
    vectors = attention_training.embed(found, model).join(nodes.where("type = 'dataset'").select("id"), "id", "left_semi")
    return graph.link_candidates(vectors, edges).select("a", "b", *_r("p"))


QUERIES["kg_link_scores"] = kg_link_scores
QUERIES["made_furnace"] = lambda spark, sf: synthetic.furnace(spark, 1000)
QUERIES["made_patterns"] = lambda spark, sf: synthetic.patterns(spark, 1000)
QUERIES["made_series"] = lambda spark, sf: synthetic.series(table(spark, sf, "supplier").select(F.col("s_name").alias("id")), 100)
QUERIES["made_scenario"] = lambda spark, sf: synthetic.scenario(dictionary.chain_filter(parts(spark, sf), pool="size 3"), "transition")
QUERIES["made_rows"] = lambda spark, sf: synthetic.fake_rows(spark, [("id", "bigint"), ("top_temperature", "double"), ("sample_time", "timestamp"), ("status", "string"), ("count", "int")], 500)
