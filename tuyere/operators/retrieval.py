"""Retrieval by task: a text, a template or a configuration to ranked datasets (F-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.operators import graph, semantic
from tuyere.operators.dictionary import retrieve_task

LEVELS = {"work_types": "work_type", "categories": "category", "pools": "pool", "keywords": "keyword"}


def query_by_config(d: DataFrame, config: dict[str, list[str]], top_k: int | None = None, templates: DataFrame | None = None, hops: int = 3) -> DataFrame:
    """The dictionary rows that a configuration (work_types, categories, pools, keywords) retrieves, with relevance and place.

    Relevance is the dataset's score in the whole dictionary's graph after message passing. Of equal scores (to nine digits)
    those found by category come before those found by pool, and then the order of the dictionary counts."""
    names = {k: list(config.get(k) or []) for k in LEVELS}
    found = retrieve_task(d, names["work_types"], names["categories"], names["pools"])
    by_category = F.coalesce(F.col("category").isin(names["categories"]), F.lit(False)) if names["categories"] and names["pools"] else F.lit(True)
    start = graph.initial_scores(d, graph.nodes_of(d, templates), names["work_types"], names["categories"], names["pools"], names["keywords"])
    scores = graph.pass_messages(start, graph.edges_of(d, templates=templates), hops).where("type = 'dataset'")
    rows = found.join(scores.select(F.col("name").alias("dataset"), F.round("s", 9).alias("relevance")), "dataset", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    order = [F.desc("relevance"), (~by_category).cast("int"), F.col("ordinal")]
    if top_k:
        rows = rows.orderBy(*order).limit(top_k)
        return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # no more rows than asked for
    return rows.orderBy(*order)


def query(d: DataFrame, text: str, terms: dict[str, str] | None = None, top_k: int | None = None, templates: DataFrame | None = None) -> DataFrame:
    """The rows that a text names; what it names is one short list per level."""
    named = semantic.parse_query(semantic.vocabulary(d), text, terms).groupBy("level").agg(F.sort_array(F.collect_list("name")).alias("names")).collect()
    config = {k: next((r.names for r in named if r.level == level), []) for k, level in LEVELS.items()}
    return query_by_config(d, config, top_k, templates)


def query_by_template(d: DataFrame, stored: DataFrame, template_id: str, top_k: int | None = None, templates: DataFrame | None = None) -> DataFrame:
    """The rows of a stored template's task_config; no row if there is no such template."""
    row = semantic.get_template(stored, template_id).select("task_config.*").first()
    if row is None:
        return query_by_config(d, {}, top_k, templates).where("false")
    return query_by_config(d, row.asDict(), top_k, templates)
