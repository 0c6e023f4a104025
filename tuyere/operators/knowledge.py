"""The knowledge graph of a dictionary: building, access, subgraphs and anomaly marks (G-01 to G-08).

Nodes are (id, type, name, level); edges are (src, dst, type, weight), one per pair. An entry's id has its kind and its place
among the entries of that kind, in the order of the dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import chunked, numbered
from tuyere.functions.storage import stored
from tuyere.operators.graph import descendants, induced


def _entries(rows: DataFrame, kind: str, key: list[str], name: str, level: int) -> DataFrame:
    """The distinct keys with id, type, name and level; as many rows as the level has entries."""
    firsts = rows.groupBy(*key).agg(F.min("ordinal").cast("long").alias("o")).withColumn("one", F.lit(1))
    firsts = numbered(firsts, "one", "o", ["o", *key])
    return firsts.withColumn("id", F.concat(F.lit(f"{kind}_"), (F.col("_i") + 1).cast("string"))).select("id", F.lit(kind).alias("type"), F.col(name).alias("name"), F.lit(level).alias("level"), *[F.col(k).alias(f"_{k}") for k in key])


def build(d: DataFrame, templates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from rows (work_type, category, pool, dataset, ordinal), a dataset per row, and the pools' attributes
    (pool, attribute, ordinal). Datasets that follow each other in a category are linked with half the weight."""
    wt = _entries(d, "work_type", ["work_type"], "work_type", 0)
    cat = _entries(d, "category", ["work_type", "category"], "category", 1)
    pool = _entries(d, "pool", ["pool"], "pool", 2)
    ds = d.select(F.concat(F.lit("dataset_"), F.col("ordinal").cast("string")).alias("id"), F.lit("dataset").alias("type"), F.col("dataset").alias("name"), F.lit(3).alias("level"), "work_type", "category", "pool", "ordinal")
    plain = ["id", "type", "name", "level"]
    levels = [wt, cat, pool, ds]
    edge = lambda rows, src, dst, kind, weight=1.0: rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))
    of = lambda rows, name: rows.select(F.col("id").alias(name), *[c for c in rows.columns if c.startswith("_")])
    edges = [edge(of(cat, "c").join(of(wt, "w"), "_work_type"), "w", "c", "hierarchical")]
    placed = ds.join(of(cat, "c"), (F.col("work_type") == F.col("_work_type")) & (F.col("category") == F.col("_category"))).join(of(pool, "p"), F.col("pool") == F.col("_pool"), "left")
    edges += [edge(placed, "c", "id", "hierarchical"), edge(placed.where("p is not null"), "id", "p", "cross")]
    next_one = F.lead("id").over(Window.partitionBy("c", "_c").orderBy("_i"))
    ordered = chunked(placed.select("c", "id", "ordinal"), "c", "ordinal", ["ordinal", "id"], 0, 1)
    edges.append(edge(ordered.withColumn("next", next_one).where("_home and next is not null"), "id", "next", "cross", 0.5))
    if templates is not None:
        attr = _entries(templates, "attribute", ["pool", "attribute"], "attribute", 4)
        levels.append(attr)
        edges.append(edge(of(attr, "a").join(of(pool, "p"), "_pool"), "p", "a", "hierarchical"))
    return reduce(DataFrame.unionByName, [x.select(*plain) for x in levels]), reduce(DataFrame.unionByName, edges)


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def children(edges: DataFrame, ids: DataFrame, kind: str | None = None) -> DataFrame:
    """id, child: what the edges (of one type) lead to."""
    e = edges if kind is None else edges.where(F.col("type") == kind)
    return e.select(F.col("src").alias("id"), F.col("dst").alias("child")).join(ids.select("id").distinct(), "id")


def parents(edges: DataFrame, ids: DataFrame, kind: str | None = None) -> DataFrame:
    """id, parent: where the edges (of one type) come from."""
    e = edges if kind is None else edges.where(F.col("type") == kind)
    return e.select(F.col("dst").alias("id"), F.col("src").alias("parent")).join(ids.select("id").distinct(), "id")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi"), induced(nodes, edges, ids.select("id").distinct())


def subgraph_of_work_type(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """The work type and all that hangs from it."""
    start = node(nodes, node_id).select("id")
    below = descendants(edges.where("type = 'hierarchical'"), start).select("id")
    return subgraph(nodes, edges, start.unionByName(below))


def subgraph_of_pool(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """The pool, its datasets, what these hang from, and the pool's attributes."""
    start = node(nodes, node_id).select("id")
    datasets = parents(edges, start, "cross").select(F.col("parent").alias("id"))
    above = parents(edges, datasets, "hierarchical").select(F.col("parent").alias("id"))
    attributes = children(edges, start, "hierarchical").select(F.col("child").alias("id"))
    return subgraph(nodes, edges, reduce(DataFrame.unionByName, [start, datasets, above, attributes]))


def mark_anomalies(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """nodes with is_anomaly and anomaly_score: those of scores (id, score) are marked, all others keep what they have."""
    base = nodes if "is_anomaly" in nodes.columns else nodes.withColumn("is_anomaly", F.lit(False)).withColumn("anomaly_score", F.lit(0.0))
    new = scores.groupBy("id").agg(F.max("score").alias("_new"))
    return base.join(new, "id", "left").withColumn("is_anomaly", F.col("is_anomaly") | F.col("_new").isNotNull()).withColumn("anomaly_score", F.coalesce("_new", "anomaly_score")).drop("_new")


def clear_anomalies(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No node is marked, and no propagation edge is left."""
    return nodes.withColumn("is_anomaly", F.lit(False)).withColumn("anomaly_score", F.lit(0.0)), edges.where("type <> 'propagation'")


def put_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the new ones in place of those of the same pair; of new ones of a pair the heaviest counts. The pairs are as
    many as the rows, so they are merged: by the size of a well compressed file, Spark would take them for few and broadcast them."""
    best = stored(new.groupBy("src", "dst").agg(F.max_by(F.struct("type", "weight"), "weight").alias("e")).select("src", "dst", "e.*"), "knowledge-new")
    return edges.join(best.select("src", "dst").hint("merge"), ["src", "dst"], "left_anti").unionByName(best.select(edges.columns))


def near(edges: DataFrame, ids: DataFrame, hops: int = 2) -> DataFrame:
    """id, hops: the nodes at most so many steps from the given ones, whatever the edges' direction."""
    ways = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("id"), F.col("src").alias("to")))
    steps = edges.select(F.explode(ways).alias("e")).select("e.*").distinct()
    seen = ids.select("id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        front = front.select("id").join(steps, "id").select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def heaviest(nodes: DataFrame, edges: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """The graph cut to the nodes with most edges, by id among equals, to be drawn."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    kept = nodes.join(ends, "id", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), "id").limit(most).select("id")
    return subgraph(nodes, edges, kept)
