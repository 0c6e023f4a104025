"""Places of a graph's nodes in layers, to be drawn (G-20): rows instead of pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import numbered
from tuyere.functions.inversions import inversions
from tuyere.functions.storage import stored


def first_children(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The graph with at most so many children of a type for each parent, the first by id, and their edges; nodes without a
    parent stay. A child that one of its parents keeps stays, with the edges of the parents that keep it."""
    nodes, edges = stored(nodes, "layout-nodes"), stored(edges, "layout-graph")  # each is used several times, and a graph may be long in the making
    kinds = nodes.select(F.col("id").alias("dst"), F.col("type").alias("kind"))
    order = Window.partitionBy("src", "kind").orderBy(F.length("dst"), "dst")
    kept = edges.join(kinds, "dst").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(*edges.columns)
    kept = stored(kept, "layout-edges")
    roots = nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id")
    left = stored(nodes.join(roots.unionByName(kept.select(F.col("dst").alias("id"))).distinct(), "id", "left_semi"), "layout-left")
    return left, kept.join(left.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)


def _links(places: DataFrame, edges: DataFrame) -> DataFrame:
    """la, a, pa, lb, b, pb: the edges between two levels, the upper one first, with the places of their ends."""
    end = lambda c: places.select(F.col("id").alias(c), F.col("level").alias(f"l{c}"), F.col("place").alias(f"p{c}"))
    both = edges.select("src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst").where("lsrc <> ldst")
    up = F.col("lsrc") < F.col("ldst")
    pick = lambda x, y, name: F.when(up, F.col(x)).otherwise(F.col(y)).alias(name)
    return both.select(pick("lsrc", "ldst", "la"), pick("src", "dst", "a"), pick("psrc", "pdst", "pa"), pick("ldst", "lsrc", "lb"), pick("dst", "src", "b"), pick("pdst", "psrc", "pb"))


def crossings(places: DataFrame, edges: DataFrame) -> int:
    """How many pairs of edges between the same two levels cross: inversions of their ends' places."""
    pair = (F.col("la") * 1000 + F.col("lb")).cast("double") * 1e9  # pairs of levels one after the other on both sides do not cross
    return inversions(_links(places, edges).groupBy((pair + F.col("pa")).alias("x"), (pair + F.col("pb")).alias("y")).agg(F.count("*").alias("w")))


def _placed(rows: DataFrame, by: str) -> DataFrame:
    """Numbers the nodes of each level by the order column, then by the place they had."""
    order = rows.withColumn("t", (F.col(by) * 1_000_000).cast("long"))
    return numbered(order, "level", "t", [by, "place", "id"]).select("id", "type", "level", F.col("_i").alias("place"))


def layered(nodes: DataFrame, edges: DataFrame, sweeps: int = 6) -> DataFrame:
    """id, type, level, place, x, y: every level's nodes in a row, in the order that crosses fewest edges among those tried.

    Nodes (id, type, level) start in the order of their ids. A sweep orders all levels at once by the median of their nodes'
    neighbours (places as shares of a level): of those above, then of those below, in turn; nodes without such neighbours keep
    their share. A sweep is one join and one numbering, whatever the number of levels."""
    edges = stored(edges.select("src", "dst").distinct(), "layout-edges")
    start = nodes.select("id", "type", "level", F.length("id").cast("double").alias("o"), F.lit(0).cast("long").alias("place"))
    places = stored(_placed(start, "o"), "layout")
    best, fewest = places, crossings(places, edges)
    for sweep in range(sweeps):
        sizes = places.groupBy("level").agg(F.count("*").alias("n"))  # a row a level
        here, there, of = ("b", "pa", "la") if sweep % 2 == 0 else ("a", "pb", "lb")
        links = _links(places, edges).join(F.broadcast(sizes.withColumnRenamed("level", of)), of)
        share = links.groupBy(F.col(here).alias("id")).agg(F.median((F.col(there) + 0.5) / F.col("n")).alias("m"))
        own = places.join(F.broadcast(sizes), "level").join(share, "id", "left")
        places = stored(_placed(own.select("id", "type", "level", "place", F.coalesce("m", (F.col("place") + 0.5) / F.col("n")).alias("o")), "o"), "layout")
        now = crossings(places, edges)
        if now < fewest:
            best, fewest = places, now
    sizes = best.groupBy("level").agg(F.count("*").alias("n"))
    return best.join(F.broadcast(sizes), "level").select("id", "type", "level", "place", ((F.col("place") + 0.5) / F.col("n")).alias("x"), (-F.col("level")).cast("double").alias("y"))
