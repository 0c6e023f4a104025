"""Dictionary graphs: building, scores by message passing, subgraphs, anomalies and causal traces (F-03 to F-09, G family).

Nodes are (id, type, ...); edges are (src, dst, type, weight), one per pair: of several the last by seq counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import numbered
from tuyere.functions.storage import stored

# What an edge of a type passes on, forwards and in a trace.
PASS = {"hierarchical": 1.0, "cross": 0.8, "co_category": 0.3, "co_pool": 0.3}
TRACE = {"propagation": 1.0, "coupling": 0.8, "hierarchical": 0.6, "cross": 0.4}


def nodes_of(d: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """id, type, name of all entries, and of the attributes (pool, attribute) if they are given."""
    levels = [("work_type", F.concat(F.lit("wt:"), "work_type")), ("category", F.concat(F.lit("cat:"), "category")), ("pool", F.concat(F.lit("pool:"), "pool")), ("dataset", F.concat(F.lit("ds:"), "dataset"))]
    rows = [d.select(i.alias("id"), F.lit(t).alias("type"), F.col(t).alias("name")).distinct() for t, i in levels]
    if templates is not None:
        rows.append(templates.select(F.concat(F.lit("attr:"), "pool", F.lit("::"), "attribute").alias("id"), F.lit("attribute").alias("type"), F.col("attribute").alias("name")).distinct())
    return reduce(lambda a, b: a.unionByName(b), rows)


def edges_of(d: DataFrame, most: int = 50, reach: int = 9, templates: DataFrame | None = None) -> DataFrame:
    """Hierarchy and cross edges, also from pools to their attributes, and links of datasets of one category or pool: of the
    first ``most`` by order, each with the next ``reach``. A later kind replaces an earlier one on the same pair."""
    wt, cat, pool, ds = (F.concat(F.lit(p), c) for p, c in (("wt:", "work_type"), ("cat:", "category"), ("pool:", "pool"), ("ds:", "dataset")))
    kinds = [(wt, cat, "hierarchical"), (cat, ds, "hierarchical"), (pool, ds, "cross")]
    parts = [d.select(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"), F.lit(k).alias("seq")) for k, (a, b, t) in enumerate(kinds)]
    if templates is not None:
        parts.append(templates.select(F.concat(F.lit("pool:"), "pool").alias("src"), F.concat(F.lit("attr:"), "pool", F.lit("::"), "attribute").alias("dst"), F.lit("cross").alias("type"), F.lit(2).alias("seq")))
    for k, (group, t) in enumerate((("category", "co_category"), ("pool", "co_pool"))):
        firsts = d.groupBy(group, "dataset").agg(F.min("ordinal").alias("o"))
        firsts = firsts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("o", "dataset"))).where(F.col("r") <= most)
        steps = firsts.select(group, F.concat(F.lit("ds:"), "dataset").alias("src"), F.explode(F.sequence(F.col("r") + 1, F.col("r") + reach)).alias("r"))
        parts.append(steps.join(firsts.select(group, "r", F.concat(F.lit("ds:"), "dataset").alias("dst")), [group, "r"]).select("src", "dst", F.lit(t).alias("type"), F.lit(3 + k).alias("seq")))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("src", "dst").agg(F.max_by("type", "seq").alias("type"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n").unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def initial_scores(d: DataFrame, nodes: DataFrame, work_types: list[str], categories: list[str], pools: list[str], keywords: list[str]) -> DataFrame:
    """id, s: what the task names scores high; a dataset gains by its parents and its keywords, up to 1."""
    yes = lambda c, names: F.coalesce(F.col(c).isin(names), F.lit(False)) if names else F.lit(False)
    parents = d.groupBy("category").agg(F.max(yes("work_type", work_types)).alias("p")).select(F.concat(F.lit("cat:"), "category").alias("id"), "p")
    hits = reduce(lambda a, b: a + b, [F.lower("dataset").contains(k.lower()).cast("int") for k in keywords], F.lit(0))
    gain = 0.05 + 0.5 * yes("work_type", work_types).cast("int") + 0.3 * yes("category", categories).cast("int") + 0.2 * yes("pool", pools).cast("int") + 0.3 * hits
    own = d.groupBy(F.concat(F.lit("ds:"), "dataset").alias("id")).agg(F.least(F.lit(1.0), F.max(gain)).alias("g"))
    rows = nodes.join(parents, "id", "left").join(own, "id", "left")
    s = (
        F.when(F.col("type") == "work_type", F.when(yes("name", work_types), 1.0).otherwise(0.05))
        .when(F.col("type") == "category", F.when(yes("name", categories), 0.8).when(F.col("p"), 0.5).otherwise(0.1))
        .when(F.col("type") == "pool", F.when(yes("name", pools), 0.7).otherwise(0.05))
        .otherwise(F.coalesce("g", F.lit(0.0)))
    )
    return rows.select("id", "type", "name", s.alias("s"))


def pass_messages(scores: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """Each hop moves a score by a tenth towards six parts of itself and four of its neighbours' mean; what comes against an
    edge counts half. Nodes without neighbours keep theirs. Messages are summed before the shuffle; the steps and each hop's
    scores are stored, so that no hop computes the ones before it again."""
    w = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), list(PASS.items())[1:], F.when(F.col("type") == "hierarchical", 1.0))
    ways = F.array(F.struct("src", "dst", w.alias("w")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), (w * 0.5).alias("w")))
    both = stored(edges.select(F.explode(ways).alias("e")).select("e.*"), "graph-steps")
    for _ in range(hops):
        scores = stored(scores, "graph-scores")
        got = both.join(scores.select(F.col("id").alias("src"), "s"), "src").groupBy(F.col("dst").alias("id")).agg(F.avg(F.col("s") * F.col("w")).alias("m"))
        scores = scores.join(got, "id", "left").withColumn("s", F.when(F.col("m").isNull(), F.col("s")).otherwise(F.col("s") + 0.1 * (0.6 * F.col("s") + 0.4 * F.col("m") - F.col("s")))).drop("m")
    return scores


def rank(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.where("type = 'dataset'").select("name", F.round("s", 6).alias("s")).orderBy(F.desc("s"), "name").limit(k)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, n_in, n_out."""
    n_in, n_out = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in")), edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    return nodes.join(n_in, "id", "left").join(n_out, "id", "left").select("id", "type", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among the ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """root, id, hops: all that is reached from each start, in the fewest steps, by frontier joins until nothing is new."""
    steps = edges.select(F.col("src").alias("id"), "dst").distinct()
    front = stored(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("hops")).distinct(), "graph-front")
    seen, k = front, 0
    while not front.isEmpty():
        k += 1
        reached = front.select("root", "id").join(steps, "id").select("root", F.col("dst").alias("id")).distinct()
        front = stored(reached.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hops", F.lit(k)), "graph-front")
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def degree_anomalies(nodes: DataFrame, edges: DataFrame, threshold: float = 2.0) -> DataFrame:
    """id, z: nodes whose degree is further than that from the mean of their type, in population deviations."""
    deg = degrees(nodes, edges).select("id", "type", (F.col("n_in") + F.col("n_out")).alias("d"))
    s = deg.groupBy("type").agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("sd"))
    return deg.join(s, "type").select("id", "type", F.round(F.try_divide(F.abs(F.col("d") - F.col("m")), F.col("sd")), 6).alias("z")).where(F.col("z") > threshold)


def data_anomalies(series: DataFrame, threshold: float = 2.5) -> DataFrame:
    """series, z, score, is_anomaly of the last value against all."""
    s = series.where("v is not null").groupBy("series").agg(F.max_by("v", F.struct("t", "id")).alias("last"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")).where("sd >= 1e-10")
    z = F.abs(F.col("last") - F.col("m")) / F.col("sd")
    return s.select("series", F.round(z, 6).alias("z"), F.round(F.least(z / 5, F.lit(1.0)), 6).alias("score"), (z > threshold).alias("is_anomaly"))


def representative(front: DataFrame, left: int, many: int = 1_000_000) -> DataFrame:
    """Of the paths (root, node, score, path, hop_count) to one node those that the best simple path of ``left`` more steps can
    begin with: for any set of that many nodes to come, the best path that avoids them. That is the best path; for each node
    between its ends the best one without it; and so on, one node more at each of ``left`` turns. With the few hops of a trace
    these are less than ten paths, however many there are. More than ``many`` paths are thinned out in eight lots first, so
    that no task has all paths to a node that much leads to."""

    def keep(key, table):
        import pyarrow as pa

        scores, paths = table.column("score").to_pylist(), table.column("path").to_pylist()
        order = sorted(range(len(paths)), key=lambda k: (scores[k], " → ".join(paths[k])), reverse=True)
        sets = [(k, frozenset(paths[k][1:-1])) for k in order]
        kept, todo = set(), {frozenset()}
        for turn in range(left + 1):
            new = set()
            for avoid in todo:
                best = next(((k, nodes) for k, nodes in sets if not nodes & avoid), None)
                if best:
                    kept.add(best[0])
                    new |= {avoid | {x} for x in best[1]}
            todo = new
        return table.take(pa.array(sorted(kept)))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in front.schema)
    lots = [8, 1] if front.count() > many else [1]
    for n in lots:
        front = front.groupBy("root", "node", F.pmod(F.xxhash64("path"), F.lit(n)).alias("lot")).applyInArrow(keep, kind)
    return front


def trace(edges: DataFrame, roots: DataFrame, anomalous: DataFrame, hops: int = 5, least: float = 0.3, keep: int = 10, stop_types: DataFrame | None = None, many: int = 100_000) -> DataFrame:
    """root, node, score, hop_count, path: best simple path to each node, going against edges, a fifth more where the neighbour
    is anomalous, a tenth less each step, and never below ``least``; the ``keep`` best endpoints of each root.

    Each hop's paths are stored, and where they are more than ``many`` only those that a best path can begin with go on: the
    work grows with edges times hops, not with the number of paths, and the result is the same."""
    w = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), list(TRACE.items())[1:], F.when(F.col("type") == "propagation", 1.0)).otherwise(0.3)
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("to"), (F.col("weight") * w).alias("w"))
    coupled = edges.where("type = 'coupling'").select(F.col("src").alias("node"), F.col("dst").alias("to"), (F.col("weight") * 0.8).alias("w"))
    steps = stored(back.unionByName(coupled).join(anomalous.select(F.col("id").alias("to"), F.lit(0.2).alias("plus")), "to", "left"), "trace-steps")
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(1.0).alias("score"), F.array("id").alias("path"), F.lit(0).alias("hop_count"))
    found = None
    for k in range(1, hops + 1):
        front = front.select("root", "node", "score", "path").join(steps, "node").where(~F.array_contains("path", F.col("to")))
        front = front.withColumn("score", (F.col("score") + F.coalesce("plus", F.lit(0.0))) * F.col("w") * 0.9).where(F.col("score") >= least)
        front = stored(front.select("root", F.col("to").alias("node"), "score", F.concat("path", F.array("to")).alias("path"), F.lit(k).alias("hop_count")), "trace-front")
        found = front if found is None else found.unionByName(front)
        n = front.count()  # of what is stored
        if k == hops or not n:
            break
        if stop_types is not None:
            front = front.join(stop_types.select(F.col("id").alias("node")), "node", "left_anti")
        if k > 1 and n > many:  # before that there is one path to each node
            front = stored(representative(front, hops - k), "trace-front")
    best = found.groupBy("root", "node").agg(F.max(F.struct("score", F.concat_ws(" → ", "path").alias("path"), "hop_count")).alias("x")).select("root", "node", F.round("x.score", 6).alias("score"), "x.hop_count", "x.path")
    order = Window.partitionBy("root").orderBy(F.desc("score"), "node")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r")


def propagation_edges(paths: DataFrame) -> DataFrame:
    """src, dst, weight: the steps of traced paths, from cause to effect, weaker by a tenth each."""
    steps = paths.select("score", F.posexplode(F.split("path", " → ")).alias("k", "node"), "root", F.col("node").alias("end"))
    w = Window.partitionBy("root", "end").orderBy("k")
    return steps.withColumn("src", F.lead("node").over(w)).where("src is not null").select("src", F.col("node").alias("dst"), (F.col("score") * F.pow(F.lit(0.9), "k")).alias("weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def link_candidates(vectors: DataFrame, edges: DataFrame, least: float = 0.7, most: int = 2000, keep: int = 50, seed: int = 42) -> DataFrame:
    """a, b, p: seeded random pairs that are not linked, by the logistic of their product, best first (a sampling operator).
    Vectors are numbered by the hash of their id; only the picked ones are read."""
    n = vectors.count()
    v = numbered(vectors.select("id").withColumn("one", F.lit(1)).withColumn("t", F.pmod(F.xxhash64("id"), F.lit(1 << 40))), "one", "t", ["t", "id"]).select("id", F.col("_i").alias("k"))
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(max(1, n)))
    picks = vectors.sparkSession.range(most).select(draw(0).alias("k"), draw(1).alias("l")).where("k < l").distinct()
    pairs = picks.join(v.select("k", F.col("id").alias("a")), "k").join(v.select(F.col("k").alias("l"), F.col("id").alias("b")), "l").select("a", "b")
    pairs = pairs.join(vectors.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(vectors.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    pairs = pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti").join(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")), ["a", "b"], "left_anti")
    dot = F.aggregate(F.zip_with("xa", "xb", lambda p, q: p * q), F.lit(0.0).cast("double"), lambda s, e: s + e)
    return pairs.select("a", "b", (1 / (1 + F.exp(-dot))).alias("p")).where(F.col("p") >= least).orderBy(F.desc("p"), "a", "b").limit(keep)
