"""Training of the graph attention for link prediction (G-17), with the gradients as messages against the edges.

The graph's links are dealt to parts once, by their source; the links of a frequent source are spread over several parts.
A step is five rounds, and each stores what the nodes have got:

    forward 1, forward 2   vectors go to the parts that need them; a part adds its messages by target; partial softmax sums
                           (largest exponent, sum of weights, weighted sum) are merged at the targets
    pairs                  the logistic loss of linked and unlinked pairs, and the gradients of their vectors
    backward 2, backward 1 gradients go to the parts, which send them back to the sources; the nodes turn them into gradients
                           of the parameters, summed in Spark by position

Only the parameters, whose number does not depend on the graph, reach the driver, where Adam moves them. A part holds about
``LINKS`` links; a hub is a target with a row per part and a source in several parts, so no task has all its links.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.functions.frames import numbered
from tuyere.functions.storage import stored
from tuyere.operators.attention import random_layer

LINKS, SLOPE = 100_000, 0.2
#: Edges along which attention goes, and those that are examples of a link.
ATTEND, EXAMPLES = ("hierarchical", "cross", "coupling"), ("hierarchical", "cross")
VECTORS = "id long, vec array<double>"


@dataclass(frozen=True)
class Model:
    """The layers' weights, and the matrix between the two vectors of a pair."""

    layers: tuple[dict[str, np.ndarray], ...]
    pair: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x[k].ravel() for x in self.layers for k in ("W", "src", "dst")] + [self.pair.ravel()])

    def moved(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for old in [x[k] for x in self.layers for k in ("W", "src", "dst")] + [self.pair]:
            parts.append(flat[at : at + old.size].reshape(old.shape))
            at += old.size
        return Model(tuple(dict(zip(("W", "src", "dst"), parts[3 * k : 3 * k + 3], strict=True)) for k in range(len(self.layers))), parts[-1])

    def place(self, layer: int) -> tuple[int, int]:
        """Where a layer's weights, or after the last layer the pair's, begin and end."""
        sizes = [sum(v.size for v in x.values()) for x in self.layers] + [self.pair.size]
        return sum(sizes[:layer]), sum(sizes[: layer + 1])


def new_model(inputs: int, hidden: int = 16, outputs: int = 16, heads: int = 4, seed: int = 42) -> Model:
    return Model((random_layer(inputs, hidden, heads, seed), random_layer(hidden * heads, outputs, 1, seed + 1)), np.eye(outputs))


def elu(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v, np.expm1(np.minimum(v, 0)))


def elu_slope(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, 1.0, np.exp(np.minimum(v, 0)))


def project(layer: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A layer's vectors h by node and head, and their shares in the exponents of links from and to the node."""
    h = np.einsum("koi,ni->nko", layer["W"], x)
    return h, np.einsum("ko,nko->nk", layer["src"], h), np.einsum("ko,nko->nk", layer["dst"], h)


def exponents(s: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = s[a] + d[b]
    return raw, np.where(raw > 0, raw, SLOPE * raw)


def merge(at: np.ndarray, n: int, most: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Softmax sums by node: rows with equal ``at`` are brought to one largest exponent and added."""
    top = np.full((n, most.shape[1]), -np.inf)
    np.maximum.at(top, at, most)
    scale = np.exp(most - top[at])
    return top, added(at, n, weight * scale), added(at, n, total * scale[:, :, None])


def added(at: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((n, *rows.shape[1:]))
    np.add.at(out, at, rows)
    return out


def matrix(column, width: int = -1) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return np.asarray(column.combine_chunks().flatten(), float).reshape(len(column), width)


def vectors_of(ids: np.ndarray, rows: np.ndarray):
    """An Arrow table (id, vec)."""
    import pyarrow as pa

    rows = rows.reshape(len(ids), -1)
    return pa.table({"id": pa.array(ids, pa.int64()), "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.float64()))})


@dataclass
class Parts:
    """Links (part, a, b, y) dealt to parts, and which nodes each part needs."""

    links: DataFrame
    needs: DataFrame
    n: int

    @staticmethod
    def of(links: DataFrame, per_part: int) -> Parts:
        n = max(1, -(-links.count() // per_part))
        often = links.groupBy("a").agg(F.ceil(F.count("*") / per_part).alias("spread")).where("spread > 1")  # fewer than parts
        spread = links.join(F.broadcast(often), "a", "left")
        dealt = spread.select(F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("spread", F.lit(1)))), F.lit(n)).alias("part"), "a", "b", "y")
        dealt = stored(dealt, "attention-links")
        return Parts(dealt, stored(dealt.select("part", F.explode(F.array("a", "b")).alias("id")).distinct(), "attention-needs"), n)

    def send(self, states: DataFrame, act: Callable) -> DataFrame:
        """What the parts make of their links: act(vectors, a, b, y) gives (place among the vectors, row) pairs of arrays;
        a place of -1 is a row of gradients."""

        def run(states_here, links_here):
            ids = states_here.column("id").to_numpy()
            order = np.argsort(ids)
            ids, vectors = ids[order], matrix(states_here.column("vec"))[order]
            a, b = (np.searchsorted(ids, links_here.column(c).to_numpy()) for c in ("a", "b"))
            at, rows = act(vectors, a, b, links_here.column("y").to_numpy())
            return vectors_of(np.where(at < 0, -1, ids[at]), rows)

        sent = states.join(self.needs, "id").select("part", "id", "vec")
        return sent.groupBy("part").cogroup(self.links.groupBy("part")).applyInArrow(run, VECTORS)


def gather(states: DataFrame, partial: DataFrame, width: int, act: Callable, name: str) -> DataFrame:
    """The nodes' new states, stored: act(vectors, place of each partial row, partial rows of that width) gives the states and a row of
    gradients or None. Rows of gradients (negative ids) stay as they are."""

    def run(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        ids, own = rows.column("id").to_numpy(), rows.column("own").to_numpy()
        done = rows.filter(pa.array(ids < 0))
        if done.num_rows:
            yield from done.select(["id", "vec"]).to_batches()
        mine, got = rows.filter(pa.array(own & (ids >= 0))), rows.filter(pa.array(~own & (ids >= 0)))
        if not mine.num_rows:
            return
        ids = mine.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        at = np.searchsorted(ids, got.column("id").to_numpy())
        new, grads = act(matrix(mine.column("vec"))[order], at, matrix(got.column("vec"), width))
        yield from vectors_of(ids, new).to_batches()
        if grads is not None:
            yield from vectors_of(np.array([-1]), grads[None]).to_batches()

    both = states.select("id", "vec", F.lit(True).alias("own")).unionByName(partial.select("id", "vec", F.lit(False).alias("own")))
    return stored(both.repartition("id").mapInArrow(run, VECTORS), name)


def forward(states: DataFrame, parts: Parts, model: Model, k: int, at: int) -> DataFrame:
    """States get layer k's largest exponent, sum of weights and weighted mean behind what they hold; the layer's input is
    their values from ``at``, through the unit of the layer before if there is one."""
    layer = model.layers[k]
    heads, size, width = layer["W"].shape
    read = lambda v: elu(v[:, at : at + width]) if k else v[:, at : at + width]

    def messages(vectors, a, b, _):
        h, s, d = project(layer, read(vectors))
        _, e = exponents(s, d, a, b)
        seen, where = np.unique(b, return_inverse=True)
        top, weight, total = merge(where, len(seen), e, np.ones_like(e), h[a])
        return seen, np.concatenate([top, weight, total.reshape(len(seen), -1)], 1)

    def merged(vectors, where, rows):
        top, weight, total = merge(where, len(vectors), rows[:, :heads], rows[:, heads : 2 * heads], rows[:, 2 * heads :].reshape(-1, heads, size))
        return np.concatenate([vectors, top, weight, (total / weight[:, :, None]).reshape(len(vectors), -1)], 1), None

    return gather(states, parts.send(states.where("id >= 0"), messages), heads * (2 + size), merged, f"attention-forward-{k}")


def loss(states: DataFrame, pairs: Parts, model: Model, n: int, width: int) -> DataFrame:
    """States get the gradient of the last layer's sums; their last values are these sums. A gradients row has the loss last."""
    first, last = model.place(len(model.layers))

    def compare(vectors, a, b, y):
        z = elu(vectors[:, -width:])
        right = z @ model.pair.T  # of b
        logit = (z[a] * right[b]).sum(1)
        p = 1 / (1 + np.exp(-logit))
        g = (p - y) / n
        grads = np.zeros((1, last + 1))
        grads[0, first:last] = np.einsum("n,ni,nj->ij", g, z[a], z[b]).ravel()
        grads[0, last] = (np.logaddexp(0, logit) - y * logit).sum() / n
        sums = added(a, len(z), g[:, None] * right[b]) + added(b, len(z), g[:, None] * (z @ model.pair)[a])
        rows = np.zeros((len(z) + 1, last + 1))
        rows[:-1, :width], rows[-1] = sums, grads[0]
        return np.append(np.arange(len(z)), -1), rows

    def merged(vectors, where, rows):
        return np.concatenate([vectors, added(where, len(vectors), rows[:, :width]) * elu_slope(vectors[:, -width:])], 1), None

    return gather(states, pairs.send(states, compare), last + 1, merged, "attention-loss")


def backward(states: DataFrame, parts: Parts, model: Model, k: int, at: int, sums_at: int) -> DataFrame:
    """The gradients of layer k, and of the sums of the layer before, which replace the last values of the states. sums_at:
    where layer k's forward values begin; the gradient of its sums is the last of the state."""
    layer, total = model.layers[k], model.place(len(model.layers))[1] + 1
    heads, size, width = layer["W"].shape
    wide = heads * size
    read = lambda v: elu(v[:, at : at + width]) if k else v[:, at : at + width]

    def of_states(v):
        top, weight = v[:, sums_at : sums_at + heads], v[:, sums_at + heads : sums_at + 2 * heads]
        mean, grad = v[:, sums_at + 2 * heads : sums_at + 2 * heads + wide], v[:, -wide:]
        return top, weight, mean.reshape(-1, heads, size), grad.reshape(-1, heads, size)

    def messages(vectors, a, b, _):
        h, s, d = project(layer, read(vectors))
        top, weight, mean, grad = of_states(vectors)
        raw, e = exponents(s, d, a, b)
        share = np.exp(e - top[b]) / weight[b]
        pull = share * ((grad[b] * h[a]).sum(2) - (grad * mean).sum(2)[b])
        pull = np.where(raw > 0, pull, SLOPE * pull)
        to_source = added(a, len(vectors), (share[:, :, None] * grad[b]).reshape(len(a), -1))
        return np.arange(len(vectors)), np.concatenate([to_source, added(a, len(vectors), pull), added(b, len(vectors), pull)], 1)

    def merged(vectors, where, rows):
        x = read(vectors)
        h, _, _ = project(layer, x)
        sums = added(where, len(vectors), rows)
        dh, ds, dd = sums[:, :wide].reshape(-1, heads, size), sums[:, wide : wide + heads], sums[:, wide + heads :]
        dh = dh + ds[:, :, None] * layer["src"] + dd[:, :, None] * layer["dst"]
        grads = np.zeros(total)
        first, last = model.place(k)
        grads[first:last] = np.concatenate([np.einsum("nko,ni->koi", dh, x).ravel(), np.einsum("nk,nko->ko", ds, h).ravel(), np.einsum("nk,nko->ko", dd, h).ravel()])
        below = np.einsum("koi,nko->ni", layer["W"], dh) * elu_slope(vectors[:, at : at + width]) if k else np.empty((len(x), 0))
        return np.concatenate([vectors[:, :-wide], below], 1), grads

    return gather(states, parts.send(states.where("id >= 0"), messages), wide + 2 * heads, merged, f"attention-backward-{k}")


@dataclass
class Graph:
    """Numbered nodes with their input vectors, and the links along which attention goes (both ways, and to itself)."""

    names: DataFrame
    states: DataFrame
    parts: Parts
    inputs: int


def graph_of(features: DataFrame, edges: DataFrame, per_part: int = LINKS) -> Graph:
    """features: id, x; edges: src, dst. Nodes are numbered by the hash of their id."""
    order = features.select("id", "x", F.lit(1).alias("one"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("t"))
    names = stored(numbered(order, "one", "t", ["t", "id"]).select("id", F.col("_i").alias("k"), "x"), "attention-nodes")
    inputs = names.select(F.size("x")).first()[0]
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")
    links = _numbered_pairs(both, names).unionByName(names.select(F.col("k").alias("a"), F.col("k").alias("b"))).distinct().withColumn("y", F.lit(1.0))
    return Graph(names.select("id", "k"), names.select(F.col("k").alias("id"), F.col("x").alias("vec")), Parts.of(links, per_part), inputs)


def _numbered_pairs(pairs: DataFrame, names: DataFrame, *more: str) -> DataFrame:
    of = lambda c, k: names.select(F.col("id").alias(c), F.col("k").alias(k))
    return pairs.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("a", "b", *more)


def examples(nodes: DataFrame, edges: DataFrame, positive: DataFrame, most: int = 1500, seed: int = 42) -> DataFrame:
    """src, dst, y: the ``most`` positive pairs that come first by a seeded hash (a sample to fit on, as large as the graph
    allows up to that), and as many seeded random pairs that no edge joins."""
    lot = F.xxhash64(F.lit(seed), "src", "dst")
    linked = positive.select("src", "dst").distinct().orderBy(lot, "src", "dst").limit(most)
    n = linked.count()
    names = numbered(nodes.select("id", F.lit(1).alias("one"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("t")), "one", "t", ["t", "id"]).select("id", F.col("_i").alias("k"))
    size = nodes.count()
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(salt), "id"), F.lit(max(1, size)))
    picks = nodes.sparkSession.range(4 * n).select("id", draw(0).alias("k"), draw(1).alias("l")).where("k <> l")
    pairs = picks.join(names.select("k", F.col("id").alias("src")), "k").join(names.select(F.col("k").alias("l"), F.col("id").alias("dst")), "l")
    pairs = pairs.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst").distinct()
    unlinked = pairs.orderBy(lot, "src", "dst").limit(n)
    return linked.withColumn("y", F.lit(1.0)).unionByName(unlinked.select("src", "dst", F.lit(0.0).alias("y")))


def gradients(graph: Graph, pairs: Parts, n: int, model: Model) -> tuple[float, np.ndarray]:
    """The mean loss of n pairs, and the gradient of all parameters."""
    one, two = model.layers
    (heads, size, _), (heads2, outputs, _) = one["W"].shape, two["W"].shape
    first, second = graph.inputs, graph.inputs + 2 * heads + heads * size
    states = forward(graph.states, graph.parts, model, 0, 0)
    states = forward(states, graph.parts, model, 1, first + 2 * heads)
    states = loss(states, pairs, model, n, outputs * heads2)
    states = backward(states, graph.parts, model, 1, first + 2 * heads, second)
    states = backward(states, graph.parts, model, 0, 0, first)
    rows = states.where("id < 0").select(F.posexplode("vec").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # one number a parameter
    flat = np.zeros(model.flat().size + 1)
    for r in rows:
        flat[r.k] = r.v
    return float(flat[-1]), flat[:-1]


def train(graph: Graph, pairs: DataFrame, *, model: Model | None = None, epochs: int = 200, rate: float = 0.005, seed: int = 42, per_part: int = LINKS) -> tuple[Model, list[float]]:
    """The model after so many steps of Adam on all pairs (src, dst, y), and the loss before each."""
    model = model or new_model(graph.inputs, seed=seed)
    dealt = Parts.of(_numbered_pairs(pairs, graph.names, "y"), per_part)
    n = dealt.links.count()
    mean, square, losses = 0.0, 0.0, []
    for t in range(1, epochs + 1):
        value, g = gradients(graph, dealt, n, model)
        losses.append(value)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        model = model.moved(model.flat() - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8))
    return model, losses


def embed(graph: Graph, model: Model) -> DataFrame:
    """id, x: the vectors of all nodes."""
    one, two = model.layers
    heads, size, _ = one["W"].shape
    states = forward(forward(graph.states, graph.parts, model, 0, 0), graph.parts, model, 1, graph.inputs + 2 * heads)
    width = two["W"].shape[0] * two["W"].shape[1]
    last = F.slice("vec", F.size("vec") - width + 1, width)
    rows = states.select(F.col("id").alias("k"), F.transform(last, lambda v: F.when(v > 0, v).otherwise(F.expm1(v))).alias("x"))
    return rows.join(graph.names, "k").select("id", "x")


def pair_scores(vectors: DataFrame, pairs: DataFrame, model: Model) -> DataFrame:
    """src, dst and the probability p of a link."""
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in model.pair])
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    rows = pairs.join(vectors.select(F.col("id").alias("src"), F.col("x").alias("xa")), "src").join(vectors.select(F.col("id").alias("dst"), F.col("x").alias("xb")), "dst")
    return rows.withColumn("p", 1 / (1 + F.exp(-dot(F.col("xa"), F.transform(weights, lambda row: dot(row, F.col("xb"))))))).drop("xa", "xb")
