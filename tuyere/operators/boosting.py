"""Boosted regression trees over binned columns, with the whole grid of choices and folds fitted at a time (E-11).

The rows to fit on are all rows, or a seeded sample of ``most`` of them where there are more: the bound of what goes to the
driver and to each task. Columns are cut once into at most ``BINS`` bins between quantiles; every fit then counts in bins, and
rows with the same bins are one cell with their number, sum and squares, as no tree can tell them apart.
Choices that differ in the number of trees are one fit of the largest, whose first trees are the smaller ones. Each pair of
depth, rate and fold is a task of its own, and gives back the squared error of the fold it has not seen after each number of
trees; the best choice is fitted to all rows of the sample. All rows are explained, wherever the trees come from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.operators.models import bounded_sample

BINS, LEAST_ROWS = 255, 20
#: The depths, rates and numbers of trees that are tried.
GRID = ((5, 10, 15), (0.05, 0.1, 0.2), (100, 200, 500))


@dataclass
class Tree:
    """Nodes by number: feature (-1 at a leaf), the last bin that goes left, left child (the right one follows it), value, rows."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    def at(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return node
            here = node[inner]
            node[inner] = self.left[here] + (bins[inner, self.feature[here]] > self.cut[here])


@dataclass
class Cells:
    """Rows of equal bins: their bins, how many they are, the sums of their targets and of the targets' squares."""

    bins: np.ndarray
    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, bins: np.ndarray, y: np.ndarray) -> Cells:
        found, place = np.unique(bins, axis=0, return_inverse=True) if len(bins) else (bins, np.empty(0, np.int64))
        place = place.reshape(-1)
        count = lambda w=None: np.bincount(place, w, len(found))
        return cls(found, count(), count(y), count(y * y))

    def less(self, mean: float) -> Cells:
        """The same cells with the mean taken from every target."""
        return Cells(self.bins, self.n, self.total - mean * self.n, self.squares - 2 * mean * self.total + mean * mean * self.n)


def grow(bins: np.ndarray, residual: np.ndarray, depth: int, n_bins: int, least: int = LEAST_ROWS, times: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
    """A tree of least squares by levels, and the leaf of each row. Of equal splits the first feature and bin count. With
    ``times``, a row stands for so many, and residual is their sum."""
    times = np.ones(len(bins), np.int64) if times is None else times
    n, d = int(times.sum()), bins.shape[1]
    widths = [min(n_bins, int(bins[:, f].max()) + 1) if len(bins) else 1 for f in range(d)]
    feature, cut, left = [-1], [-1], [-1]
    value, rows = [residual.sum() / n if n else 0.0], [n]
    node = np.zeros(len(bins), np.int64)
    live = np.array([0])
    for _ in range(depth):
        slot = np.full(len(feature), -1)
        slot[live] = np.arange(len(live))
        own = slot[node]
        mine = np.flatnonzero(own >= 0)
        best = np.full(len(live), 1e-12)
        split = np.full((len(live), 2), -1)
        for f, width in enumerate(widths):
            place = own[mine] * width + bins[mine, f]
            sums = np.bincount(place, residual[mine], len(live) * width).reshape(-1, width).cumsum(1)
            counts = np.bincount(place, times[mine], len(live) * width).reshape(-1, width).cumsum(1)
            total, all_rows = sums[:, -1:], counts[:, -1:]
            rest = all_rows - counts
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sums**2 / counts + (total - sums) ** 2 / rest - total**2 / all_rows
            gain[(counts < least) | (rest < least)] = -1
            k = gain.argmax(1)
            top = gain[np.arange(len(live)), k]
            better = top > best * (1 + 1e-12)
            best[better] = top[better]
            split[better] = np.column_stack([np.full(better.sum(), f), k[better]])
        going = np.flatnonzero(split[:, 0] >= 0)
        if not len(going):
            break
        children = len(feature) + 2 * np.arange(len(going))
        for g, child in zip(going, children, strict=True):
            feature[live[g]], cut[live[g]], left[live[g]] = int(split[g, 0]), int(split[g, 1]), int(child)
            feature += [-1, -1]
            cut += [-1, -1]
            left += [-1, -1]
        first = np.full(len(live), -1)
        first[going] = children
        to = first[own[mine]]
        moved = mine[to >= 0]
        s = split[own[moved]]
        node[moved] = to[to >= 0] + (bins[moved, s[:, 0]] > s[:, 1])
        live = np.concatenate([children, children + 1])
        value += [0.0] * (2 * len(going))
        rows += [0] * (2 * len(going))
        sums, counts = np.bincount(node, residual, len(feature)), np.bincount(node, times, len(feature))
        for x in live.tolist():
            value[x], rows[x] = sums[x] / max(counts[x], 1), int(counts[x])
    return Tree(*(np.array(x) for x in (feature, cut, left, value, rows))), node


def boost(bins: np.ndarray, y: np.ndarray, depth: int, rate: float, n_trees: int, n_bins: int, unseen: tuple[np.ndarray, np.ndarray] | None = None, sizes: tuple[int, ...] = ()) -> tuple[float, list[Tree], list[float]]:
    """The mean, the trees (their values times the rate), and the summed squared error of the unseen rows at each size."""
    mean = float(y.mean()) if len(y) else 0.0
    seen, trees, errors = Cells.of(bins, y).less(mean), [], []
    residual = seen.total
    out = Cells.of(*unseen).less(mean) if unseen else None
    guess = np.zeros(len(out.n)) if unseen else None
    for k in range(1, n_trees + 1):
        tree, node = grow(seen.bins, residual, depth, n_bins, times=seen.n)
        tree.value = tree.value * rate
        residual = residual - tree.value[node] * seen.n
        if unseen:
            guess = guess + tree.value[tree.at(out.bins)]
            if k in sizes:
                errors.append(float((out.squares - 2 * guess * out.total + guess * guess * out.n).sum()))
        else:
            trees.append(tree)
    return mean, trees, errors


@dataclass
class Boosted:
    """What ``attribution`` explains: leaves as paths of intervals, in the columns' own values."""

    mean: float
    trees: list[Tree]
    edges: list[np.ndarray]
    choice: tuple[int, float, int]
    errors: dict[tuple[int, float, int], float]

    def leaves(self) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
        out = [(self.mean, [])]
        for t in self.trees:
            todo = [(0, {})]
            while todo:
                k, path = todo.pop()
                f = int(t.feature[k])
                if f < 0:
                    out.append((float(t.value[k]), [(c, *x) for c, x in sorted(path.items())]))
                    continue
                at = float(self.edges[f][t.cut[k]])
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                for child, ends in ((t.left[k], (low, min(high, at))), (t.left[k] + 1, (max(low, at), high))):
                    todo.append((int(child), path | {f: (*ends, share * t.rows[child] / t.rows[k])}))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        return self.mean + sum((t.value[t.at(bins)] for t in self.trees), np.zeros(len(x)))


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Per column the upper ends of its bins but the last: halfway between values, or between quantiles where there are more."""
    out = []
    for c in x.T:
        values = np.unique(c)
        if len(values) > BINS:
            values = np.unique(np.quantile(c, np.linspace(0, 1, BINS), method="lower"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).astype(np.int32) if len(edges) else np.empty((len(x), 0), np.int32)


def fit(train: DataFrame, features: list[str], target: str, *, id_col: str = "id", grid=GRID, folds: int = 3, most: int = 100_000, seed: int = 42) -> Boosted:
    """The boosted trees whose choice has the least squared error in cross-validation; of equal errors the least depth, rate and
    number of trees. Rows with a null or NaN in a used column take no part."""
    rows = bounded_sample(train, id_col, [*features, target], most, seed)
    x, y = rows[:, :-1], rows[:, -1]
    edges = bin_edges(x) if len(x) else []
    bins, n_bins = binned(x, edges), BINS + 1
    fold = np.random.default_rng(seed).permutation(np.arange(len(x)) % folds)
    depths, rates, sizes = (tuple(sorted(set(g))) for g in grid)
    jobs = [(d, r, k) for d in depths[::-1] for r in rates for k in range(folds)]  # the longest first
    errors: dict[tuple[int, float, int], float] = {}
    if len(depths) * len(rates) * len(sizes) > 1 and len(x) >= folds:

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for j in batch.column(0).to_pylist():
                    depth, rate, k = jobs[j]
                    seen, out = fold != k, fold == k
                    found = boost(bins[seen], y[seen], depth, rate, sizes[-1], n_bins, (bins[out], y[out]), sizes)[2]
                    yield pa.RecordBatch.from_arrays([pa.array([depth] * len(sizes)), pa.array([rate] * len(sizes)), pa.array(list(sizes)), pa.array(found)], names=["depth", "rate", "n", "error"])

        tasks = train.sparkSession.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "depth long, rate double, n long, error double")
        for r in tasks.groupBy("depth", "rate", "n").agg((F.sum("error") / len(x)).alias("error")).collect():  # a row a choice
            errors[r.depth, r.rate, r.n] = r.error
    choice = min(errors, key=lambda c: (errors[c], c)) if errors else (depths[0], rates[0], sizes[0])
    mean, trees, _ = boost(bins, y, *choice, n_bins) if len(x) else (0.0, [], [])
    return Boosted(mean, trees, edges, choice, errors)
