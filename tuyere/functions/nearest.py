"""Exact nearest neighbours without comparing all pairs.

Points live in spaces (a space is a key: only points of one space are compared) and lie around pivots, a seeded sample of them
that grows with the space. Each point belongs to the cell of its nearest pivot; a cell is known by how many points it has and
by its nearest and farthest distance to the pivot. Distances are Euclidean.

1. Every query has a bound on the distance of its k-th neighbour: the cells, taken in the order in which they end as seen from
   the query, that together hold k points.
2. It visits the cell it lies in, and gets a closer bound from what it finds there.
3. It visits all other cells that the triangle inequality, or the plane halfway between two pivots, does not rule out.

Cells that lie together form groups, ``GROUPS`` of them unless one came to more than ``BLOCK`` points or ``VALUES`` numbers. A query
goes to each group in which it visits a cell, once, with a bit for each of the group's cells; so rows are copied by groups and
compared by cells. What meets in a group is cut into blocks, so a task compares at most BLOCK with BLOCK, and about ``TASKS`` tasks
share the work of few groups. Pivots are at most ``PIVOTS`` in all, whatever the number of points; they and the cells' figures go
to the driver and to all tasks. In many dimensions hardly a cell can be ruled out: the work is that of all pairs then, and each
query is copied to GROUPS groups and each point to TASKS / GROUPS blocks of queries, or to as many as blocks of BLOCK need.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.storage import stored

CELL, PIVOTS, BLOCK = 500, 4000, 100_000
#: Most numbers of a block's points; groups of a space, tasks of all spaces, and the rows that are not cut further for their sake.
VALUES, GROUPS, TASKS, FEW = 6_400_000, 8, 128, 2000
#: Fewer pairs get no task of their own.
PAIRS = 20_000_000
#: Rows and columns that are compared at a time.
ROWS, COLUMNS = 500, 1000
#: Bounds are widened by this share against rounding.
SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of a's rows to b's, from the differences themselves, some rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None, :] - b[None]) ** 2).sum(2))
    return out


def _factor(y: np.ndarray) -> np.ndarray:
    """y, its squares and 1: times (-2 x, 1, the squares of x) it is the square of the distance."""
    return np.column_stack([y, (y * y).sum(1), np.ones(len(y))])


def _closest(x: np.ndarray, y: np.ndarray, rank: np.ndarray, bound: np.ndarray, k: int, ends: np.ndarray | None = None, go: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance): the k nearest within each row's bound, by distance and then rank. Squares from a matrix
    product, widened by more than their rounding, leave few pairs, whose distances come from the differences themselves.
    y may be cells that end at ``ends``, of which ``go`` (rows of x by cells) tells those to compare with; right is _factor(y)."""
    xx = (x * x).sum(1)
    left, right = np.column_stack([-2 * x, np.ones(len(x)), xx]), _factor(y) if right is None else right
    off = 1e-14 * max(1, x.shape[1]) * (xx + right[:, -2].max(initial=0.0))
    limit = bound**2 * (1 + SLACK) + off
    ends = np.array([len(y)]) if ends is None else ends
    rows, columns, squares, kept, most = [], [], [], 0, 4 * k * len(x)

    def closer():
        """Only what can be among a row's k nearest of those found so far; a row with k has their limit."""
        j, c, r = np.concatenate(rows), np.concatenate(columns), np.concatenate(squares)
        order = np.lexsort((r, j))
        j, c, r = j[order], c[order], r[order]
        last = np.arange(len(j)) - np.searchsorted(j, j) == k - 1
        limit[j[last]] = np.minimum(limit[j[last]], r[last] + 2 * off[j[last]])
        good = ~(r > limit[j])
        rows[:], columns[:], squares[:] = [j[good]], [c[good]], [r[good]]
        return good.sum()

    for cell in range(len(ends)) if go is None else np.flatnonzero(go.any(0)):
        at = np.arange(len(x)) if go is None else np.flatnonzero(go[:, cell])
        some = left if len(at) == len(x) else left[at]
        for a in range(ends[cell - 1] if cell else 0, ends[cell], COLUMNS):
            rough = some @ right[a : min(a + COLUMNS, ends[cell])].T
            near = ~(rough > limit[at, None])  # what is no number stays
            if rough.shape[1] > k and np.count_nonzero(near) > 4 * k * len(at):
                limit[at] = np.minimum(limit[at], np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * off[at])
                near = ~(rough > limit[at, None])
            j, c = np.nonzero(near)
            rows.append(at[j])
            columns.append(a + c)
            squares.append(rough[j, c])
            kept += len(j)
            if kept > most:
                kept = closer()
                most = max(2 * kept, 4 * k * len(x))
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    closer()
    j, c = rows[0], columns[0]
    d = np.concatenate([np.empty(0), *(np.sqrt(((x[j[a : a + 50_000]] - y[c[a : a + 50_000]]) ** 2).sum(1)) for a in range(0, len(j), 50_000))])
    order = np.lexsort((rank[c], d, j))
    j, c, d = j[order], c[order], d[order]
    good = (np.arange(len(j)) - np.searchsorted(j, j) < k) & (d <= bound[j])
    return j[good], c[good], d[good]


def _matrix(column) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), float).reshape(len(column), -1)


def _slices(batches, rows: int = 1000):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _most(pivots: np.ndarray) -> int:
    """Most points of a block."""
    return max(1, min(BLOCK, VALUES // max(1, pivots.shape[1])))


def _groups(pivots: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The cells that have points, in groups of cells that lie together: halves of about equal points along the widest dimension."""
    most = min(_most(pivots), max(FEW, n.sum() / GROUPS))
    out, open_ = [], [np.flatnonzero(n > 0)]
    while open_:
        cells = open_.pop()
        parts = max(-(-n[cells].sum() // _most(pivots)), round(n[cells].sum() / most))
        if parts < 2 or len(cells) < 2:
            out.append(np.sort(cells))
            continue
        wide = np.ptp(pivots[cells], axis=0).argmax()
        cells = cells[np.argsort(pivots[cells, wide], kind="stable")]
        upto = n[cells].cumsum()
        cut = min(max(1, int(np.abs(upto - upto[-1] * (parts // 2) / parts).argmin()) + 1), len(cells) - 1)
        open_ += [cells[:cut], cells[cut:]]
    return [g for g in out if len(g)]


class _Cells:
    """The pivots and the cells' figures of all spaces, by space, and their groups."""

    def __init__(self, pivots: dict[str, np.ndarray], figures: dict[tuple[str, int], tuple[int, float, float]] | None = None):
        self.pivots = pivots
        if figures is not None:
            take = lambda s, k, other: np.array([figures.get((s, c), (0, other, other))[k] for c in range(len(pivots[s]))], float)
            self.n, self.least, self.most = ({s: take(s, k, np.inf if k == 1 else 0.0) for s in pivots} for k in range(3))
            self.apart = {s: _distances(p, p) for s, p in pivots.items()}
            self.groups = {s: _groups(p, self.n[s]) for s, p in pivots.items()}


def _pick_pivots(points: DataFrame) -> dict[str, np.ndarray]:
    counts = {r.space: r.n for r in points.groupBy("space").agg(F.count("*").alias("n")).collect()}  # one row a space
    share = min(1.0, PIVOTS / max(1, sum(-(-n // CELL) for n in counts.values())))
    wanted = {s: max(1, int(-(-n // CELL) * share)) for s, n in counts.items()}
    if not wanted:
        return {}
    rates = points.sparkSession.createDataFrame([(s, (2 * w + 20) / counts[s]) for s, w in wanted.items()], "space string, rate double")
    lot = F.pmod(F.xxhash64("space", "i"), F.lit(1 << 40))
    few = points.join(F.broadcast(rates), "space").where(lot < F.col("rate") * float(1 << 40)).withColumn("lot", lot)
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("space").orderBy("lot", "i")))  # of about 2 w + 20 rows a space
    found: dict[str, list] = {}
    for r in first.select("space", "r", "x").orderBy("space", "r").collect():
        if r.r <= wanted[r.space]:
            found.setdefault(r.space, []).append(r.x)
    missing = set(wanted) - set(found)  # a space whose lots are all high
    for r in points.where(F.col("space").isin(*missing)).groupBy("space").agg(F.min_by("x", "i").alias("x")).collect() if missing else []:
        found[r.space] = [r.x]
    return {s: np.unique(np.array(x, float), axis=0) for s, x in found.items()}


def _assigned(points: DataFrame, cells: _Cells) -> DataFrame:
    """space, i, x, cell, r: the nearest pivot and the distance to it."""
    kind = points.schema["i"].dataType.simpleString()

    def assign(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            spaces, x = batch.column(0).to_pylist(), batch.column(2)
            cell, r = np.zeros(len(spaces), np.int32), np.zeros(len(spaces))
            for s in set(spaces):
                at = np.array([k for k, v in enumerate(spaces) if v == s])
                d = _distances(_matrix(x.take(pa.array(at))), cells.pivots[s])
                cell[at], r[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], names=["space", "i", "x", "cell", "r"])

    return points.select("space", "i", "x").mapInArrow(assign, f"space string, i {kind}, x {points.schema['x'].dataType.simpleString()}, cell int, r double")


def _visits(queries: DataFrame, cells: _Cells, k: int, first: bool) -> DataFrame:
    """space, q, x, bound, home, visits (group, cells): for each query (space, q, x, bound) the groups with cells that it has to
    visit, and a bit for each cell of such a group; first: only the one it lies in (home), else all but that one. A null bound
    is one that is not known yet."""
    kind, values = (queries.schema[c].dataType.simpleString() for c in ("q", "x"))

    def choose(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            spaces, bounds = batch.column(0).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            for s in sorted(set(spaces) & cells.pivots.keys()):  # no points elsewhere
                own = np.array([j for j, v in enumerate(spaces) if v == s])
                d = _distances(_matrix(batch.column(2).take(pa.array(own))), cells.pivots[s])
                n, least, most = cells.n[s], cells.least[s], cells.most[s]
                end = np.where(n > 0, d + most, np.inf)
                order = np.argsort(end, 1)
                enough = np.take(n, order).cumsum(1) >= k
                bound = np.where(enough.any(1), end[np.arange(len(own)), order[np.arange(len(own)), enough.argmax(1)]], np.inf)
                bound = np.fmin(bound, bounds[own].astype(float)) * (1 + SLACK)
                home = np.where(n > 0, d, np.inf).argmin(1)
                if first:
                    go = np.zeros(d.shape, bool)
                    go[np.arange(len(own)), home] = True
                else:
                    near = np.maximum(np.maximum(d - most, least - d), 0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (d**2 - d.min(1)[:, None] ** 2) / (2 * cells.apart[s][d.argmin(1)])
                    plane = np.where(np.isfinite(plane), plane, 0)
                    go = (near * (1 - SLACK) <= bound[:, None]) & (plane * (1 - SLACK) <= bound[:, None]) & (n > 0)
                    go[np.arange(len(own)), home] = False
                rows, groups, bits = [], [], []
                for g, members in enumerate(cells.groups[s]):
                    some = np.flatnonzero(go[:, members].any(1))
                    rows.append(some)
                    groups.append(np.full(len(some), g, np.int32))
                    bits += [v.tobytes() for v in np.packbits(go[some][:, members], axis=1)]
                at = np.concatenate(rows)
                by = np.argsort(at, kind="stable")
                visits = pa.StructArray.from_arrays([pa.array(np.concatenate(groups)), pa.array(bits, pa.binary())], names=["group", "cells"]).take(pa.array(by))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[by], np.arange(len(own) + 1)).astype(np.int32)), visits)
                picked = [c.take(pa.array(own)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*picked, pa.array(bound), pa.array(home.astype(np.int32)), lists], names=["space", "q", "x", "bound", "home", "visits"])

    return queries.select("space", "q", "x", "bound").mapInArrow(choose, f"space string, q {kind}, x {values}, bound double, home int, visits array<struct<group:int,cells:binary>>")


def _found(visits: DataFrame, points: DataFrame, cells: _Cells, k: int, tasks_wanted: int) -> DataFrame:
    """space, q, i, d: of each block of a visited group, the k nearest points of the visited cells within the bound."""
    q_kind, i_kind = visits.schema["q"].dataType.simpleString(), points.schema["i"].dataType.simpleString()
    crowd = {(r.space, r.group): r.n for r in visits.select("space", F.explode("visits.group").alias("group")).groupBy("space", "group").agg(F.count("*").alias("n")).collect()}  # no more rows than pivots
    share = -(-tasks_wanted // max(1, len(crowd)))
    blocks, tasks, pairs = [], 0, 0.0
    for (s, g), n in crowd.items():
        most = _most(cells.pivots[s])
        members = cells.groups[s][g]
        q_blocks = max(-(-n // most), min(share, -(-n // FEW)))
        i_blocks = int(-(-cells.n[s][members[0]] // most)) if len(members) == 1 else 1
        blocks += [(s, g, int(c), q_blocks, i_blocks) for c in members]
        tasks += q_blocks * i_blocks
        pairs += n * cells.n[s][members].sum()
    parts = max(1, min(2 * tasks, max(2 * TASKS, tasks // 8), int(pairs // PAIRS)))  # by number, as few rows make much work
    blocks = visits.sparkSession.createDataFrame(blocks, "space string, group int, cell int, q_blocks int, i_blocks int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    lot = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    asked = visits.select("space", "q", "x", "bound", "home", F.explode("visits").alias("v")).select("space", "q", "x", "bound", "home", "v.group", F.col("v.cells").alias("go"))
    asked = asked.join(F.broadcast(blocks.select("space", "group", "q_blocks", "i_blocks").distinct()), ["space", "group"]).withColumn("qb", lot("q", "q_blocks")).withColumn("ib", every("i_blocks"))
    held = points.join(F.broadcast(blocks), ["space", "cell"]).withColumn("ib", lot("i", "i_blocks")).withColumn("qb", every("q_blocks"))
    keys = ["space", "group", "qb", "ib"]

    def compare(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(left) or not len(right):  # a block into which no row was dealt
            return pa.table({"space": left.column("space").slice(0, 0), "q": left.column("q").slice(0, 0), "i": right.column("i").slice(0, 0), "d": pa.array([], pa.float64())})
        left, right = left.sort_by("home"), right.sort_by("cell")
        i = right.column("i").combine_chunks()
        rank = np.argsort(pc.sort_indices(i).to_numpy())
        y, x, bound = _matrix(right.column("x")), _matrix(left.column("x")), left.column("bound").to_numpy()
        # the bits are those of the group's cells in order; all of them are here, as only a group of one cell is cut
        ends = np.append(np.flatnonzero(np.diff(right.column("cell").to_numpy())) + 1, len(y))
        bits = np.frombuffer(b"".join(left.column("go").to_pylist()), np.uint8).reshape(len(x), -1)
        factor, rows, near, far = _factor(y), [], [], []
        for a in range(0, len(x), ROWS):
            go = np.unpackbits(bits[a : a + ROWS], axis=1, count=len(ends)).astype(bool)
            j, c, d = _closest(x[a : a + ROWS], y, rank, bound[a : a + ROWS], k, ends, go, factor)
            rows.append(a + j)
            near.append(c)
            far.append(d)
        at, to = np.concatenate(rows), np.concatenate(near)
        return pa.table({"space": left.column("space").take(pa.array(at)), "q": left.column("q").take(pa.array(at)), "i": i.take(pa.array(to)), "d": pa.array(np.concatenate(far))})

    asked, held = (df.select(*keys, *c).repartition(parts, *keys).groupBy(*keys) for df, c in ((asked, ["q", "x", "bound", "home", "go"]), (held, ["i", "x", "cell"])))
    return asked.cogroup(held).applyInArrow(compare, f"space string, q {q_kind}, i {i_kind}, d double")


def nearest(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """space, q, i, d, r: each query's k nearest points of its space (all, if fewer), r from 1 by distance and then i.

    queries: space, q, x and points: space, i, x, with unique q and i within a space and vectors of one length without nulls.
    Vectors of floats are kept as such, in half the room, and compared as doubles."""
    floats = all(df.schema["x"].dataType.simpleString() == "array<float>" for df in (queries, points))
    vector = F.col("x").cast("array<float>" if floats else "array<double>").alias("x")
    points = stored(points.select("space", "i", vector), "nearest-points")
    cells = _Cells(_pick_pivots(points))
    dealt = stored(_assigned(points, cells), "nearest-cells")
    figures = dealt.groupBy("space", "cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect()  # no more rows than pivots
    cells = _Cells(cells.pivots, {(r.space, r.cell): (r.n, r.least, r.most) for r in figures})
    asked = queries.select("space", "q", vector, F.lit(None).cast("double").alias("bound"))
    order = Window.partitionBy("space", "q").orderBy("d", "i")
    home = stored(_found(stored(_visits(asked, cells, k, True), "nearest-home"), dealt, cells, k, 2 * GROUPS), "nearest-found")
    bounds = home.groupBy("space", "q").agg(F.count("*").alias("n"), F.max("d").alias("bound")).where(F.col("n") >= k).select("space", "q", "bound")
    closer = asked.drop("bound").join(bounds, ["space", "q"], "left")
    more = _found(stored(_visits(closer, cells, k, False), "nearest-visits"), dealt, cells, k, TASKS)
    return home.unionByName(more).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
