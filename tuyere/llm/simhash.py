"""SimHash near-dedup with a generalised pigeonhole search.

Fingerprints of 64 bits link at ``distance`` or fewer differing bits. The bits are grouped into m partitions; with
thresholds t_1..t_m whose sum is distance - m + 1, any two linked fingerprints differ in at most t_i bits of some partition
i (a threshold of -1 leaves a partition out). Correlated bits go into the same partition, so that the others stay even. The
thresholds, unequal as a rule, are allocated by dynamic programming on the estimated cost of each (partition, threshold):
rows sent plus candidates compared. The estimates come from all distinct fingerprints: the exact number of pairs that agree
on a partition, carried to larger thresholds by the bits' shares of ones. The partitioning (2 to 4 parts) of least cost is used.

Equal fingerprints are one fingerprint from the start, so copies cost nothing. In a bucket (partition, value) all pairs
are compared in numpy, but only a spanning forest of the links found leaves the task; larger buckets are cut into blocks,
and each pair of blocks is a task's own piece of work, so no bucket is bounded and no link is lost. Components are then
found by alternating large-star and small-star steps, each written to the shared folder.

Cases: null texts count as empty; texts without words have fingerprint zero and are linked like any other; repeated ids are
rows of their own; null ids count last when the smallest is taken; an empty table gives an empty result; further columns
are ignored whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.llm.shared import LOWER, slices, written

#: Cost of a row that is sent and sorted, in compared pairs.
ROW_COST = 400.0
#: Fingerprints of a bucket that are compared as one block.
BLOCK = 4096


def _bits(values: np.ndarray) -> np.ndarray:
    """A column per bit, the lowest first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: str | None, words: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """Bit k is one if it is one in more than half of the XXH64 hashes of the word shingles (A-Z lower-cased)."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    body = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxh64_intdigest(body, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(parts) - words] + 1])
        hashes = [xxh64_intdigest(body[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, len(values), block):
        ones += _bits(values[at : at + block]).sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(values)).tolist())


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash. No shuffle."""
    text = F.col(f"`{text_col}`")
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make(batches):
        import pyarrow as pa

        for batch in slices(batches):
            values = np.array([fingerprint(x, words) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    return source.mapInArrow(make, f"doc_id {kind}, fp long, text_hash long")


def _co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and of those with ones at both of two bits; of all rows, 64 x 64 counts a task."""

    def count(batches):
        import pyarrow as pa

        n, both = 0, np.zeros((64, 64))
        for batch in slices(batches, 1 << 16):
            ones = _bits(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            n, both = n + len(ones), both + ones.T @ ones
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "cell": pa.array([list(range(4096))], pa.list_(pa.int32())), "both": pa.array([both.ravel().tolist()], pa.list_(pa.float64()))})

    counts = fps.select("fp").mapInArrow(count, "n long, cell array<int>, both array<double>")
    total = counts.select("n", F.explode(F.arrays_zip("cell", "both")).alias("x")).groupBy("x.cell").agg(F.sum("x.both").alias("both"), F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for x in total:
        both[x.cell] = x.both
    return (total[0].n if total else 0), both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width: each begins with the free bit that is most correlated with others and takes the
    bits most correlated with those it has."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for k in range(parts):
        width = (64 * (k + 1)) // parts - (64 * k) // parts
        if k == parts - 1:
            out.append(sorted(free))
            break
        chosen = [max(free, key=lambda b: (corr[b][free].sum(), -b))]
        free.remove(chosen[0])
        while len(chosen) < width:
            best = max(free, key=lambda b: (corr[b][chosen].sum(), -b))
            chosen.append(best)
            free.remove(best)
        out.append(sorted(chosen))
    return out


def _masks(groups: list[list[int]]) -> list[int]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(1 << b for b in g)) for g in groups]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the given sum with the least cost, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, chosen) in best.items():
            for t, more in options.items():
                if had + t not in step or cost + more < step[had + t][0]:
                    step[had + t] = (cost + more, [*chosen, t])
        best = step
    return best[total]


def plan_search(fps: DataFrame, distance: int = 3, parts: tuple[int, ...] = (2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """(partitions, thresholds) of least estimated cost for these distinct fingerprints."""
    n, both = _co_occurrence(fps)
    if not n:
        return group_bits(0, both, 2), [distance - 1, 0]
    share = np.diag(both) / n
    differ = 2 * share * (1 - share)
    layouts = {m: group_bits(n, both, m) for m in parts if m <= distance + 1}
    flat = [(m, i, mask) for m, groups in layouts.items() for i, mask in enumerate(_masks(groups))]
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for m, i, mask in flat])).alias("x")
    agree = fps.select(value).groupBy("x.m", "x.i", "x.v").count().groupBy("m", "i").agg((F.sum(F.col("count") * (F.col("count") - 1.0)) / 2).alias("pairs")).collect()
    pairs = {(x.m, x.i): x.pairs for x in agree}
    found = []
    for m, groups in layouts.items():
        costs = []
        for i, group in enumerate(groups):
            near = np.zeros(distance + 2)  # near[t]: share of pairs that differ in t bits of the partition, bits taken as independent
            near[0] = 1
            for b in group:
                near[1:] = near[1:] * (1 - differ[b]) + near[:-1] * differ[b]
                near[0] *= 1 - differ[b]
            options = {-1: 0.0}
            for t in range(distance - m + 1 + (m - 1) + 1):
                within = max(pairs[m, i], n * (n - 1) / 2 * near[0]) * near[: t + 1].sum() / max(near[0], 1e-300)
                variants = sum(comb(len(group), k) for k in range(1, t + 1))
                options[t] = ROW_COST * n * (1 + variants) + within
            costs.append(options)
        cost, chosen = allocate(costs, distance - m + 1)
        found.append((cost, groups, chosen))
    _, groups, thresholds = min(found, key=lambda x: x[0])
    return groups, thresholds


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links a-b: (member, smallest member)."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(names))
    x, y = ends[: len(a)], ends[len(a) :]
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    member = np.flatnonzero(low != np.arange(len(names)))
    return names[member], names[low[member]]


def _links_between(own: np.ndarray, other: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two sets of one bucket, as few of them as hold the sets' components together; a row at a time
    against all others, so memory follows the sets' sizes and not their product."""
    if not len(own) or not len(other):
        return own[:0], own[:0]
    step = max(1, (1 << 22) // len(other))
    kept_a, kept_b = [], []
    for at in range(0, len(own), step):
        part = own[at : at + step]
        close = np.bitwise_count(part[:, None] ^ other[None, :]) <= distance
        x, y = np.nonzero(close)
        a, b = part[x], other[y]
        differ = a != b
        if differ.any():
            m, s = _forest(a[differ], b[differ])
            kept_a.append(m)
            kept_b.append(s)
    if not kept_a:
        return own[:0], own[:0]
    return _forest(np.concatenate(kept_a), np.concatenate(kept_b))


def _bucket_rows(fps: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """part, value, fp, probe: an own row for each used partition, and a probe row for each value within its threshold."""

    def make(batches):
        import pyarrow as pa

        for batch in slices(batches, 2000):
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for i, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
                if t < 0:
                    continue
                value = fp & np.int64(_masks([group])[0])
                flips = [0] + [sum(1 << b for b in bits) for k in range(1, t + 1) for bits in combinations(group, k)]
                for flip in flips:
                    changed = value ^ np.array([flip], np.uint64).view(np.int64)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(changed), pa.array(fp), pa.array(np.full(len(fp), flip != 0))], ["part", "value", "fp", "probe"])

    return fps.select("fp").mapInArrow(make, "part int, value long, fp long, probe boolean")


def links(fps: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """a, b: links that hold the components of all distinct fingerprints together. Every pair at the distance or less is
    found by a bucket; of a bucket's links, a spanning forest comes out."""
    groups, thresholds = plan_search(fps, distance)
    rows = _bucket_rows(fps, groups, thresholds)
    large = rows.groupBy("part", "value").agg(F.count("*").alias("n"), F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("own")).where((F.col("n") > block) & (F.col("own") > 0))
    large = written(large.select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-large")
    if large.isEmpty():
        rows = rows.select("part", "value", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "probe", F.lit(0).alias("at"))
    else:  # a row of block k goes to each pair of blocks that has k
        k = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("at"), j).alias("x"), F.greatest(F.col("at"), j).alias("y")))
        rows = rows.join(large, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("at", k)
        rows = rows.select("part", "value", "fp", "probe", "at", F.explode(pairs).alias("pair")).select("part", "value", "pair.x", "pair.y", "fp", "probe", "at")
    rows = rows.repartition("part", "value", "x", "y").sortWithinPartitions("part", "value", "x", "y")

    def search(batches):
        import pyarrow as pa

        out_a, out_b = [], []
        names = ["part", "value", "x", "y", "fp", "probe", "at"]
        held: list[np.ndarray] | None = None

        def compare(columns: list[np.ndarray]) -> None:
            part, value, x, y, fp, probe, at = columns
            cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(part)]])
            size = end - start
            for a, b in zip(start[size > 2].tolist(), end[size > 2].tolist(), strict=True):
                f, p, k = fp[a:b].view(np.uint64), probe[a:b], at[a:b]
                if p.all():
                    continue
                if x[a] == y[a]:
                    sets = [(f[~p], f)]
                else:
                    sets = [(f[~p & (k == x[a])], f[k == y[a]]), (f[~p & (k == y[a])], f[k == x[a]])]
                for own, other in sets:
                    u, v = _links_between(own, other, distance)
                    out_a.append(u.view(np.int64))
                    out_b.append(v.view(np.int64))
            two = start[size == 2]
            u, v = fp[two], fp[two + 1] if len(two) else fp[two]
            close = (np.bitwise_count((u ^ v).view(np.uint64)) <= distance) & (u != v) & ~(probe[two] & (probe[two + 1] if len(two) else probe[two]))
            out_a.append(u[close])
            out_b.append(v[close])

        def flush():
            if out_a and sum(map(len, out_a)):
                got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
                out_a.clear(), out_b.clear()
                return [got]
            return []

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                columns = [np.concatenate(z) for z in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            same = np.ones(len(columns[0]), bool)
            for c in columns[:4]:
                same &= c == c[-1]
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [c[last:] for c in columns]
            if last:
                compare([c[:last] for c in columns])
                yield from flush()
        if held is not None and len(held[0]):
            compare(held)
            yield from flush()

    return rows.mapInArrow(search, "a long, b long")


#: A node with more than one in so many of all links, and more links than a task may well hold, has its least neighbour
#: broadcast; there are fewer such nodes than that.
HOT, MANY = 1000, 100_000


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links (a, b) with m of their a, from the written least (a, m, n: how many links a has). The links of a node with many of
    them stay where they are, so that they do not meet in one task."""
    many = (F.col("n") * HOT > total) & (F.col("n") > MANY)
    hot = least.where(many).select("a", "m")
    if total <= MANY or hot.isEmpty():
        return links.join(least.select("a", "m"), "a").select("a", "b", "m")
    rest = links.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.where(~many).select("a", "m"), "a")
    return links.join(F.broadcast(hot), "a").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def _least(links: DataFrame) -> DataFrame:
    return written(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "links-least")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of the links a-b, by alternating large-star and small-star. Every
    table that a step uses twice is written, so that plans stay small: the driver keeps what it knows of each one's tasks."""
    pairs = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = digest(pairs)
    if not before.n:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        total = 2 * before.n
        both = pairs.union(pairs.select("b", "a"))
        least = _least(both).select("a", F.least("a", "m").alias("m"), "n")
        large = written(_with_least(both.where("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b")), "links-large")
        least = _least(large)
        small = _with_least(large, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        pairs = written(small.distinct(), "links")
        now = digest(pairs)
        if now == before:
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def near_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), fingerprint (16 hex digits), component_id (smallest id reachable),
    root (the component's smallest fingerprint, its name where ids repeat) and text_hash (tells rows of equal ids apart)."""
    docs = written(fingerprints(df, id_col=id_col, text_col=text_col, words=words), "simhash")
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = written(components(links(fps, distance)), "simhash-roots")
    own = fps.join(roots.union(roots.select(F.col("root"), F.col("root")).distinct()), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(smallest, "root").select("fp", "component_id", "root")
    return docs.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root", "text_hash")


def drop_near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words: int = 5) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id. Where rows of that id with different texts
    are in the component, the text of the smallest hash stays; rows of equal ids in different components all stay."""
    return keep_first(df, near_groups(df, id_col=id_col, text_col=text_col, distance=distance, words=words), id_col, text_col)


def keep_first(df: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows that stay, of groups with doc_id, component_id, root and text_hash."""
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("root", "doc_id").agg(F.min("text_hash").alias("text_hash")).drop("root")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # so that no column's name clashes
    rows = df.select(whole.alias("row"), F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"))
    rows = rows.join(kept, (F.col("h") == F.col("text_hash")) & F.col("i").eqNullSafe(F.col("doc_id")), "left_semi")
    return rows.dropDuplicates(["i", "h"]).select("row.*")
