"""Near copies by shingle similarity: texts whose bags of five-word shingles have a Jaccard similarity of 0.8 or more.

A shingle that occurs k times in a text counts k times, also in its SimHash. The generalised pigeonhole search of ``simhash``
finds the texts whose SimHash differs in at most three bits, and their exact similarity links them. Most pairs of a similarity
below 0.97 differ in more bits, up to about 18 at 0.8, for which any pigeonhole compares nearly all pairs. So texts that are
not linked by then are compared if they share one of 24 bands of 5 MinHash values: a pair of similarity s has none in common
with probability (1 - s^5)^24, 7e-5 at 0.8. Every candidate of either kind is verified, so no link is wrong.

Equal bags are one node from the start. Buckets with the same members are one bucket, and those of one group of SimHash links
(a node and what is linked to it) are none. In a bucket, each node of a component is compared to those that are not yet linked,
whose own group comes with them, and only the links of a spanning forest leave the task; larger buckets are cut
into blocks, and each pair of blocks is a task's own piece of work. Only texts of shared buckets are read a second time.

Cases: null texts count as empty; texts without words have one bag; shorter texts are one shingle; texts of any length
are taken whole; of rows with equal ids and texts one stays; an empty table stays empty; all columns stay whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.llm import simhash
from tuyere.llm.shared import LOWER, slices, written
from tuyere.llm.simhash import components, keep_first

BANDS, ROWS = 24, 5
#: Bits in which the SimHash of candidates may differ.
DISTANCE = 3
#: Shingles of a bucket that are compared as one block.
BLOCK = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = _mixed(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def bag(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the word shingles (A-Z lower-cased); the repetitions of a shingle are numbered, so all differ."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().translate(LOWER).split()
    body = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(body, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(parts) - words] + 1])
    found = np.array([xxh64_intdigest(body[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    found.sort()
    first = np.concatenate([[True], found[1:] != found[:-1]])
    if first.all():
        return found
    place = np.arange(len(found))
    times = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return np.sort(np.where(first, found, _mixed(found + times * np.uint64(0x9E3779B97F4A7C15))))


def bands(found: np.ndarray, block: int = 4096) -> np.ndarray:
    """A key per band of MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), block):
        np.minimum(least, (found[at : at + block] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return keys.view(np.int64)


def print_of(found: np.ndarray, block: int = 1 << 16) -> int:
    """The SimHash of a bag: bit k is one if it is one in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), block):
        ones += simhash._bits(found[at : at + block]).sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(found)).tolist())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _name(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), 42)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], least: float, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose similarity is high enough; sets of one group are linked already."""
    size = np.array([len(x) for x in sets])
    out, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            own = sets[k := front.pop()]
            if group is not None:
                mates = group[rest] == group[k]
                front += rest[mates].tolist()
                rest = rest[~mates]
            near = rest[np.minimum(size[rest], size[k]) >= least * np.maximum(size[rest], size[k]) - 1e-9]
            if not len(near):
                continue
            flat = np.concatenate([sets[j] for j in near])
            same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
            more = near[both >= least * (size[near] + size[k] - both) - 1e-9]
            out += [(k, j) for j in more.tolist()]
            front += more.tolist()
            rest = np.setdiff1d(rest, more, assume_unique=True)
    return out


def _bags(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, text_hash, fp (names the bag), size (shingles), keys and print (SimHash) of each row. No shuffle."""
    text = F.col(f"`{text_col}`")
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))

    def make(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = [bag(x, words) for x in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(_signed([_name(x) for x in found])), pa.array([len(x) for x in found], pa.int64()), pa.array([bands(x) for x in found], pa.list_(pa.int64())), pa.array(_signed([print_of(x) for x in found]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "size", "keys", "print"])

    return source.mapInArrow(make, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long, size long, keys array<long>, print long")


def _sets(df: DataFrame, needed: DataFrame, text_col: str, words: int) -> DataFrame:
    """fp and bag of the needed nodes, from their texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = df.select(text.alias("text"), F.xxhash64(text).alias("text_hash")).join(needed, "text_hash").select("fp", "text")

    def make(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = [bag(x, words) for x in batch.column("text").to_pylist()]
            same = pa.array(_signed([_name(x) for x in found]) == batch.column("fp").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([x.tobytes() for x in found], pa.binary())], ["fp", "bag"]).filter(same)

    return source.mapInArrow(make, "fp long, bag binary").dropDuplicates(["fp"])


def close_prints(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: nodes whose SimHash is equal or differs in at most so many bits, as few as hold the components of these together."""
    prints = written(nodes.groupBy("print").agg(F.min("fp").alias("fp"), F.count("*").alias("n")), "near-prints")
    found = simhash.links(prints.select(F.col("print").alias("fp")), distance)
    named = lambda c: prints.select(F.col("print").alias(c), F.col("fp").alias(f"{c}_fp"))
    apart = found.join(named("a"), "a").join(named("b"), "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    same = nodes.join(prints.where("n > 1").select("print", F.col("fp").alias("a")), "print").where("fp <> a").select("a", F.col("fp").alias("b"))
    return apart.unionByName(same)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs a, b of nodes whose bags are similar enough."""
    bags = lambda c: sets.select(F.col("fp").alias(c), F.col("bag").alias(f"{c}_bag"))

    def check(batches):
        import pyarrow as pa

        for batch in slices(batches):
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("a_bag", "b_bag"))
            good = [similarity(p, q) >= least - 1e-9 for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(bags("a"), "a").join(bags("b"), "b").mapInArrow(check, "a long, b long")


def links(df: DataFrame, nodes: DataFrame, *, text_col: str = "text", least: float = 0.8, words: int = 5, block: int = BLOCK) -> DataFrame:
    """a, b: verified links that hold the components of the candidates together. Nodes have fp, size, text_hash, keys and print."""
    rows = nodes.select("fp", "size", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("all"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.sum("size").alias("size")).where("n > 1")
    buckets = buckets.groupBy("n", "all", "lo", "hi", "size").agg(F.min("key").alias("key"))  # the same members: one bucket
    buckets = written(buckets.select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "near-buckets")
    members = written(rows.select("fp", "key").join(buckets, "key"), "near-members")
    close = written(close_prints(nodes), "near-close")
    used = members.select("fp").union(close.select("a")).union(close.select("b")).distinct()
    needed = written(nodes.select("fp", "text_hash").join(used, "fp"), "near-needed")
    sets = written(_sets(df, needed, text_col, words), "near-sets")
    first = written(_verified(close, sets, least), "near-first")
    hubs = first.groupBy(F.greatest("a", "b").alias("fp")).agg(F.min(F.least("a", "b")).alias("hub"))  # a group is a node and what is linked to it
    members = written(members.join(hubs, "fp", "left").select("fp", "key", "blocks", F.coalesce("hub", "fp").alias("group")), "near-grouped")
    mixed = members.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
    members = members.join(mixed, "key", "left_semi")
    at = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("at"), j).alias("x"), F.greatest(F.col("at"), j).alias("y")))
    dealt = members.withColumn("at", at).select("fp", "key", "group", F.explode(pairs).alias("pair")).select("fp", "key", "group", "pair.x", "pair.y")

    def search(table):
        import pyarrow as pa

        fp = table.column("fp").to_numpy()
        found = linked([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bag").combine_chunks()], least, table.column("group").to_numpy())
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(fp[a]), "b": pa.array(fp[b])})

    return dealt.join(sets, "fp").groupBy("key", "x", "y").applyInArrow(search, "a long, b long").unionByName(first)


def groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = 5) -> DataFrame:
    """One row per input row: doc_id, component_id (smallest id reachable), root (the component's smallest node) and text_hash."""
    docs = written(_bags(df, id_col, text_col, words), "near")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.first("keys").alias("keys"), F.first("print").alias("print")), "near-nodes")
    roots = written(components(links(df, nodes, text_col=text_col, least=least, words=words)), "near-roots")
    own = nodes.join(roots.union(roots.select(F.col("root"), F.col("root")).distinct()), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.select("doc_id", "fp", "text_hash").join(own.join(smallest, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "component_id", "root", "text_hash")


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = 5) -> DataFrame:
    """One row of each component with all its columns, as simhash.drop_near_copies keeps it."""
    return keep_first(df, groups(df, id_col=id_col, text_col=text_col, least=least, words=words), id_col, text_col)
