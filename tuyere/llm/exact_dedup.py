"""Exact dedup with an extendible-hash index on shared files, in DataFrame operations only.

1. Every row gets a 64-bit key, the hash of its normalised text; (id, key) rows are written to the shared folder.
2. The directory: its slots are the values of the key's leading ``depth`` bits, and each slot points to a bucket, a range of
   keys. It starts with one bucket; a bucket with more keys than its capacity is split by one more bit, and the directory
   doubles when that bucket had as many bits as the directory. Loads come from one aggregation of the keys into
   ``2 ** MOST_BITS`` cells. The capacity is raised so that about ``MOST_BUCKETS`` buckets are enough for any number of keys;
   a bucket of MOST_BITS bits is not split further, whatever its load: its owner has more to do, and the result is the same.
3. Texts are dealt to buckets through the directory and grouped by (bucket, key, bytes), combined within each map task
   first, so a group of copies sends one row per task whatever its size. Entries of equal key and different bytes stay
   apart: they form the key's chain.
4. Owner tasks take ranges of buckets and write their entries in order: the index files.
5. Rows are dealt to the bucket that the directory names, and nothing else: its owner walks the bucket's keys in order, entries
   and rows together, and each row takes the entry that it has just passed if the keys are equal. Where a chain has more than
   one entry, bytes are compared too. Entries with more than one in ``HOT`` of all rows, fewer than HOT in number, are broadcast,
   so that no owner gets all rows of a frequent text.

Cases: null text counts as empty; all white-space-only texts equal each other when they have any white space, and differ
from the empty one; rows with equal ids and texts are separate rows with equal results (all kept if their id is the
smallest; ``drop_copies`` leaves one of them); null ids count last when the smallest is taken; an empty table gives an empty
result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.llm.shared import SPACE_PATTERN, written

MOST_BITS, MOST_BUCKETS, HOT = 16, 4096, 1000
ENTRY = ["keep_id", "group_size", "text_sha256", "bucket"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_PATTERN, " ")


def _cell(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def split_directory(counts: dict[int, int], capacity: int, most_bits: int) -> list[tuple[int, int]]:
    """The bucket (bits, prefix) of each slot; there are a power of two slots. counts has keys per cell of most_bits bits."""
    below = [0, *accumulate(counts.get(k, 0) for k in range(1 << most_bits))]
    directory, depth, full = [(0, 0)], 0, [(0, 0)]
    while full:
        bits, prefix = full.pop()
        width = most_bits - bits
        if not width or below[(prefix + 1) << width] - below[prefix << width] <= capacity:
            continue
        if bits == depth:
            directory = [x for x in directory for _ in (0, 1)]
            depth += 1
        for half in (2 * prefix, 2 * prefix + 1):
            span = depth - bits - 1
            directory[half << span : (half + 1) << span] = [(bits + 1, half)] * (1 << span)
            full.append((bits + 1, half))
    return directory


def bucket_of(key: Column, directory: list[tuple[int, int]]) -> Column:
    """What the directory's slot of a key points to: the number of the bucket's first slot."""
    depth = len(directory).bit_length() - 1
    first = ",".join(str(prefix << (depth - bits)) for bits, prefix in directory)
    return F.get(F.split(F.lit(first), ",").cast("array<int>"), _cell(key, depth).cast("int"))


def build_directory(keys: DataFrame, capacity: int, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    cells = keys.groupBy("key").count().groupBy(_cell(F.col("key"), most_bits).alias("cell")).agg(F.count("*").alias("n"))
    counts = {x.cell: x.n for x in cells.collect()}  # one number a cell
    return split_directory(counts, max(capacity, 2 * sum(counts.values()) // MOST_BUCKETS), most_bits)


def build_index(source: DataFrame, directory: list[tuple[int, int]]) -> DataFrame:
    """bucket, key, keep_id, group_size, text_sha256: an entry per distinct text, in files that hold ranges of buckets."""
    entries = source.withColumn("bucket", bucket_of(F.col("key"), directory)).groupBy("bucket", "key", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = entries.select("bucket", "key", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256"))
    return written(entries.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "dedup-index")


def look_up(keys: DataFrame, index: DataFrame, directory: list[tuple[int, int]], source: DataFrame) -> DataFrame:
    """doc_id and the entry of each row of keys. A row that the directory sends to another bucket than its entry's finds none."""
    keys = keys.withColumn("bucket", bucket_of(F.col("key"), directory))
    slots = ["bucket", "key"]
    chains = index.groupBy(*slots).agg(F.count("*").alias("n")).where("n > 1").select(*slots)
    if not chains.isEmpty():
        chains = written(chains, "dedup-chains")
        in_chain = source.withColumn("bucket", bucket_of(F.col("key"), directory)).join(chains, slots)
        entry = in_chain.groupBy(*slots, "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        by_bytes = in_chain.join(entry, [*slots, "body"]).select("doc_id", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256"), "bucket")
        index, keys = (x.join(chains, slots, "left_anti") for x in (index, keys))
    else:
        by_bytes = None
    rows = index.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = F.col("group_size") * HOT > rows
    frequent = F.broadcast(index.where(hot))  # fewer than HOT entries: each has more than one row in HOT
    found = keys.join(frequent, slots).select("doc_id", *ENTRY)
    kind = keys.schema["doc_id"].dataType
    entries = index.where(~hot).select("bucket", "key", F.lit(0).alias("probe"), F.lit(None).cast(kind).alias("doc_id"), F.struct("key", *ENTRY).alias("entry"))
    probes = keys.join(F.broadcast(index.where(hot).select(*slots)), slots, "left_anti").select("bucket", "key", F.lit(1).alias("probe"), "doc_id", F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"))
    walk = Window.partitionBy("bucket").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = entries.unionByName(probes).withColumn("passed", F.last("entry", True).over(walk))
    rest = passed.where("probe = 1 and passed.key = key").select("doc_id", *[F.col(f"passed.{c}").alias(c) for c in ENTRY])
    found = found.unionByName(rest)
    return found if by_bytes is None else found.unionByName(by_bytes)


def exact_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4_000, most_bits: int = MOST_BITS, key_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id (smallest id with an equal text), group_size, kept, text_sha256, bucket.

    key_bits below 64 shortens the keys, so that chains can be tested."""
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("body"))
    key = F.xxhash64("body") if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("body"), 64 - key_bits), 64 - key_bits)
    source = source.withColumn("key", key)
    keys = written(source.select("doc_id", "key"), "dedup-keys")
    directory = build_directory(keys, capacity, most_bits)
    found = look_up(keys, build_index(source, directory), directory, source)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket")


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text has no equal under a smaller id, with all their columns. Of rows with equal ids and equal
    texts one stays; rows with equal ids and different texts are told apart by their text's digest."""
    kept = exact_groups(df, id_col=id_col, text_col=text_col).where("kept").select("doc_id", "text_sha256").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # so that no column's name clashes
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.sha2(normalised(F.col(f"`{text_col}`")), 256).alias("sha"), whole.alias("row"))
    rows = rows.join(kept, (F.col("sha") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    return rows.dropDuplicates(["id", "sha"]).select("row.*")
