"""How quality filters interact: what each removes in every order of application, by part of the corpus and by label.

1. Each row's failures are a mask, one bit a filter. Which filter removes the row is a look-up: a table of masks by orders
   holds the step of the first filter in the order that the mask has.
2. Rows of equal mask, part and labels are counted before they reach Python, within each map task first. For equal texts,
   the copy filter spares the row of the smallest id; a text's rows are counted by part and labels, so a large group of
   copies is a few rows.
3. ``mapInArrow`` looks up the steps of all orders at once, ``np.bincount`` adds the counts to an array of part, label, order
   and step, and each task gives its arrays as rows, which are summed. All figures are sums, so partial ones add up.

Cases: null texts and parts count as empty; equal ids with equal texts are separate rows of which none is a copy of the other;
null ids are larger than all others and have no label; of several labels of one id, one of 1 is enough; further columns are
ignored whatever their names; an empty table gives an empty result; texts are taken whole, one at a time.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.llm.shared import slices, written

#: The letters of the filters, a bit each from the lowest.
FILTERS = "ABCDE"
UPPER, ODD = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Parts whose arrays a task holds at a time.
PARTS = 256
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def orders(n: int) -> np.ndarray:
    """All orders of n filters, by row."""
    return np.array(list(permutations(range(n))))


def first_failures(n: int) -> np.ndarray:
    """For each mask and each order the step, from 0, whose filter removes a row with that mask; n if none does."""
    fails = (np.arange(1 << n)[:, None, None] >> orders(n)[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), n)


def text_failures(raw: bytes, code_points: int) -> int:
    """The mask of what a text by itself fails: too few words, few different words, capitals, odd signs."""
    words = raw.split()  # at ASCII white space, as of bytes
    capitals = len(raw) - len(raw.translate(None, UPPER))
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * code_points, len(raw) > len(raw.translate(None, ODD)))
    return sum(1 << k for k, failed in enumerate(tests) if failed)


def text_marks(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, mask of the text's own failures, digest."""
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def mark(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in slices(batches, 500):
            text = batch.column(2)
            raw = text.cast(pa.binary()).to_pylist()
            masks = [text_failures(x, n) for x, n in zip(raw, pc.utf8_length(text).to_pylist(), strict=True)]
            digests = [hashlib.sha256(x).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    return source.mapInArrow(mark, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def with_copies(marks: DataFrame, labels: DataFrame, bit: int) -> DataFrame:
    """part, mask, good, toxic, n: how many rows. The mask gets the bit where a smaller id has the same digest."""
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1000))).otherwise(0)  # null ids meet no label, so they needn't meet
    of_id = labels.groupBy(F.col("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    rows = marks.withColumn("salt", salt.cast("long")).join(of_id, ["doc_id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    keys = ["digest", "mask", "part", "good", "toxic"]
    of_text = rows.groupBy("doc_id", "salt", *keys).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.min_by(F.struct("doc_id", F.col("n").alias("first")), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("least"))
    # ids may be null on all rows of a text: then several rows (of the same salt) have the least one, and none is larger
    text = Window.partitionBy("digest")
    of_text = of_text.withColumn("smallest", F.min("least.doc_id").over(text))
    first = F.when(F.col("least.doc_id").eqNullSafe(F.col("smallest")), F.col("least.first")).otherwise(0)
    both = F.array(F.struct("mask", first.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - first).alias("n")))
    return of_text.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def interactions(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts COUNTS, from rows (part, good, toxic, mask, n)."""
    n_filters = len(letters)

    def look_up(batches):
        import pyarrow as pa

        table, order = first_failures(n_filters), orders(n_filters)
        n_orders, step_of = len(order), np.argsort(order, 1)
        names = ["".join(letters[f] for f in x) for x in order]
        shape = (4, n_orders, n_filters + 1)
        parts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows_of(part: str):
            lost, masks = parts[part]
            removed = lost.sum(0)[:, :n_filters]
            fails = np.array([masks[(np.arange(len(masks)) >> f & 1) == 1].sum() for f in range(n_filters)])
            share = np.array([removed[np.arange(n_orders), step_of[:, f]].sum() for f in range(n_filters)])
            figures = [masks.sum() - removed.cumsum(1), removed, fails[order] - removed, masks[1 << order], lost[[1, 3], :, :n_filters].sum(0), lost[[2, 3], :, :n_filters].sum(0), share[order]]
            columns = [pa.array([part] * removed.size), pa.array([x for x in names for _ in range(n_filters)]), pa.array(np.tile(np.arange(1, n_filters + 1, dtype=np.int32), n_orders))]
            return pa.RecordBatch.from_arrays(columns + [pa.array(x.ravel().astype(np.int64)) for x in figures], names=["part", "filter_order", "step", *COUNTS])

        for batch in slices(batches, 5000):
            part, good, toxic, mask, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "good", "toxic", "mask", "n"))
            label = good.astype(np.int64) + 2 * toxic.astype(np.int64)
            for name in set(part):
                if name not in parts:
                    parts[name] = np.zeros(shape, np.int64), np.zeros(1 << n_filters, np.int64)
                here = part == name
                at = (label[here, None] * n_orders + np.arange(n_orders)) * (n_filters + 1) + table[mask[here]]
                # counts are whole numbers, exact in doubles up to 2 ** 53
                lost, masks = parts[name]
                lost += np.bincount(at.ravel(), np.repeat(n[here], n_orders), lost.size).astype(np.int64).reshape(shape)
                masks += np.bincount(mask[here], n[here], masks.size).astype(np.int64)
            if len(parts) > PARTS:
                yield from map(rows_of, parts)
                parts.clear()
        yield from map(rows_of, parts)

    rows = counts.select("part", "good", "toxic", "mask", F.col("n").cast("long").alias("n"))
    partial = rows.mapInArrow(look_up, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters of texts: a row per part, order and step, zeros included. labels has doc_id, quality and toxic."""
    marks = written(text_marks(df, id_col, text_col, part_col), "audit-marks")
    return interactions(with_copies(marks, labels, 1 << FILTERS.index("E")))
