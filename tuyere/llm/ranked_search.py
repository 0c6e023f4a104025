"""Ranked lexical search: the best documents of each item of a query set, by windowed bucket scoring.

1. Items are taken in blocks of at most ``TERMS`` terms, repeats included; a block's dictionary goes to all tasks.
2. Each document is read whole, once a block, and gives its number of terms and, for terms of the dictionary, (term, count):
   the postings. They are stored; the documents a term is in, and the sums over all documents, are counted from them.
3. Postings are dealt by range of id and ordered by it. A task goes through them in windows of ``WINDOW`` documents: it puts
   the window's postings in order of their terms, adds each of an item's terms into an array with a place per document, marks
   the places in a bitset, and harvests the marked places into the item's heap of the best.
4. The heaps of all tasks are merged by item; the best of each are taken before and after the shuffle.

All is in 64-bit whole numbers but the terms' weights. Weight of a term: floor(1000 ln((2N + 2) / (2df + 1))).

Cases: null texts and items have no terms, and get no rows; equal scores go by id, null ids last; repeated rows are documents
of their own, as are repeated items; further columns are ignored whatever their names; an empty table on either side gives an
empty result. A document's postings are at most as many as the dictionary's terms, whatever its length.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.llm.shared import slices, written

#: Bytes that are in no term become spaces, capitals small letters; bytes of other than ASCII characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Terms of a block of items, repeats included, and documents of a window: their scores take 32 KB.
TERMS, WINDOW = 100_000, 4096


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def blocks(items: DataFrame):
    """(the items' ids, their terms as counters) in blocks; the items come from Spark a partition at a time."""
    ids, bags, n = [], [], 0
    for row in items.toLocalIterator():
        bag = Counter(terms_of((row.text or "").encode()))
        if n and n + bag.total() > TERMS:
            yield ids, bags
            ids, bags, n = [], [], 0
        if bag:
            ids, bags, n = [*ids, row.item_id], [*bags, bag], n + bag.total()
    if ids:
        yield ids, bags


def postings(docs: DataFrame, dictionary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms (those of the dictionary, ascending) and how often each occurs. No row without terms."""

    def count(batches):
        import pyarrow as pa

        for batch in slices(batches, 500):
            out: list[tuple] = []
            for k, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(raw)
                if words:
                    known = np.fromiter(map(dictionary.get, words, repeat(-1)), np.int32, len(words))
                    out.append((k, len(words), *np.unique(known[known >= 0], return_counts=True)))
            lists = lambda j: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[j]) for x in out)]), pa.int32()), pa.array(np.concatenate([x[j] for x in out] or [np.empty(0)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in out], pa.int32())), pa.array([x[1] for x in out], pa.int64()), lists(2), lists(3)], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, counts array<int>")


class Best:
    """The best documents of an item that were seen so far. Documents come in ascending order of ids, so of equal scores the
    earlier stays."""

    def __init__(self, most: int):
        self.most, self.heap = most, []

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.most else 0

    def put(self, scores: np.ndarray, places: np.ndarray, seen: int) -> None:
        over = scores > self.least()
        scores, places = scores[over], places[over]
        if len(scores) > self.most:
            order = np.lexsort((places, -scores))[: self.most]
            scores, places = scores[order], places[order]
        for score, place in zip(scores.tolist(), places.tolist(), strict=True):
            entry = (score, -(seen + place))
            if len(self.heap) < self.most:
                heapq.heappush(self.heap, entry)
            else:
                heapq.heappushpop(self.heap, entry)


def window_scores(n: np.ndarray, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int):
    """For each item, its number, scores and places of the documents of a window that have any of its terms. starts: where each
    document's postings begin; bags: each item's terms and how often it has them."""
    places = np.repeat(np.arange(len(n)), np.diff(starts))
    m = 75 + 25 * n * n_docs // n_terms
    order = np.argsort(terms, kind="stable")
    terms, places, counts = terms[order], places[order], counts[order].astype(np.int64)
    parts = 1_000_000_000 * counts // (1000 * counts + 12 * m[places])
    first = np.searchsorted(terms, np.arange(len(weights) + 1))
    sums = np.zeros(len(n), np.int64)
    bits: dict[int, np.ndarray] = {}
    for item, (own, times) in enumerate(bags):
        occupied = np.zeros((len(n) + 7) // 8, np.uint8)
        for term, factor in zip(own.tolist(), (weights[own] * times).tolist(), strict=True):
            a, b = first[term], first[term + 1]
            if a < b and factor:
                sums[places[a:b]] += factor * parts[a:b]  # a document has a term once here
                if term not in bits:
                    here = np.zeros(len(n), bool)
                    here[places[a:b]] = True
                    bits[term] = np.packbits(here)
                occupied |= bits[term]
        marked = np.flatnonzero(np.unpackbits(occupied, count=len(n)))
        if len(marked):
            yield item, sums[marked], marked
            sums[marked] = 0


def best_of_block(index: DataFrame, ids: list, id_type: str, bags: list[Counter], dictionary: dict[bytes, int], most: int) -> DataFrame:
    """item_id, item (its number), doc_id, score: the best documents of each task."""
    total = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    found = {r.term: r.df for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # no more than the dictionary
    weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * found.get(k, 0) + 1))) for k in range(len(dictionary))], np.int64)
    coded = [(np.array([dictionary[t] for t in bag], np.int64), np.array(list(bag.values()), np.int64)) for bag in bags]
    n_docs, n_terms = total.docs, total.terms

    def score(batches):
        import pyarrow as pa

        best: dict[int, Best] = {}
        kept: dict[int, object] = {}  # the ids of documents in heaps, by their number in the task
        id_kind, seen, held = None, 0, []

        def window():
            nonlocal seen, kept
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("terms").chunk(0)
            starts = lists.offsets.to_numpy()
            n = table.column("n").to_numpy()
            for item, scores, places in window_scores(n, lists.flatten().to_numpy(), table.column("counts").chunk(0).flatten().to_numpy(), starts - starts[0], coded, weights, n_docs, n_terms):
                best.setdefault(item, Best(most)).put(scores, places, seen)
            wanted = {-e[1] for x in best.values() for e in x.heap}
            here = sorted(k - seen for k in wanted if k >= seen)
            kept = {k: v for k, v in kept.items() if k in wanted} | dict(zip([k + seen for k in here], table.column("doc_id").take(here).to_pylist() if here else [], strict=True))
            seen += len(n)

        for batch in slices(batches, WINDOW):
            id_kind = batch.schema.field("doc_id").type
            while batch.num_rows:
                room = WINDOW - sum(x.num_rows for x in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(x.num_rows for x in held) == WINDOW:
                    window()
                    held.clear()
        if held:
            window()
        if best:
            rows = [(item, kept[-place], value) for item, x in best.items() for value, place in x.heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    spark = index.sparkSession
    places = index.withColumn("row", F.monotonically_increasing_id())  # so that rows of one id can be dealt to several tasks
    dealt = places.repartitionByRange(F.asc_nulls_last("doc_id"), "row").sortWithinPartitions(F.asc_nulls_last("doc_id"), "row").drop("row")
    scored = dealt.mapInArrow(score, f"item int, doc_id {index.schema['doc_id'].dataType.simpleString()}, score long")
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {id_type}")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # no more names than a block has terms


def search(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = 20) -> DataFrame:
    """item_id, rank from 1, doc_id, score: the ``most`` best documents of each item with a score above 0."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    wanted = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    id_type, results = wanted.schema["item_id"].dataType.simpleString(), []
    for ids, bags in blocks(wanted):
        dictionary = {t: k for k, t in enumerate(dict.fromkeys(t for bag in bags for t in bag))}
        index = written(postings(docs, dictionary), "postings")
        results.append(best_of_block(index, ids, id_type, bags, dictionary, most))
    if not results:
        return df.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return reduce(DataFrame.unionByName, results)
