"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three characters; letters in lower case, all
else as a space), counted over all learning documents. A document's own most frequent n-grams are compared to each profile
by the out-of-place distance: the sum over the document's n-grams of how far their ranks lie apart, and the profile's length
for those that it lacks. The nearest language wins, the first by name of equals.

Cases: a null text and one without a letter get ``und`` and score 0; rows without a language are not learned from; without
any labelled row every document gets ``und``; ties of count are ordered by n-gram; whole texts count, whatever their length;
repeated rows give equal rows; an empty table gives an empty result; columns named as the results, in any case, are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuyere.llm.shared import remainder, slices, unused

PROFILE_LENGTH = 400
DOCUMENT_LENGTH = 300

_letters: np.ndarray | None = None


def _codes(text: str) -> np.ndarray | None:
    """Code points in lower case, one space for what is no letter; None without a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    alpha = _letters[codes]
    if not alpha.any():
        return None
    codes = np.where(alpha, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = alpha[1:] | alpha[:-1]
    return np.concatenate([[32], codes[keep], [32]]).astype(np.int64)


def ngrams(text: str | None, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray] | None:
    """(n-grams as numbers, counts); very long texts are counted block by block."""
    codes = _codes(text) if text else None
    if codes is None:
        return None
    found = []
    for at in range(0, len(codes), block):
        one = codes[at : at + block + 2]
        last = at + block >= len(codes)
        n = len(one) if last else block
        two, three = one[:-1] | one[1:] << 21, one[:-2] | one[1:-1] << 21 | one[2:] << 42
        grams = np.concatenate([one[:n], two[:n], three[:n]])
        found.append(np.unique(grams[grams != 32], return_counts=True))
    return found[0] if len(found) == 1 else merge(found)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return names, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order."""
    if len(grams) > 4 * most:  # leave out what cannot be among the first; all that tie with the last stay
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:most]]


def profiles(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", length: int = PROFILE_LENGTH) -> dict[str, list[int]]:
    """The profile of each language of df; they come to the driver, so many n-grams a language."""
    source = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and text is not null")

    def count(batches):
        import pyarrow as pa

        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in sorted(held.items()):
                grams, counts = merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

        for batch in slices(batches, 500):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (got := ngrams(text)) is not None:
                    held.setdefault(lang, []).append(got)
                    size += len(got[0])
            if size > 2_000_000:
                held = {lang: [merge(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > 1_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    counts = source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    out: dict[str, list[int]] = {}
    for x in sorted(top.select("lang", "rank", "gram").collect()):
        out.setdefault(x.lang, []).append(x.gram)
    return out


class Comparison:
    """Out-of-place distances to all profiles."""

    def __init__(self, known: dict[str, list[int]], length: int) -> None:
        self.langs, self.length = sorted(known), length
        self.sorted = []
        for lang in self.langs:
            grams = np.array(known[lang], np.int64)
            order = np.argsort(grams)
            self.sorted.append((grams[order], order))

    def predict(self, text: str | None, most: int = DOCUMENT_LENGTH) -> tuple[str, float]:
        """(language, 1 - distance / largest possible distance)."""
        got = ngrams(text)
        if got is None or not self.langs:
            return "und", 0.0
        own = ranked(*got, most)
        ranks, best = np.arange(len(own)), ("und", -1.0)
        for lang, (grams, rank) in zip(self.langs, self.sorted, strict=True):
            place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            away = np.where(grams[place] == own, np.minimum(np.abs(rank[place] - ranks), self.length), self.length)
            score = 1.0 - float(away.sum()) / (self.length * len(own))
            if score > best[1]:
                best = (lang, score)
        return best


def predict(df: DataFrame, known: dict[str, list[int]], *, text_col: str = "text", length: int = PROFILE_LENGTH) -> DataFrame:
    """df with lang_pred and score; columns of these names are replaced. No shuffle."""
    rest = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").alias(unused(df, "text")))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["lang_pred string", "score double"])

    def run(batches):
        import pyarrow as pa

        compare = Comparison(known, length)
        for batch in slices(batches, 500):
            got = [compare.predict(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*rest, "lang_pred", "score"])

    return source.mapInArrow(run, fields)


def identify(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df with held_out (crc32 of the id modulo 4 is 2), lang_pred and score; learns from the rows that are not held out."""
    rows = df.withColumn("held_out", F.coalesce(remainder(F.col(f"`{id_col}`"), 4) == 2, F.lit(False)))
    known = profiles(rows.where(~F.col("held_out")), text_col=text_col, lang_col=lang_col)
    return predict(rows, known, text_col=text_col)
