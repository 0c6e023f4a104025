"""Quality rules of documents and of their hosts, in DataFrame operations only.

1. Counts of each text: words, their characters, symbols, repeated lines, words in repeated three-word windows. They are
   stored, so that texts are read once.
2. Each rule's failures are summed by host, within each map task first.
3. A host's failure rate is shrunk towards the rates of all hosts: a beta prior per rule, whose mean is the share of all rows
   that fail and whose strength comes from how much hosts differ beyond chance (analysis of variance of the rates), from
   ``LEAST_STRENGTH`` rows, so that a document or two are no verdict about a host, to ``MOST_STRENGTH``, also where hosts differ
   by no more than chance.
4. A host fails if for some rule the shrunk rate, less ``sureness`` standard deviations of its posterior, is above ``most``.
   Documents of failed hosts go, besides those that fail by themselves.
5. The verdicts of hosts with more than one in ``HOT`` of all rows (fewer than HOT hosts) are broadcast; other hosts' rows
   meet theirs in a join by host, where none is frequent.

Cases: null text has no words; null host is a host of its own; repeated rows count as often as they occur; empty texts fail
for want of words; an empty table gives an empty result; further columns are ignored whatever their names. A text is one array
of words at a time in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuyere.llm.shared import SPACE_PATTERN, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOL_PATTERN = r"[#*$%&|<>]"
HOT, LEAST_STRENGTH, MOST_STRENGTH = 1000, 10.0, 10_000.0
#: What a document fails: the first two decide about it alone, all of them about its host.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
OWN_RULES = ["few_words", "repeats"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more. Windows are ordered by hash, and neighbours of equal
    hash are compared by their words; the places of repeated ones then cover three words each, or up to the next place."""
    at = lambda k: F.get(words, k)
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda k: F.struct(F.xxhash64(at(k), at(k + 1), at(k + 2)).alias("h"), k.alias("k")))

    def same(x: Column, y: Column) -> Column:
        a, b = x["k"], y["k"]
        return (x["h"] == y["h"]) & (at(a) == at(b)) & (at(a + 1) == at(b + 1)) & (at(a + 2) == at(b + 2))

    repeated = let(F.sort_array(windows), lambda s: F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["k"]))
    covered = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    total = let(F.sort_array(repeated), lambda p: F.aggregate(covered(p), F.lit(0), lambda n, x: n + x))
    return F.when(F.size(words) > 3, total).otherwise(0)


def text_counts(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host and the counts of each text."""
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    bare = F.trim(F.col("text"), F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_PATTERN))
    in_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    in_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    found = source.select("doc_id", "host", in_words.alias("w"), in_lines.alias("l"), F.length(F.regexp_replace("text", SPACE_PATTERN, "")).alias("word_chars"), F.regexp_count("text", F.lit(SYMBOL_PATTERN)).alias("n_symbols"))
    return found.select("doc_id", "host", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")])


def host_rates(counts: DataFrame, rules: dict[str, str], most: float, sureness: float) -> DataFrame:
    """host, n, for each rule its shrunk rate (rate_<rule>), and bad."""
    hosts = written(counts.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(f"f_{name}") for name, rule in rules.items()]), "hosts")
    moments = [F.count("*").alias("m"), F.sum("n").alias("all"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")]
    moments += [x for r in rules for x in (F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}"))]
    total = hosts.agg(*moments).first()  # one row
    n, m = total["all"] or 0, total["m"]
    bad, rates = F.lit(False), []
    for r in rules:
        mean, strength = (total[f"f_{r}"] or 0) / max(n, 1), MOST_STRENGTH
        if n > m > 1:
            between = (total[f"q_{r}"] - n * mean * mean) / (m - 1)
            within = (total[f"f_{r}"] - total[f"q_{r}"]) / (n - m)
            size = (n - total["squares"] / n) / (m - 1)
            spread = between + (size - 1) * within
            alike = (between - within) / spread if spread > 0 else 0.0  # correlation of a host's rows
            strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / alike - 1)) if alike > 0 else MOST_STRENGTH
        rate = (F.col(f"f_{r}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        rates.append(rate.alias(f"rate_{r}"))
        bad = bad | (rate - sureness * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength) + 1)) > most)
    return hosts.select("host", "n", *rates, bad.alias("bad"))


def judge(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] | None = None, own_rules: list[str] | None = None, most: float = 0.5, sureness: float = 2.0) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rows, rate_<rule> of the host, host_failed, kept."""
    rules, own = rules or RULES, own_rules or OWN_RULES
    counts = written(text_counts(df, id_col, text_col, host_col), "rule-counts")
    hosts = host_rates(counts, rules, most, sureness)
    rows = counts.count()
    hosts = hosts.withColumnsRenamed({"host": "of_host", "n": "host_rows", "bad": "host_failed"})
    hot, same = F.col("host_rows") * HOT > rows, F.col("host").eqNullSafe(F.col("of_host"))
    found = counts.join(F.broadcast(hosts.where(hot)), same)
    rest = counts.join(F.broadcast(hosts.where(hot).select("of_host")), same, "left_anti").join(hosts.where(~hot), same)
    failed = F.coalesce(F.expr(" or ".join(f"({rules[r]})" for r in own)), F.lit(False))
    return found.unionByName(rest).drop("of_host").withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("host_failed"))
