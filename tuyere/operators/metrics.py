"""Evaluation metrics, overlaps and flow diagrams (I family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def durations(df: DataFrame, group: str, seconds: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count(seconds).alias("n"), F.avg(seconds).alias("mean_s"), F.stddev_samp(seconds).alias("sd_s"))


def pooled_ratio(df: DataFrame, group: str, part: Column, whole: Column) -> DataFrame:
    """The ratio of the sums, not the mean of ratios."""
    return df.groupBy(group).agg(F.try_divide(F.sum(part).cast("double"), F.sum(whole).cast("double")).alias("ratio"))


def reuse(df: DataFrame, item: str, task: str, least: int = 2) -> DataFrame:
    """The share of items that so many tasks use."""
    return df.groupBy(item).agg(F.countDistinct(task).alias("n")).agg(F.count("*").alias("n_items"), F.avg((F.col("n") >= least).cast("double")).alias("share"))


def adaptation(df: DataFrame, group: str, value: Column, baseline: Column, reverse: bool = False) -> DataFrame:
    ok = value <= baseline if reverse else value >= baseline
    return df.groupBy(group).agg(F.avg(ok.cast("double")).alias("rate"))


def completion(df: DataFrame, group: str, on_time: Column, good: Column) -> DataFrame:
    return df.groupBy(group).agg(F.avg((on_time & good).cast("double")).alias("rate"))


def two_level(df: DataFrame, cohort: str, member: str, value: Column) -> DataFrame:
    """Means of members first, then mean and deviation of these."""
    return df.groupBy(cohort, member).agg(F.avg(value).alias("m")).groupBy(cohort).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))


def improvement(before: Column, after: Column, higher_is_better: bool = True) -> Column:
    return F.try_divide(after - before if higher_is_better else before - after, before) * 100


def sankey(d: DataFrame, levels: list[str]) -> DataFrame:
    """source, target, n: links between neighbouring levels."""
    out = None
    for a, b in zip(levels, levels[1:], strict=False):
        part = d.groupBy(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def survey_links(df: DataFrame) -> DataFrame:
    """Two links for each valid question (numbers that add up)."""
    c = df.select("question", *[F.expr(f"try_cast({x} as int)").alias(x) for x in ("yes", "no", "total")]).where("yes is not null and no is not null and yes + no = total")
    return c.select("question", F.expr("stack(2, 'Yes', yes, 'No', no) as (answer, n)"))


def clean_name(c: Column) -> Column:
    """Single spaces, only letters, digits and a few signs; blanks and dashes as null."""
    x = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^\p{L}\p{N} _\-()/.%]", ""))
    return F.when(~x.isin("", "-", "—", "NA"), x)


def overlap(df: DataFrame, source: str, item: str, sources: list[str]) -> DataFrame:
    """membership, n: how many items are in exactly which sources; all combinations count."""
    flags = F.concat_ws("&", *[F.when(F.max((F.col(source) == s).cast("int")) == 1, F.lit(s)) for s in sources])
    sets = df.where(F.col(item).isNotNull()).groupBy(item).agg(flags.alias("membership")).where("membership <> ''")
    return sets.groupBy("membership").agg(F.count("*").alias("n"))


def matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.lit(1)).na.fill(0)
