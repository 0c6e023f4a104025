"""Mixing sources to target weights by capped water-filling.

The budget is shared among sources by weight; a source whose share is above its size times ``most_epochs`` is clamped
there, and the excess goes to the others by weight, until no share is above its cap. This fixed point is found in closed
form: in the order of cap per weight, a source is clamped as long as its ratio is below the level that the others would
get. A document is repeated as often as its source's target holds whole epochs; for the fraction left, documents are taken
in a seeded order until the fraction of the source's size is met.

The seeded order is cut into 4096 bins a source by the first digits of a digest. Sums per bin, made before any shuffle,
tell which bins are taken whole; only the documents of the one bin at the edge are put in order, so no task gets a source.

Cases: a null text has size 0; a null source is a source of its own and sorts last; documents of size 0 take 0 words; if
all sizes are 0, all targets are 0; repeated ids are ordered by size and counted each; an empty table gives an empty result;
further columns are ignored, or kept by repeat_documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.llm.shared import WORD_PATTERN, written

#: Fixed by the contract: weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
BIN_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, budget_share: float = 1.0, most_epochs: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size): as many rows as there are sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = table.select("source", "source_size", "place", weight.alias("w"), (F.col("source_size") * F.lit(float(most_epochs))).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    table = table.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(budget_share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("open"),
    )
    table = table.withColumn("clamped", F.col("cap") / F.col("w") <= F.col("left") / F.col("open"))
    level = F.coalesce(F.max(F.when(~F.col("clamped"), F.col("left") / F.col("open"))).over(Window.partitionBy()), F.lit(0.0))
    # past the first source that is not clamped nothing changes the level: left and open fall by the same ratio or less
    first = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("w"), "place", (F.col("left") / F.col("open")).alias("level")))).over(Window.partitionBy())
    level = F.coalesce(first["level"], level)
    return table.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.0, most_epochs: float = 3.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times (whole repetitions and the fractional one), taken."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"), digest.alias("lot"))
    docs = written(docs, "mix-sizes")
    bin_of = F.substring("lot", 1, BIN_DIGITS)
    bins = written(docs.groupBy("source", bin_of.alias("bin")).agg(F.sum("size").alias("n")), "mix-bins")
    plan = written(targets(bins.groupBy("source").agg(F.sum("n").alias("source_size")), budget_share=budget_share, most_epochs=most_epochs, weights=weights), "mix-targets")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))  # words of the fractional repetition

    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = bins.withColumn("upto", F.sum("n").over(upto))
    edge = sums.join(plan.select(F.col("source").alias("s"), "extra"), F.col("source").eqNullSafe(F.col("s"))).where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") < F.col("extra")))
    edge = edge.groupBy("source").agg(F.min(F.struct("bin", (F.col("extra") - F.col("upto") + F.col("n")).alias("rest"))).alias("x"))
    plan = plan.join(edge.select(F.col("source").alias("s"), F.col("x.bin").alias("edge"), F.col("x.rest").alias("rest")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = written(plan, "mix-plan").withColumnRenamed("source", "s")

    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bin", bin_of)
    at_edge = rows.where(F.col("bin") == F.col("edge"))
    ordered = Window.partitionBy("source").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = at_edge.withColumn("upto", F.sum("size").over(ordered)).withColumn("more", F.when(F.col("upto") - F.col("size") / 2.0 <= F.col("rest"), 1).otherwise(0))
    others = rows.where((F.col("bin") != F.col("edge")) | F.col("edge").isNull()).withColumn("more", F.when(F.col("bin") < F.col("edge"), 1).otherwise(0))
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "more"]
    both = others.select(columns).unionByName(at_edge.select(columns))
    times = F.least(F.col("whole") + F.col("more"), F.lit(int(most_epochs)).cast("long"))
    return both.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def repeat_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of df as often as the mix takes them: not at all, once, or several times. Rows of equal id, source and size
    are taken equally often (the most that any of them is)."""
    times = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    times = times.groupBy("doc_id", "source", "size").agg(F.max("times").alias("times")).where("times > 0")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # so that no column's name clashes
    rows = df.select(whole.alias("row"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{source_col}`").alias("s"), words(F.col(f"`{text_col}`")).alias("n"))
    rows = rows.join(times, F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size")))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
