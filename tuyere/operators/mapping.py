"""Column mapping, feature assembly, model registry and messages (H family)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The pools in their order, and what column names say for them: names that must be equal, words that must be
# inside, and what they add to the pools whose name holds a word.
POOLS = ["Continuous time-series data", "Discrete time-series data", "Text data", "Binary status data", "Controllable data", "Constraint data", "Batch time-series data", "Image data", "Response data"]
POOL_SIGNS = [
    ("equal", ["timestamp", "time", "datetime"], {"continuous": 2.0, "discrete": 1.0}),
    ("inside", ["image", "picture", "photo"], {"image": 3.0}),
    ("inside", ["text", "content", "description", "note"], {"text": 3.0}),
    ("inside", ["status", "state", "flag", "binary"], {"binary": 2.0}),
]


def _source(c: Column) -> Column:
    return F.translate(F.lower(c), "_-", "  ")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def similarity(a: Column, b: Column) -> Column:
    """Of a column's name a (underscores and hyphens as spaces) and a target's name b, without case: 1 if equal, else the
    larger of the ratio of lengths if one holds the other, and the share of words in common."""
    x, y = _source(a), F.lower(b)
    ratio = F.when(x.contains(y) | y.contains(x), F.try_divide(F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y)))).otherwise(0.0)
    p, q = _words(x), _words(y)
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect(p, q)), F.greatest(F.size(p), F.size(q))), F.lit(0.0))
    return F.when(x == y, 1.0).otherwise(F.greatest(F.coalesce(ratio, F.lit(0.0)), shared))


def _parts(x: Column, least: float) -> Column:
    """All parts of a name that are long enough to reach the ratio."""
    n = F.length(x)
    sizes = F.sequence(F.greatest(F.lit(1), F.ceil(n * least - 1e-9).cast("int")), F.greatest(n, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda at: F.substring(x, at, k)))))


def discover(columns: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """source, target, score: for each column the best name: an equal one, else the best score, else the first by ordinal.

    Candidates are found by equal keys, and none is lost. A name that holds another of nearly its length has it among its
    parts of that length. Names that share most words share one of the few rarest words of each, so the join on words does
    not meet at frequent ones. Empty names have no candidates."""
    left = columns.select("source", _source(F.col("source")).alias("x")).where("x <> ''").distinct()
    right = names.select("target", "ordinal", F.lower("target").alias("y")).where("y <> ''")
    whole, part = F.col("k"), lambda c: F.explode(_parts(F.col(c), least)).alias("k")
    inside = left.select("source", F.col("x").alias("k")).join(right.select("target", "ordinal", part("y")), "k").drop("k")
    around = left.select("source", part("x")).join(right.select("target", "ordinal", F.col("y").alias("k")), "k").drop("k")
    words = lambda df, c, *keep: df.select(*keep, _words(F.col(c)).alias("w"))
    p, q = words(left, "x", "source"), words(right, "y", "target", "ordinal")
    counts = p.select(F.explode("w").alias("word")).unionAll(q.select(F.explode("w").alias("word"))).groupBy("word").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, *keep: str) -> DataFrame:
        ranked = df.select(*keep, F.size("w").alias("m"), F.explode("w").alias("word")).join(counts, "word")
        listed = ranked.groupBy(*keep, "m").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("l"))
        few = F.slice("l", 1, F.col("m") - F.ceil(F.col("m") * least - 1e-9).cast("int") + 1)
        return listed.select(*keep, F.explode(few).alias("e")).select(*keep, F.col("e.word").alias("k"))

    sharing = rarest(p, "source").join(rarest(q, "target", "ordinal"), "k").drop("k")
    found = inside.unionByName(around).unionByName(sharing).distinct()
    found = found.withColumn("score", similarity(F.col("source"), F.col("target"))).where(F.col("score") >= least)
    equal = _source(F.col("source")) == F.lower("target")
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(equal), F.desc("score"), "ordinal", "target"))
    return found.withColumn("r", best).where("r = 1").select("source", "target", F.round("score", 6).alias("score"))


def apply_rules(df: DataFrame, rules: dict[str, tuple[str, float]]) -> tuple[DataFrame, list[str]]:
    """Columns renamed, multiplied and cast to double; and the columns that no rule maps."""
    kept = [(F.col(f"`{c}`") * F.lit(float(f))).cast("double").alias(t) for c, (t, f) in rules.items() if c in df.columns]
    return df.select(*kept), [c for c in df.columns if c not in rules]


def map_table(df: DataFrame, rules: dict[str, tuple[str, float]], names: DataFrame | None = None, required: list[str] = (), least: float = 0.6) -> tuple[DataFrame, dict]:
    """df mapped by the rules and, where names (target, ordinal) are given, by rules found for the columns that have none; and
    a report: success (some column is mapped), mapped and unmapped columns, the rules found, and warnings for required source
    columns that df lacks. Of two columns found for one target only the one with the better score is mapped."""
    rest, found = [c for c in df.columns if c not in rules], {}
    if names is not None and rest:
        sources = df.sparkSession.createDataFrame([(c,) for c in rest], "source string")
        taken = {t for t, _ in rules.values()}
        for r in sorted(discover(sources, names, least).collect(), key=lambda r: (-r.score, r.source)):  # a row a column
            if r.target not in taken:
                taken.add(r.target)
                found[r.source] = (r.target, 1.0)
    mapped, unmapped = apply_rules(df, rules | found)
    missing = [f"required column {c} is missing" for c in required if c not in df.columns]
    return mapped, {"success": len(unmapped) < len(df.columns), "mapped": [c for c in df.columns if c not in unmapped], "unmapped": unmapped, "found": {c: t for c, (t, _) in found.items()}, "warnings": missing}


def pool_of(columns: list[str]) -> str:
    """The pool with the highest score, the first of equals; the first pool where no column name says anything."""
    names = {c.lower() for c in columns}
    score = dict.fromkeys(POOLS, 0.0)
    for how, signs, gains in POOL_SIGNS:
        if any(w in names if how == "equal" else any(w in c for c in names) for w in signs):
            for pool in POOLS:
                score[pool] += sum(gain for word, gain in gains.items() if word in pool.lower())
    return max(POOLS, key=score.get)


def assemble(df: DataFrame, columns: list[str], method: str = "zscore", name: str = "features") -> DataFrame:
    """An array of 32-bit features: NaN and null as 0, scaled by population z-score, min-max or first quartile and IQR."""
    from tuyere.operators import scale

    clean = df.select("*", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_f{k}") for k, c in enumerate(columns)])
    cols = [f"_f{k}" for k in range(len(columns))]
    p = scale.parameters(clean, cols, {"zscore": "zscore_pop", "minmax": "minmax", "robust": "iqr_q1"}[method])
    return scale.apply(clean, p, cols).withColumn(name, F.array(*[F.col(c).cast("float") for c in cols])).drop(*cols)


def infer_onnx(df: DataFrame, model: bytes, features: str = "features", name: str = "prediction") -> DataFrame:
    """The model's first output for each row, a session per task and one batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(model, options)
        entry = session.get_inputs()[0].name
        for x in batches:
            out = session.run(None, {entry: np.stack(x.to_numpy()).astype(np.float32)})[0]
            yield pd.Series(list(out.reshape(len(x), -1)))

    return df.withColumn(name, run(features))


def registry_list(models: DataFrame, tag: tuple[str, str] | None = None) -> DataFrame:
    if tag:
        models = models.where(F.try_element_at("tags", F.lit(tag[0])) == tag[1])
    return models.orderBy(F.desc("created"), "name")


def messages(df: DataFrame, kind: Column, channel: Column, source: Column, at: Column) -> DataFrame:
    """Rows as messages with a JSON payload of all columns."""
    return df.select(F.sha2(F.to_json(F.struct("*")), 256).alias("message_id"), kind.alias("message_type"), channel.alias("channel"), source.alias("source"), F.to_json(F.struct("*")).alias("payload"), at.alias("at"))


def channel_statistics(bus: DataFrame) -> DataFrame:
    return bus.groupBy("channel").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def history(bus: DataFrame, order: list[str], n: int = 1000) -> DataFrame:
    return bus.orderBy(*[F.desc(c) for c in order]).limit(n)
