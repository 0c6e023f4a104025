"""Registers of dictionary entries: adding, changing, deleting and comparing rows by their key (A-11 to A-13, B-06).

A change returns the new register and the rows that were asked for with ok and reason, so a refused row is neither lost nor
silently taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.functions.storage import stored


def joined_key(*columns: str) -> Column:
    """The columns' values, trimmed and with single spaces, without empty ones, joined by a bar."""
    plain = [F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " ")) for c in columns]
    return F.array_join(F.filter(F.array(*plain), lambda x: x != ""), " | ")


def exists(register: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """keys with found."""
    known = register.select(*key).distinct().withColumn("found", F.lit(True))
    return keys.join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _judged(rows: DataFrame, reason: Column) -> DataFrame:
    return stored(rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()), "register-changes")


def add(register: DataFrame, new: DataFrame, key: list[str], overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Known keys are refused unless overwrite is set, and then replaced; of equal new keys the first by all columns counts; a
    row whose key is empty is refused."""
    order = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in new.columns if c not in key] or [F.lit(1)])
    rows = exists(register, new, key).withColumn("_r", F.row_number().over(order))
    reason = F.when(joined_key(*key) == "", "empty key").when(F.col("_r") > 1, "repeated").when(F.col("found") & F.lit(not overwrite), "exists already")
    judged = _judged(rows, reason)
    taken = judged.where("ok").select(*register.columns)
    return register.join(taken.select(*key), key, "left_anti").unionByName(taken), judged.select(*new.columns, "ok", "reason")


def update(register: DataFrame, changes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """changes: the key's columns, new_<column> for what is to change (null: stays). A change of a key column is refused, as is
    one of a row that is not there; of several changes of one key the first counts."""
    fields = [c.removeprefix("new_") for c in changes.columns if c.startswith("new_")]
    moved = F.lit(False)
    for c in set(fields) & set(key):
        moved = moved | (F.col(f"new_{c}").isNotNull() & (F.col(f"new_{c}") != F.col(c)))
    order = Window.partitionBy(*key).orderBy(*[F.col(f"new_{c}").asc_nulls_last() for c in fields])
    rows = exists(register, changes, key).withColumn("_r", F.row_number().over(order))
    judged = _judged(rows, F.when(~F.col("found"), "not found").when(moved, "the key must not change").when(F.col("_r") > 1, "repeated"))
    new = judged.where("ok").select(*key, *[f"new_{c}" for c in fields if c not in key])
    kinds = dict(register.dtypes)
    out = register.join(new, key, "left")
    return out.select(*[F.coalesce(F.col(f"new_{c}").cast(kinds[c]), F.col(c)).alias(c) if c in fields and c not in key else F.col(c) for c in register.columns]), judged.select(*changes.columns, "ok", "reason")


def delete(register: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys that are not there are refused."""
    judged = exists(register, keys.select(*key).distinct(), key)
    return register.join(judged.where("found").select(*key), key, "left_anti"), judged.select(*key, F.col("found").alias("ok"), F.when(~F.col("found"), "not found").alias("reason"))


def with_parents(rows: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """rows (ok, reason) in which those whose parent is not among parents are refused too."""
    known = parents.select(column).distinct().withColumn("_parent", F.lit(True))
    there = rows.join(known, column, "left").withColumn("_missing", F.col("_parent").isNull() & F.col("ok"))
    return there.withColumn("reason", F.when(F.col("_missing"), F.concat(F.lit(f"unknown {column}"))).otherwise(F.col("reason"))).withColumn("ok", F.col("ok") & ~F.col("_missing")).select(*rows.columns)


def add_under(register: DataFrame, new: DataFrame, key: list[str], parents: DataFrame, parent: str, unique: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Like add, but the parent must exist, and the value of the unique column must not be in the register yet."""
    _, judged = add(register, new, key)
    judged = with_parents(judged, parents, parent)
    if unique:
        taken = register.select(unique).distinct().withColumn("_taken", F.lit(True))
        order = Window.partitionBy(unique).orderBy(F.desc("ok"), *key)
        judged = judged.join(taken, unique, "left").withColumn("_n", F.row_number().over(order))
        clash = F.col("ok") & (F.coalesce("_taken", F.lit(False)) | (F.col("_n") > 1))
        judged = judged.withColumn("reason", F.when(clash, f"{unique} is taken").otherwise(F.col("reason"))).withColumn("ok", F.col("ok") & ~clash)
    judged = stored(judged.select(*new.columns, "ok", "reason"), "register-changes")
    return register.unionByName(judged.where("ok").select(*register.columns)), judged


def compare_templates(old: DataFrame, new: DataFrame) -> DataFrame:
    """pool, change (added, removed, changed, same): templates (pool, fields map<string,string>) as imported against those
    known, whatever the order of their fields. Pools that are added or changed are to be built again."""
    text = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    both = old.select("pool", text(F.col("fields")).alias("a")).join(new.select("pool", text(F.col("fields")).alias("b")), "pool", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select("pool", change.alias("change"))
