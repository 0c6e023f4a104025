"""The five-level dictionary as rows (work_type, category, pool, dataset, ordinal): filters, retrieval, trees, search, changes
and statistics (A family), and its import (B-03, B-06, B-07, B-10). The key is always all four names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["work_type", "category", "pool", "dataset"]


def contains(c: Column, text: str) -> Column:
    """Case-insensitive, and literal: % and _ stand for themselves."""
    return F.lower(c).contains(text.lower())


def chain_filter(d: DataFrame, work_type: str | None = None, category: str | None = None, pool: str | None = None) -> DataFrame:
    for name, value in zip(KEY, (work_type, category, pool), strict=False):
        if value is not None:
            d = d.where(F.col(name) == value)
    return d


def retrieve(d: DataFrame, work_types: list[str] = (), categories: list[str] = (), pools: list[str] = (), keyword: str | None = None, fields: tuple[str, ...] = ("dataset",)) -> DataFrame:
    for name, values in zip(KEY, (work_types, categories, pools), strict=False):
        if values:
            d = d.where(F.col(name).isin(list(values)))
    if keyword:
        hit = F.lit(False)
        for f in fields:
            hit = hit | contains(F.col(f), keyword)
        d = d.where(hit)
    return d


def retrieve_task(d: DataFrame, work_types: list[str], categories: list[str], pools: list[str]) -> DataFrame:
    """With categories and pools: those of the categories, then those of the pools whose name is not among them yet."""
    if categories and pools:
        left = retrieve(d, work_types, categories)
        right = retrieve(d, work_types, pools=pools).join(left.select("dataset").distinct(), "dataset", "left_anti")
        return left.unionByName(right)
    return retrieve(d, work_types, categories, pools)


def enrich(d: DataFrame, work_types: DataFrame, categories: DataFrame, pools: DataFrame) -> DataFrame:
    """Left lookups of each level's own columns."""
    return d.join(work_types, "work_type", "left").join(categories, ["work_type", "category"], "left").join(pools, "pool", "left")


def chain_query(d: DataFrame, work_type: str, category: str = "", pool: str = "", dataset: str = "") -> DataFrame:
    """The exact work type if there is one, else those that contain the text; the other levels by containment."""
    exact = d.where(F.col("work_type") == work_type)
    d = d.where(contains(F.col("work_type"), work_type)) if exact.isEmpty() else exact
    for name, value in (("category", category), ("pool", pool), ("dataset", dataset)):
        if value:
            d = d.where(contains(F.col(name), value))
    return d


def tree(d: DataFrame) -> DataFrame:
    """work_type, category, pool, n, datasets: the datasets of each branch in order, grouped so that no list spans branches."""
    return d.groupBy("work_type", "category", "pool").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "dataset"))), lambda x: x["dataset"])).alias("datasets"))


def full_chain(d: DataFrame, work_type: str, attributes: DataFrame | None = None) -> DataFrame:
    """category, ordinal, pools: the work type's categories in order, each with its pools by name, these with their datasets
    in order and the attributes of the pool (pool, attribute, ordinal). A row holds one category's branch."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c))), lambda e: e[c])
    branch = chain_filter(d, work_type).groupBy("category", "pool").agg(F.min("ordinal").alias("first"), listed("dataset").alias("datasets"))
    if attributes is None:
        branch = branch.withColumn("attributes", F.lit(None).cast("array<string>"))
    else:
        own = attributes.groupBy("pool").agg(listed("attribute").alias("attributes"))
        branch = branch.join(own, "pool", "left").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
    return branch.groupBy("category").agg(F.min("first").alias("ordinal"), F.array_sort(F.collect_list(F.struct("pool", "datasets", "attributes"))).alias("pools"))


def search(d: DataFrame, text: str) -> DataFrame:
    """level, name: the names at any level that contain the text."""
    out = None
    for level in KEY:
        hit = d.where(contains(F.col(level), text)).select(F.lit(level).alias("level"), F.col(level).alias("name")).distinct()
        out = hit if out is None else out.unionByName(hit)
    return out


def search_text(d: DataFrame, text: str, fields: list[str], most: int = 50) -> DataFrame:
    """The first rows by ordinal with the text in a field; fields are trimmed, and nan and none count as empty."""
    hit = F.lit(False)
    for f in fields:
        c = F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))
        hit = hit | F.lower(F.when(F.lower(c).isin("nan", "none"), "").otherwise(c)).contains(text.strip().lower())
    return d.where(hit).orderBy("ordinal").limit(most)


def upsert(d: DataFrame, new: DataFrame, key: list[str] = KEY, overwrite: bool = False) -> DataFrame:
    """New keys are added; known keys are replaced if overwrite, else kept. Of equal new keys the first by ordinal counts."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))).where("_r = 1").drop("_r")
    if overwrite:
        return d.join(first.select(key), key, "left_anti").unionByName(first)
    return d.unionByName(first.join(d.select(key), key, "left_anti"))


def bulk_add(d: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows with error: null if added, else why not."""
    order = Window.partitionBy(*KEY).orderBy("ordinal")
    known = d.select(*KEY, F.lit(True).alias("_known")).distinct()
    types = d.select("work_type").distinct().withColumn("_type", F.lit(True))
    rows = new.withColumn("_r", F.row_number().over(order)).join(known, KEY, "left").join(types, "work_type", "left")
    error = F.when(F.trim(F.coalesce("dataset", F.lit(""))) == "", "empty name").when(F.col("_type").isNull(), "unknown work type").when(F.col("_known"), "exists already").when(F.col("_r") > 1, "repeated in the batch")
    return rows.withColumn("error", error).drop("_r", "_known", "_type")


def cascade_delete(d: DataFrame, level: str, names: DataFrame) -> DataFrame:
    """Without all that hangs from the named entries of a level."""
    return d.join(names.select(F.col(names.columns[0]).alias(level)).distinct(), level, "left_anti")


def validate(d: DataFrame, pools: list[str]) -> DataFrame:
    """Key columns with errors, warnings and is_valid."""
    name = F.coalesce("dataset", F.lit(""))
    errors = F.array_compact(F.array(F.when(F.trim(name) == "", "empty name"), F.when(F.length(name) > 128, "name too long"), F.when(F.col("work_type").isNull() | F.col("category").isNull(), "no parent")))
    warnings = F.array_compact(F.array(F.when(F.size(F.split(F.coalesce("category", F.lit("")), " - ")) < 2, "category form"), F.when(~F.coalesce(F.col("pool").isin(pools), F.lit(False)), "pool not standard")))
    return d.select(*KEY, errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("is_valid"))


def statistics(d: DataFrame) -> DataFrame:
    """level, name, n: totals by work type and by pool and of all, in one pass by grouping sets."""
    g = d.groupingSets([[F.col("work_type")], [F.col("pool")], []], F.col("work_type"), F.col("pool")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, "work_type").when(F.col("g") == 2, "pool").otherwise("all")
    return g.select(level.alias("level"), F.coalesce(F.when(F.col("g") == 1, F.col("work_type")).when(F.col("g") == 2, F.col("pool")), F.lit("")).alias("name"), "n")


def top_categories(d: DataFrame, n: int = 10) -> DataFrame:
    return d.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(n)


def distinct_attributes(templates: DataFrame) -> DataFrame:
    """n: distinct non-empty values over all templates (a map column ``fields``)."""
    return templates.select(F.explode(F.map_values("fields")).alias("x")).where("trim(x) <> ''").agg(F.countDistinct("x").alias("n"))


def find_templates(t: DataFrame, tags: list[str] = (), text: str = "") -> DataFrame:
    if tags:
        t = t.where(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])))
    return t.where(contains(F.concat_ws(" ", "template_id", "name_en", "description"), text)) if text else t


def import_new(d: DataFrame, incoming: DataFrame) -> DataFrame:
    """The dictionary with the rows of incoming whose keys it lacks; doing it twice changes nothing."""
    return upsert(d, incoming)


def backfill(d: DataFrame, lookup: DataFrame, key: list[str], column: str) -> DataFrame:
    """Fills nulls (not empty texts) of a column from a lookup with one row per key."""
    return d.join(lookup.select(*key, F.col(column).alias("_x")), key, "left").withColumn(column, F.coalesce(column, "_x")).drop("_x")


def collisions(d: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    return d.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *columns).limit(most)


def database_statistics(d: DataFrame) -> DataFrame:
    """work_type, pool (null for subtotals), tables, datasets."""
    return d.rollup("work_type", "pool").agg(F.count("*").alias("n_rows"), F.countDistinct("dataset").alias("n_datasets"))
