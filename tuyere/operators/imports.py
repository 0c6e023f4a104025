"""Template imports, alignment settings of tables, and physical tables of a dictionary (S-11, S-15 to S-17, B-08, B-09, H-07)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuyere.functions.frames import numbered
from tuyere.functions.storage import stored
from tuyere.operators.dictionary import KEY, upsert
from tuyere.operators.registry import add
from tuyere.sources.catalog import read_sheet

SETTINGS = ["time_alignment_strategy", "default_timezone", "timestamp_format", "sampling_interval_seconds", "allow_interpolation", "interpolation_method"]
DEFAULTS = {"default_timezone": "UTC", "timestamp_format": "ISO8601"}


def _plain(c: Column) -> Column:
    """A pool's name as templates may write it: spaces and hyphens as underscores."""
    return F.translate(c, " -", "__")


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def template_import(d: DataFrame, work_types: DataFrame, pools: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, types, counts) of a four-column sheet (work_type, category, pool, dataset, ordinal).

    rows: the sheet with status: added, or skipped for a blank field, a pool that is not among pools (pool), or a dataset that
    the dictionary d or an earlier row has. types: the work types that work_types (work_type, no) lacks, numbered on from its
    largest number in the order of the sheet. counts: one row of work_types_added, categories_added, datasets_added and
    rows_skipped. Names of pools may have underscores for spaces and hyphens; null fields count as blank."""
    known = pools.select(F.col("pool").alias("_known"), _plain(F.col("pool")).alias("_plain")).groupBy("_plain").agg(F.min("_known").alias("_known"))
    rows = sheet.select("ordinal", *[_text(c).alias(c) for c in KEY]).withColumn("_plain", _plain(F.col("pool"))).join(known, "_plain", "left")
    blank = (F.col("work_type") == "") | (F.col("category") == "") | (F.col("pool") == "") | (F.col("dataset") == "")
    rows = rows.withColumn("_bad", F.when(blank, "blank").when(F.col("_known").isNull(), "unknown pool")).withColumn("pool", F.coalesce("_known", "pool")).drop("_plain", "_known")
    there = d.select(*KEY).distinct().withColumn("_there", F.lit(True))
    rows = rows.join(there, KEY, "left")
    order = Window.partitionBy(*KEY, F.col("_bad").isNull()).orderBy("ordinal")
    status = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("skipped: "), "_bad")).when(F.col("_there") | (F.row_number().over(order) > 1), "skipped: known").otherwise("added")
    rows = rows.withColumn("status", status)
    valid = rows.where("_bad is null")
    new_types = valid.groupBy("work_type").agg(F.min("ordinal").alias("first")).join(work_types.select("work_type"), "work_type", "left_anti")
    last = work_types.agg(F.coalesce(F.max("no"), F.lit(0)).alias("last"))
    placed = numbered(new_types.withColumn("first", F.col("first").cast("long")).withColumn("one", F.lit(1)), "one", "first", ["first", "work_type"])
    types = placed.crossJoin(F.broadcast(last)).select("work_type", (F.col("last") + F.col("_i") + 1).alias("no"))
    new_categories = valid.select("work_type", "category").distinct().join(d.select("work_type", "category").distinct(), ["work_type", "category"], "left_anti")
    counted = rows.agg(F.count_if(F.col("status") == "added").alias("datasets_added"), F.count_if(F.col("status") != "added").alias("rows_skipped"))
    counts = new_types.agg(F.count("*").alias("work_types_added")).crossJoin(new_categories.agg(F.count("*").alias("categories_added"))).crossJoin(counted)  # one row each
    return rows.drop("_bad", "_there"), types, counts


def fixed_pool_sheet(sheet: DataFrame, pool: str, id_col: str) -> DataFrame:
    """A sheet of texts or images as one of four columns: all of one pool, datasets without a name under their id."""
    return sheet.select("ordinal", "work_type", "category", F.lit(pool).alias("pool"), F.coalesce(F.when(_text("dataset") != "", _text("dataset")), _text(id_col)).alias("dataset"))


def alignment_settings(attributes: DataFrame, datasets: DataFrame, table_name: str) -> DataFrame:
    """The settings of a table's datasets, defaults in place of nulls and empty texts; both tables have dataset_id, datasets
    have table_name."""
    found = attributes.join(datasets.where(F.col("table_name") == table_name).select("dataset_id").distinct(), "dataset_id")
    filled = {c: F.when(F.coalesce(F.col(c), F.lit("")) == "", v).otherwise(F.col(c)) for c, v in DEFAULTS.items()}
    return found.select("dataset_id", *[filled.get(c, F.col(c)).alias(c) for c in SETTINGS])


def update_alignment_settings(attributes: DataFrame, datasets: DataFrame, table_name: str, settings: dict) -> DataFrame:
    """attributes with all settings of the table's datasets replaced; settings that are not given become null or the default."""
    hit = datasets.where(F.col("table_name") == table_name).select("dataset_id").distinct().withColumn("_hit", F.lit(True))
    kinds = dict(attributes.dtypes)
    rows = attributes.join(hit, "dataset_id", "left")
    new = {c: F.lit(settings.get(c, DEFAULTS.get(c))).cast(kinds[c]) for c in SETTINGS}
    return rows.select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in attributes.columns])


def build_pending(tables: DataFrame, d: DataFrame, path: str) -> DataFrame:
    """Writes the rows of d whose pool is pending in tables (pool, status) below path, a folder per pool in place of what it
    holds; returns tables with these as created, or as failed where d has no row of the pool."""
    spark = d.sparkSession
    pending = tables.where("status = 'pending'").select("pool").distinct()
    rows = d.join(F.broadcast(pending) if pending.count() < 10_000 else pending, "pool")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pool").parquet(path)
    made = spark.read.parquet(path).select("pool").distinct().withColumn("_made", F.lit(True)) if not rows.isEmpty() else pending.limit(0).withColumn("_made", F.lit(True))
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("_made"), "created").otherwise("failed")
    return stored(tables.join(made, "pool", "left").withColumn("status", status).drop("_made"), "table-status")  # the folder changes later


def incremental_import(d: DataFrame, incoming: DataFrame, tables: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, tables) after new rows are added and the tables of the pools they belong to are built again."""
    new = upsert(d, incoming)
    changed = incoming.join(d.select(*KEY), KEY, "left_anti").select("pool").distinct()
    marked = tables.join(changed, "pool", "left_anti").unionByName(changed.withColumn("status", F.lit("pending")))
    return new, build_pending(marked, new, path)


def register_model(models: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """models (model_id, name, created, tags) with the new ones; known ids stay as they are unless overwrite is set."""
    if overwrite:
        return models.join(new.select("model_id"), "model_id", "left_anti").unionByName(new)
    return models.unionByName(new.join(models.select("model_id"), "model_id", "left_anti"))


def unregister_models(models: DataFrame, ids: list[str]) -> DataFrame:
    return models.where(~F.col("model_id").isin(ids)) if ids else models


def sheets_of(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder, by path; none if there is no such folder."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()  # names only
    except AnalysisException:
        return []
    return sorted(r.path for r in found)


def import_folder(spark: SparkSession, folder: str, levels: dict[str, tuple[dict[str, list[str]], list[str]]], known: dict[str, DataFrame] | None = None, overwrite: bool = False, fallback: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(a table for each level, counts by level) from the sheets of a folder whose file name holds the level's name.

    levels: the names a level's columns go by, and its key. With known tables the sheets are merged into them: keys they have
    stay, or are replaced if overwrite is set; without them the sheets are the tables. Of several sheets of a level, those that
    come later by path add to the earlier ones by the same rule. A level without a sheet keeps its known table, else that of
    fallback (an earlier dictionary), else none. counts: level, source (sheets, known or fallback), n_read, n_rows."""
    paths, out, counts = sheets_of(spark, folder), {}, []
    for level, (aliases, key) in levels.items():
        table = (known or {}).get(level)
        own = [p for p in paths if level.lower() in p.rsplit("/", 1)[-1].lower()]
        read = 0
        for path in own:
            sheet = read_sheet(spark, path, aliases, key)
            read += sheet.count()
            table = sheet if table is None else add(table, sheet.select(*[F.col(c).cast(t).alias(c) if c in sheet.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes]), key, overwrite)[0]
        source = "sheets" if own else "known" if table is not None else "fallback"
        if table is None:
            table = (fallback or {}).get(level)
        if table is not None:
            out[level] = table = stored(table, "import")
            counts.append((level, source, read, table.count()))
    return out, spark.createDataFrame(counts, "level string, source string, n_read long, n_rows long")
