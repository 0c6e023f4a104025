"""Reading and writing tables, documents and exports (S family, B-05, B-08, B-11), on Spark's catalog and file sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.functions.frames import numbered

DICTIONARY_SCHEMA = (
    "base_work_types array<struct<work_type_en:string,work_type_zh:string,no:int>>, categories array<struct<work_type_en:string,category_en:string,category_zh:string>>, "
    "pools array<struct<pool_en:string,pool_zh:string>>, datasets array<struct<work_type_en:string,category_en:string,pool_en:string,dataset_en:string,dataset_zh:string,dataset_zh_short:string>>, "
    "attribute_templates map<string,map<string,string>>, first_ordinal long"
)
#: Entries of each key that one document of a written dictionary holds.
ENTRIES = 50_000


def read_table(df: DataFrame, columns: list[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Projection, filter and limit, with text columns named like times parsed (null if that fails)."""
    df = df.where(where) if where else df
    df = df.select(*columns) if columns else df
    for name, kind in df.dtypes:
        if kind == "string" and ("time" in name.lower() or "date" in name.lower()):
            df = df.withColumn(name, F.try_to_timestamp(name))
    return df.limit(limit) if limit else df


def write_table(df: DataFrame, name: str, if_exists: str = "append") -> int:
    """append, replace or fail; returns the number of rows."""
    mode = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}[if_exists]
    df.write.mode(mode).saveAsTable(name)
    return df.count()


def list_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table)]


def list_tables(spark: SparkSession, part: str = "") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(pattern=f"*{part}*"))


def backup_table(spark: SparkSession, table: str, now: datetime | None = None) -> str:
    name = f"{table}_backup_{(now or datetime.now()):%Y%m%d_%H%M%S}"
    spark.table(table).write.saveAsTable(name)
    return name


def log_run(spark: SparkSession, table: str, log: str, status: str, rows: int, **details) -> None:
    import json

    row = [(table, status, rows, json.dumps(details, sort_keys=True, default=str))]
    spark.createDataFrame(row, "table_name string, status string, rows long, details string").withColumn("at", F.current_timestamp()).write.mode("append").saveAsTable(log)


def run_summary(log: DataFrame, tables: list[str]) -> DataFrame:
    return log.where(F.col("table_name").isin(tables)).orderBy(F.desc("at"))


def read_raw(df: DataFrame, ts: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The first rows in time order, long: series, t, v."""
    columns = columns or [c for c in df.columns if c != ts]
    rows = df.select(ts, *columns).orderBy(ts)
    return (rows.limit(limit) if limit else rows).unpivot([ts], columns, "series", "v")


def write_aligned(aligned: DataFrame, path: str, batch_id: str) -> None:
    rows = aligned.withColumn("is_interpolated", F.col("status").contains("INTERPOLATED")).withColumn("batch_id", F.lit(batch_id))
    rows.write.partitionBy("batch_id").mode("append").parquet(path)


def read_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: csv, json, parquet, orc."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"unknown file type {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).option("inferSchema", schema is None).csv(path) if kind == "csv" else reader.format(kind).load(path)


def read_sheet(spark: SparkSession, path: str, aliases: dict[str, list[str]], key: list[str]) -> DataFrame:
    """A CSV sheet whose headers go by several names, without rows that lack a key and without repeats."""
    raw = spark.read.option("header", True).csv(path)
    names = {h.strip().lower(): h for h in raw.columns}
    found = {target: next((names[a.lower()] for a in [target, *others] if a.lower() in names), None) for target, others in aliases.items()}
    rows = raw.select(*[(F.trim(F.col(f"`{h}`")) if h else F.lit(None).cast("string")).alias(t) for t, h in found.items()])
    for k in key:
        rows = rows.where(F.coalesce(F.col(k), F.lit("")) != "")
    return rows.dropDuplicates(key)


def read_dictionary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The levels with ordinal and the attributes of a document, or of all documents that write_dictionary cut it into."""
    doc = spark.read.schema(DICTIONARY_SCHEMA).option("multiLine", True).json(path)
    at = F.col("ordinal") + F.coalesce("first_ordinal", F.lit(0))
    out = {k: doc.select("first_ordinal", F.posexplode(k).alias("ordinal", "x")).select(at.alias("ordinal"), "x.*") for k in ("base_work_types", "categories", "pools", "datasets")}
    out["attributes"] = doc.select(F.explode("attribute_templates").alias("pool_en", "fields"))
    return out


def validate_dictionary(text: str) -> list[str]:
    """What is wrong with a document: keys that are missing or hold the wrong kind of value."""
    import json

    try:
        doc = json.loads(text)
    except ValueError as e:
        return [f"no JSON: {e}"]
    kinds = {"base_work_types": list, "categories": list, "pools": list, "datasets": list, "attribute_templates": dict}
    return [f"{k} is missing" if k not in doc else f"{k} is no {t.__name__}" for k, t in kinds.items() if not isinstance(doc.get(k), t)]


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.json(f"{path}/nodes")
    edges.write.json(f"{path}/edges")


def write_dictionary(levels: dict[str, DataFrame], attributes: DataFrame, path: str, most: int | None = None, entries: int = ENTRIES) -> None:
    """The dictionary as JSON documents of five keys, as read_dictionary reads them: levels has base_work_types, categories,
    pools and datasets (with ordinal), attributes (pool_en, fields). A document has at most so many entries of each level, in
    their order, and a file of its own; a small dictionary is one document. first_ordinal tells where its entries begin. With
    ``most``, a dictionary of more entries is refused."""
    n = sum(x.count() for x in levels.values()) if most is not None else 0
    if most is not None and n > most:
        raise ValueError(f"{n} entries are too many")
    docs = attributes.sparkSession.range(1).select(F.lit(0).cast("long").alias("part"))
    for key, rows in levels.items():
        fields = [c for c in rows.columns if c != "ordinal"]
        placed = numbered(rows.withColumn("_s", F.lit(0)), "_s", "ordinal", ["ordinal", *fields])
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", F.struct(*fields).alias("x")))), lambda e: e["x"])
        docs = docs.join(placed.groupBy(F.floor(F.col("_i") / entries).alias("part")).agg(listed.alias(key)), "part", "full")
    parts = -(-attributes.count() // entries) or 1
    templates = attributes.groupBy(F.pmod(F.xxhash64("pool_en"), F.lit(parts)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("pool_en", "fields"))).alias("attribute_templates"))
    docs = docs.join(templates, "part", "full")
    kinds = dict(docs.dtypes)
    whole = [F.coalesce(k, F.array().cast(kinds[k])).alias(k) for k in levels]
    whole += [F.coalesce("attribute_templates", F.create_map().cast(kinds["attribute_templates"])).alias("attribute_templates"), (F.col("part") * entries).alias("first_ordinal")]
    docs.select(*whole).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def save_scenario(rows: DataFrame, path: str, **about) -> None:
    """A scenario (id, timestep, value, is_anomaly): its rows as long CSV, its figures and what is known about it as JSON."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/series")
    figures = rows.agg(F.countDistinct("id").alias("series"), F.count("*").alias("points"), F.count_if("is_anomaly").alias("anomalies"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    figures.coalesce(1).write.mode("overwrite").json(f"{path}/statistics")
    rows.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(about.items())], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def results_json(ranked: DataFrame, query: str) -> DataFrame:
    """One row: the query and its ranked results (name, s, at most as many as were asked for) as JSON, scores to four digits."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "name", F.round("s", 4).alias("score"))))
    listed = F.transform(rows, lambda e, k: F.struct((k + 1).alias("rank"), e["name"].alias("name"), e["score"].alias("score")))
    return ranked.agg(F.to_json(F.struct(F.lit(query).alias("query"), F.count("*").alias("n"), listed.alias("results"))).alias("document"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("encoding", "UTF-8").csv(path)


def markdown(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.format_string("| %s | %.4f |", "name", "s").alias("line"))


def export_alignment(aligned: DataFrame) -> DataFrame:
    """timestamp, value, is_interpolated, where a value is missing counts as interpolated, as the export has it."""
    return aligned.select("series", F.timestamp_micros("t").alias("timestamp"), F.col("v").alias("value"), F.col("v").isNull().alias("is_interpolated"))


def alignment_log(aligned: DataFrame, table: str, batch_id: str, method: str) -> DataFrame:
    """A row for each aligned point: from which time it comes (its own where it is exact, else null), and whether it is
    interpolated."""
    exact = F.col("status") == "EXACT_MATCH"
    return aligned.select(F.lit(table).alias("table_name"), F.lit(batch_id).alias("batch_id"), "series", F.when(exact, F.col("t")).alias("source_t"), F.col("t").alias("aligned_t"), F.lit(method).alias("method"), F.col("status").contains("INTERPOLATED").alias("is_interpolated"))


def batch_summary(aligned: DataFrame, table: str, batch_id: str, n_source: int, **config) -> DataFrame:
    """One row: the batch's counts, and its settings as JSON."""
    import json

    counts = aligned.agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n_aligned"), F.count_if(F.col("status").contains("INTERPOLATED")).alias("n_interpolated"), F.count_if(F.col("v").isNull()).alias("n_missing"))
    return counts.select(F.lit(batch_id).alias("batch_id"), F.lit(table).alias("table_name"), "start_t", "end_t", F.lit(n_source).alias("n_source"), "n_aligned", "n_interpolated", "n_missing", F.lit(json.dumps(config, sort_keys=True, default=str)).alias("config"))


def append_rows(rows: DataFrame, table: str) -> None:
    """Logs grow by whole batches; a batch is one commit of the table's format."""
    rows.write.mode("append").saveAsTable(table)


SYSTEM_COLUMNS = [("id", "string"), ("created_at", "timestamp")]


def ddl_columns(columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The system's columns and the attributes; one that is named like a column before it gets _attr, and a number if that is
    taken too."""
    out, seen = list(SYSTEM_COLUMNS), {c for c, _ in SYSTEM_COLUMNS}
    for name, kind in columns:
        new, k = name, 1
        while new.lower() in seen:
            new, k = f"{name}_attr" if k == 1 else f"{name}_attr{k}", k + 1
        seen.add(new.lower())
        out.append((new, kind))
    return out


def ddl(table: str, columns: list[tuple[str, str]]) -> str:
    fields = ", ".join(f"`{c}` {t}" for c, t in ddl_columns(columns))
    return f"CREATE TABLE IF NOT EXISTS `{table}` ({fields}) USING parquet"


def health(spark: SparkSession) -> dict:
    return {"spark": spark.version, "tables": len(spark.catalog.listTables()), "ok": spark.range(1).count() == 1}


def table_info(spark: SparkSession, part: str = "") -> DataFrame:
    """table_name, place, column_name, kind, n_rows of all tables whose name holds the text."""
    rows = []
    for t in list_tables(spark, part):
        n = spark.table(t).count()
        rows += [(t, k, c.name, c.dataType, n) for k, c in enumerate(spark.catalog.listColumns(t))]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, kind string, n_rows long")


def clear_table(spark: SparkSession, table: str) -> int:
    """Deletes the rows and keeps the table; returns how many there were."""
    n, kept = spark.table(table).count(), spark.table(table).limit(0).schema
    spark.createDataFrame([], kept).write.mode("overwrite").saveAsTable(table)
    return n


def drop_tables(spark: SparkSession, part: str) -> list[str]:
    """Drops the tables whose name holds the text, which must not be empty; returns their names."""
    if not part:
        raise ValueError("name the tables to drop")
    names = list_tables(spark, part)
    for t in names:
        spark.sql(f"DROP TABLE `{t}`")
    return names
