"""What a task text names, replies in JSON, and stored task templates (F-01, F-02, A-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuyere.operators.dictionary import find_templates


def vocabulary(d: DataFrame) -> DataFrame:
    """level, name, alias: the work types and pools under their names, the categories under each part of their name."""
    own = [d.select(F.lit(c).alias("level"), F.col(c).alias("name"), F.col(c).alias("alias")) for c in ("work_type", "pool")]
    part = F.explode(F.split("category", " - | -|- |-"))
    rows = own[0].unionByName(own[1]).unionByName(d.select("category").distinct().select(F.lit("category").alias("level"), F.col("category").alias("name"), part.alias("alias")))
    return rows.where(F.trim("alias") != "").select("level", "name", F.lower(F.trim("alias")).alias("alias")).distinct()


def parse_query(words: DataFrame, query: str, terms: dict[str, str] | None = None, most_categories: int = 10) -> DataFrame:
    """level, name: entries with an alias inside the text (letters of any case), the first categories by name, the keywords
    of the terms inside the text, and the text itself as a keyword. A text without anything has only itself."""
    text = query.lower()
    hits = words.where((F.col("alias") != "") & F.lit(text).contains(F.lower("alias"))).select("level", "name").distinct()
    first = hits.where("level = 'category'").orderBy("name").limit(most_categories)
    keywords = list(dict.fromkeys([k for t, k in (terms or {}).items() if t.lower() in text] + [query]))
    spoken = words.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in keywords])).alias("name")).select(F.lit("keyword").alias("level"), "name")
    return hits.where("level <> 'category'").unionByName(first).unionByName(spoken)


def json_part(reply: Column) -> Column:
    """The JSON object of a reply: the whole of it, else a fenced block, else what lies between the outermost braces; null if
    none of these parses."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    span = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    whole = lambda c: F.when(F.trim(c).startswith("{") & F.trim(c).endswith("}") & F.json_object_keys(F.trim(c)).isNotNull(), F.trim(c))
    return F.coalesce(whole(reply), whole(fenced), whole(span))


def parse_replies(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with parsed: the reply's object read by the schema; null where there is none, and parse_query then does the work."""
    return df.withColumn("parsed", F.from_json(json_part(F.col(column)), schema))


def put_templates(t: DataFrame, new: DataFrame) -> DataFrame:
    """Templates (template_id, built_in, ...) with the new ones in place of own templates of equal id; built-in ones stay as
    they are. Of new ones with equal ids the first by name stays."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy("template_id").orderBy("name_en"))).where("_r = 1").drop("_r").withColumn("built_in", F.lit(False))
    first = first.join(t.where("built_in").select("template_id"), "template_id", "left_anti")
    return t.join(first.select("template_id"), "template_id", "left_anti").unionByName(first)


def delete_templates(t: DataFrame, ids: list[str]) -> DataFrame:
    return t.where(F.col("built_in") | ~F.col("template_id").isin(ids)) if ids else t


def get_template(t: DataFrame, template_id: str) -> DataFrame:
    return t.where(F.col("template_id") == template_id)


list_templates = find_templates
