"""A corpus pipeline: language ID, exact dedup, near-dedup by shingle similarity, mixing to target weights, piece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuyere.llm import exact_dedup, lang_id, mixing, near_copies, pieces, shared
from tuyere.llm.queries import tokenizer_file


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null and empty texts among them; the others carry the predicted language where they
    had none. If no document has both a text and a language, none can be predicted and all go. Repeated rows stay; columns
    named as the operator's own keep their values; an empty table stays empty."""
    from pyspark.sql import functions as F

    own = {c: shared.unused(docs, f"kept_{c}") for c in docs.columns if c.lower() in ("held_out", "lang_pred", "score")}
    found = lang_id.identify(docs.withColumnsRenamed(own)).where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of white space count as one space, null as empty), the document with the smallest id stays, null
    ids last. Of rows with equal ids and texts one stays; rows with equal ids and different texts are told apart. All columns
    stay as they are; an empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a shingle similarity of 0.8 or more, found by SimHash and MinHash bands, the document with the smallest id stays; of rows
    with that id, the text of the smallest hash. Null and empty texts are one group, as texts without words; texts of fewer
    than five words are one shingle. All columns stay as they are; an empty table stays empty."""
    return near_copies.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that the sources meet their target weights. A null source is a source of its
    own; documents without words are as often taken as the seeded order has them; ties go by id and size. All columns stay
    as they are; an empty table stays empty."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (null as empty), and digests of the ids and of the text they decode to; one row per row."""
    coded = pieces.encode_pieces(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), with_text=False)
    return coded.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("piece_encoding", encode),
]

#: Language ID, fingerprints and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.written(docs, f"stage-{name}")
    return docs
