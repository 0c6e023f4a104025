"""Intermediate tables in the folder that driver and executors share, for plans that use a result several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_stored: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs on one machine, a folder of our own."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own = _own or tempfile.mkdtemp(prefix="tuyere-")
    return f"file://{_own}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: it is computed once, and lost executors cost nothing."""
    path = f"{folder(df.sparkSession)}/tuyere/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables stored so far, once their results are kept elsewhere; tells how many."""
    n = 0
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
