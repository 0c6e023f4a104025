"""Helpers that the training-data operators share: the cluster's shared folder and written intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every operator here counts them: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_own_folder: str | None = None
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session. A local one is set only where that is unset and
    driver and executors are one machine."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="tuyere-")
        folder = "file://" + _own_folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/tuyere/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written as Parquet to the shared folder and read again: lineage ends there, and lost executors cost
    nothing. The table stays until clear() is called, as only the caller knows when its readers are done."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this driver has written, once their results are stored; tells how many."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that df has no column of."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def local_path(uri: str) -> str | None:
    """The path of a file:// or plain URI; None for other stores."""
    if uri.startswith("file:"):
        return re.sub(r"^file:/*", "/", uri)
    return uri if uri.startswith("/") else None


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI that executors can reach."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def remainder(id_col, modulus: int):
    """crc32 of the id written as text, modulo modulus, as a column."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus


def remainder_of(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def one_thread() -> None:
    """Spark's tasks already use all cores."""
    for name in ("RAYON_NUM_THREADS", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ[name] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def slices(batches, rows: int = 1000):
    """Arrow batches cut to at most so many rows; in the end, Arrow gives back what it holds for later, as workers live on."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def light_slices(batches, column: int, rows: int = 500, size: int = 2_000_000):
    """Arrow batches cut where a text column holds so many bytes, a row at least, and at so many rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        start, held = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if k > start and (held + n > size or k - start >= rows):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()
