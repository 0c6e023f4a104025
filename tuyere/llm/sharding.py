"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Every shard has its own order of preference over the slots of a table of prime size. The shards take turns; at its turn a
shard claims the first slot of its order that is still free, until all slots are taken. Slots so spread evenly (the numbers
of two shards differ by one at most), and when a shard is added or removed, few slots change hands. The finished table is
broadcast: its size is the prime, whatever the number of rows. A row's slot is the hash of its key modulo the prime, so
placement takes constant time and no shuffle.

Cases: a null key goes to the slot of the empty text; rows with equal keys go to one shard; an empty table gives an empty
result; columns of the input named slot or shard are replaced by the added ones, also where one of them is the key; all others
are kept whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by this library: the table's size, a prime well above a hundred times the number of shards in use.
TABLE_SIZE = 65_537
#: Hexadecimal digits of an MD5 digest that make a non-negative 60-bit number.
DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's place in the list for every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, one at least and no more than slots")
    order = sorted(range(len(shards)), key=lambda k: shards[k])
    begin = [_number(f"offset:{x}") % size for x in shards]
    step = [_number(f"skip:{x}") % (size - 1) + 1 for x in shards]
    table, taken, at = [-1] * size, 0, [0] * len(shards)
    while True:
        for k in order:
            slot = (begin[k] + at[k] * step[k]) % size
            while table[slot] >= 0:
                at[k] += 1
                slot = (begin[k] + at[k] * step[k]) % size
            table[slot] = k
            at[k] += 1
            taken += 1
            if taken == size:
                return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard: the table as rows, unfolded from one literal inside the plan."""
    table = ",".join(map(str, lookup_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, shards: list[str], *, key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """df with the columns slot and shard (the shard's name); columns of these names are replaced."""
    spark = df.sparkSession
    names = F.array(*[F.lit(x) for x in shards])
    table = F.broadcast(table_frame(spark, shards, size).select(F.col("slot").alias("at"), "shard"))  # size rows, whatever the input
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    rows = df.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), slot_of(F.col(f"`{key_col}`"), size).alias("slot"))
    placed = rows.join(table, F.col("slot") == F.col("at"))
    return placed.select(*(["row.*"] if kept else []), "slot", F.get(names, F.col("shard")).alias("shard"))


def write_shards(df: DataFrame, shards: list[str], path: str, *, key_col: str = "doc_id", files_per_shard: int = 8) -> None:
    """Writes the rows below path/shard=NAME/. A shard's rows go to several tasks, so no shard is one task's work."""
    placed = place(df, shards, key_col=key_col)
    part = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)
