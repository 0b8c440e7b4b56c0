"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a prime-sized table, and the shards take
turns claiming their next free slot. A key goes to the shard that holds its slot: one hash and one
lookup in a broadcast table of fixed size, whatever the number of keys. Taking a shard away moves
its own keys and few others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleflow.llm.common import fresh

#: A table is broadcast, so its size is bounded.
LARGEST_TABLE = 1_000_003
TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = TABLE_SIZE, turns: dict[str, int] | None = None) -> list[int]:
    """The slots of the table, each with the position of its shard in ``shards``.

    ``size``: a prime of at most ``LARGEST_TABLE``, and no less than the shards. ``turns``: slots that a shard
    claims in each round, 1 unless given. Names must differ, as a name decides the order of preference.
    """
    if not _is_prime(size) or size > LARGEST_TABLE:
        raise ValueError(f"the table size must be a prime up to {LARGEST_TABLE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be named, differ, and be no more than the slots")
    if any(n < 1 for n in (turns or {}).values()):
        raise ValueError("a shard claims at least one slot in its turn")
    table = [-1] * size
    at = [_number(f"offset:{name}") % size for name in shards]
    skip = [_number(f"skip:{name}") % (size - 1) + 1 for name in shards]
    free = size
    while free:
        for k, name in enumerate(shards):
            for _ in range(min(free, (turns or {}).get(name, 1))):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % size
                table[at[k]] = k
                free -= 1
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key, from its text's MD5; a null key counts as an empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % size


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """The lookup table as ``slot``, ``shard``."""
    packed = spark.range(1).select(F.from_json(F.lit(str(table)), "array<int>").alias("t"))
    return packed.select(F.posexplode("t").alias("slot", "shard")).select(F.col("slot").cast("bigint"), "shard")


def place(df: DataFrame, key_col: str, table: list[int], slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` with the slot and shard of their key.

    Equal keys meet in one shard, and a null key has a fixed one. Columns of ``df`` that bear one of the two
    new names are replaced. Repeated rows stay, and an empty table gives an empty one.
    """
    keep = [c for c in df.columns if c.lower() not in (slot_name.lower(), shard_name.lower())]
    at, slot, shard = fresh(df, "at", "of_slot", "of_shard")
    lookup = table_frame(df.sparkSession, table).toDF(slot, shard)
    rows = df.select(slot_of(F.col(f"`{key_col}`"), len(table)).alias(at), *(F.col(f"`{c}`") for c in keep))
    placed = rows.join(F.broadcast(lookup), F.col(at) == F.col(slot))
    return placed.select(*(F.col(f"`{c}`") for c in keep), F.col(at).alias(slot_name), F.col(shard).alias(shard_name))


def write_shards(df: DataFrame, key_col: str, table: list[int], path: str) -> tuple[str, str]:
    """Write all rows and columns of ``df`` in one folder per shard; returns the names of the slot column and of the shard column,
    which names the folders.

    These are ``slot`` and ``shard``, or longer where ``df`` has such a column, which it keeps. Shards are balanced by the
    hash; one that a hot key fills is split over several files of its folder. A null key has a fixed shard, repeated rows
    stay, and an empty table gives an empty folder.
    """
    slot, shard = fresh(df, "slot", "shard")
    placed = place(df, key_col, table, slot, shard)
    placed.hint("rebalance", shard).write.partitionBy(shard).parquet(path)
    return slot, shard


def read_shards(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """What ``write_shards`` wrote of ``df``, with its slot and shard; a filter on the shard opens its folder only."""
    slot, shard = fresh(df, "slot", "shard")
    columns = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    schema = T.StructType([*columns, T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
