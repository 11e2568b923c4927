"""Sharding by a permutation-filled lookup table, in DataFrame functions.

Each shard has a preference order over the slots of a table of prime size (an offset and a step, from its name); the shards
take turns claiming their next free slot until the table is full.  Shards get nearly equal shares, and few slots change
hands when a shard comes or goes.  The table has a fixed number of slots, so it is broadcast, and placing a row is one
look-up by the hash of its key.

Defined cases: a null key is placed like a key of its own; equal keys go to one shard; an empty table places nothing; the
row's columns pass through, whatever their names (``place`` puts its own into one struct).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, over a hundred slots for each of the shards: shares differ by one percent at most.
SLOTS, SHARDS, MOST_SLOTS = 2053, 16, 1 << 20


def number(x: str) -> int:
    return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)


def lookup_table(shards: int = SHARDS, slots: int = SLOTS, prefix: str = "shard") -> list[int]:
    """The shard of every slot."""
    if not 1 <= shards <= slots <= MOST_SLOTS:
        raise ValueError(f"1 <= shards <= slots <= {MOST_SLOTS}")
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("the number of slots must be prime")
    at = [number(f"{prefix}{s}:offset") % slots for s in range(shards)]
    step = [number(f"{prefix}{s}:skip") % (slots - 1) + 1 for s in range(shards)]
    table = [-1] * slots
    for turn in range(slots):
        s = turn % shards
        while table[at[s]] >= 0:
            at[s] = (at[s] + step[s]) % slots
        table[at[s]] = s
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: sixty bits of the MD5 of its text."""
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("long")


def table_frame(spark: SparkSession, shards: int, slots: int) -> DataFrame:
    table = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))


def place(rows: DataFrame, key: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Columns row (all of ``rows``), slot, shard."""
    table = F.broadcast(table_frame(rows.sparkSession, shards, slots))  # ``slots`` rows, at most MOST_SLOTS
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return keyed.join(table, "slot")


def write_shards(rows: DataFrame, key: str, path: str, shards: int = SHARDS, slots: int = SLOTS, splits: int = 8) -> None:
    """Parquet files by shard; each shard is written by ``splits`` tasks, so a shard with a hot key is not one task's work."""
    placed = place(rows, key, shards, slots)
    placed = placed.withColumn("split", F.pmod(F.xxhash64("row"), F.lit(splits)))
    placed.repartition(shards * splits, "shard", "split").select("shard", "row.*").write.partitionBy("shard").parquet(path)
