"""Placement through a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a prime-sized table; the shards take
turns (weights give more turns) and each claims its next free slot until the table is full.
Placing a row is then one hash and one look into the broadcast table.  Adding or removing a
shard moves little more than that shard's own share.

Bound of the broadcast: `slots` rows of two integers, a parameter independent of the data.

Defined results: null keys are placed like the text 'null'; rows with equal keys get equal
shards (a hot key is a property of placement by key, and nothing is gathered by shard); empty
tables give empty results; extra columns are kept, clashing names included, by `assign`.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.common import packed

SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup(names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """The shard index of every slot."""
    if not _is_prime(slots) or slots < len(names):
        raise ValueError("the table size must be a prime of at least the number of shards")
    if len(set(names)) != len(names) or not names:
        raise ValueError("shard names must be given and distinct")
    weights = weights or [1] * len(names)
    if len(weights) != len(names) or min(weights) < 1:
        raise ValueError("one positive whole weight per shard")
    digest = [hashlib.md5(name.encode()).digest() for name in names]
    offset = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    order = [((o + np.arange(slots, dtype=np.int64) * k) % slots).astype(np.int32) for o, k in zip(offset, skip, strict=True)]
    filled, at, left = [-1] * slots, [0] * len(names), slots
    while left:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, left)):
                mine, j = order[shard], at[shard]
                while filled[mine[j]] >= 0:
                    j += 1
                filled[mine[j]], at[shard], left = shard, j + 1, left - 1
    return np.array(filled, dtype=np.int32)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5, so any engine can place a row."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup_frame(spark: SparkSession, names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    filled = lookup(names, slots, weights)
    return spark.createDataFrame([(i, int(s), names[s]) for i, s in enumerate(filled)], "_slot int, shard int, shard_name string")


def place(docs: DataFrame, names: list[str], key_col: str = "doc_id", slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """(key, slot, shard, shard_name) for every row."""
    rows = docs.select(F.col(key_col), slot_of(F.col(key_col), slots).alias("_slot"))
    return rows.join(F.broadcast(lookup_frame(docs.sparkSession, names, slots, weights)), "_slot").select(
        key_col, F.col("_slot").alias("slot"), "shard", "shard_name"
    )


def assign(docs: DataFrame, names: list[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """(row struct of all columns, shard, shard_name): the form to write with partitionBy."""
    rows = packed(docs).withColumn("_slot", slot_of(F.col("_row")[key_col], slots))
    table = lookup_frame(docs.sparkSession, names, slots)
    return rows.join(F.broadcast(table), "_slot").select(F.col("_row").alias("row"), "shard", "shard_name")


def oracle(n: int = SHARDS, slots: int = SLOTS) -> str:
    """SQL with the filled table as one list literal."""
    table = ",".join(map(str, lookup(shard_names(n), slots)))
    return f"""
WITH t AS (SELECT string_split('{table}', ',') AS shards),
s AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {slots})::INTEGER AS slot
  FROM documents),
p AS (SELECT doc_id, slot, shards[slot + 1]::INTEGER AS shard FROM s, t)
SELECT doc_id, slot, shard, 'shard-' || lpad(shard::VARCHAR, 5, '0') AS shard_name FROM p
"""
