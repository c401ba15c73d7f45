"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: from an offset,
in steps of a skip, both hashed from its name. The shards take turns, and each claims its first
slot that is still free, until the table is full. A key is hashed to a slot, so its shard is one
look-up. Shards get slots as evenly as can be, and a change of the shard list moves few keys.

The table has ``size`` rows, a parameter that doesn't depend on the data: it is filled on the
driver and broadcast. At the largest size allowed it takes a few MB.

Defined results: a null key is hashed as a missing value and always has the same shard; an empty
text is another key. Equal keys share a shard. An empty table gives an empty table. Input columns
pass through; ``slot`` and ``shard`` replace columns of the same name, the key among them. A heavy
key has one shard by definition; to spread one, key by a column that also holds a salt.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestream.llm.common import col, without

TABLE_SIZE = 65_537
MOST_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """A shard's offset and skip."""
    return _number(f"offset:{shard}") % size, _number(f"skip:{shard}") % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[str]:
    """The shard of every slot."""
    if not is_prime(size) or size > MOST_SLOTS or size < len(shards):
        raise ValueError(f"the table's size must be a prime from the number of shards to {MOST_SLOTS}, not {size}")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given, and differ")
    at, step = map(list, zip(*(preference(s, size) for s in shards)))
    slots: list[str | None] = [None] * size
    free = size
    while free:
        for i, shard in enumerate(shards):
            while slots[at[i]] is not None:
                at[i] = (at[i] + step[i]) % size
            slots[at[i]] = shard
            free -= 1
            if not free:
                break
    return slots


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard), as SQL rows made of one array literal."""
    index = {s: i for i, s in enumerate(shards)}
    owners = ",".join(str(index[s]) for s in fill_table(shards, size))
    named = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    names = F.array(*map(F.lit, shards))
    return named.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table's size."""
    digest = F.md5(F.encode(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("")), "UTF-8"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def assign_shards(rows: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with the slot and the shard of their key: no shuffle, one broadcast look-up."""
    rows = rows.select(*(col(c) for c in without(rows, "slot", "shard").columns), slot_of(col(key), size).alias("slot"))
    return rows.join(F.broadcast(lookup_table(rows.sparkSession, shards, size)), "slot", "inner")
