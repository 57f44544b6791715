"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (an offset and a stride taken from its
name).  The shards take turns; on its turn a shard claims the first slot of its order that is still free.  So
each shard owns an equal share of slots within one, and adding or removing a shard moves few of them.  A row's
slot is a hash of its key modulo the prime, and one look into the broadcast table gives its shard.  The table
has ``slots`` rows whatever the data, which bounds the broadcast.

Defined cases: a null key counts as the empty string; equal keys share a shard; an empty table gives an empty
result; columns called ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm._shared import md5_number

SLOTS = 4099
SHARDS = tuple(f"shard-{n:02d}" for n in range(32))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The owner of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime of at least the number of shards")
    at = [_number(f"{s}/offset") % slots for s in shards]
    stride = [_number(f"{s}/stride") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner: list[str | None] = [None] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while owner[at[k]] is not None:
            at[k] = (at[k] + stride[k]) % slots
        owner[at[k]] = shards[k]
    return owner  # type: ignore[return-value]


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The lookup table as (slot, shard)."""
    names = F.array(*[F.lit(s) for s in shards])
    number = {s: k for k, s in enumerate(shards)}
    line = ",".join(str(number[s]) for s in lookup_table(shards, slots))
    exploded = spark.range(1).select(F.posexplode(F.split(F.lit(line), ",")).alias("slot", "k"))
    return exploded.select("slot", F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return (md5_number(F.coalesce(key.cast("string"), F.lit(""))) % slots).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with the ``slot`` and ``shard`` of each row; no shuffle."""
    keyed = df.withColumn("slot", slot_of(F.col(key), slots))
    kept = [c for c in keyed.columns if c.lower() != "shard"]
    table = table_frame(df.sparkSession, shards, slots)
    return keyed.select(*[F.col(f"`{c}`") for c in kept]).join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in kept], "shard")


def write_sharded(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """One folder for each shard; a shard's rows are dealt over its slots first, so that no task gets a whole shard."""
    placed = place(df, key, shards, slots)
    placed.repartition("slot").write.partitionBy("shard").parquet(path)
