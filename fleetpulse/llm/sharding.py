"""Sharding by a permutation-filled lookup table: shards claim slots in turn, each in its own order of preference.

The table has a prime number of slots, whatever the number of rows, so it is broadcast; a row's shard is one lookup. When a
shard goes or comes, few rows besides its own change their place.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64
MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """Which shard (its index) owns each slot. A shard with weight w claims w slots in each round (1 by default)."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be given, each once")
    if not _is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    orders = [(crc32(b"at:" + s.encode()) % slots, crc32(b"by:" + s.encode()) % (slots - 1) + 1) for s in shards]
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 0 or max(turns) < 1:
        raise ValueError("weights must not be negative, and one at least positive")
    owner, tried, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for i, (at, by) in enumerate(orders):
            for _ in range(min(turns[i], free)):
                slot = (at + by * tried[i]) % slots
                while owner[slot] >= 0:
                    tried[i] += 1
                    slot = (at + by * tried[i]) % slots
                owner[slot] = i
                free -= 1
    return owner


def place(
    df: DataFrame,
    key: Column,
    shards: list[str],
    slots: int = SLOTS,
    weights: dict[str, int] | None = None,
    slot_name: str = "slot",
    shard_name: str = "shard",
) -> DataFrame:
    """Adds the slot and the shard of `key` to every row of `df`; columns of those names are replaced.

    Equal keys, null among them, share a slot. A key that many rows share goes to one shard by definition: give a key that
    tells rows apart where shards must be even. Empty tables stay empty.
    """
    owner = lookup_table(shards, slots, weights)
    df = df.drop(slot_name, shard_name)
    places = df.sparkSession.createDataFrame([(i, shards[o]) for i, o in enumerate(owner)], "i long, shard string").toDF(slot_name, shard_name)
    # `slots` rows, at most MAX_SLOTS.
    placed = df.withColumn(slot_name, F.pmod(F.xxhash64(key), F.lit(slots))).join(F.broadcast(places), slot_name)
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), slot_name, shard_name)
