"""Shards of keys by a lookup table that the shards fill in turns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Slots of the table unless another prime is given; at least a hundred per shard keep the shares even.
SLOTS = 65_537
#: Largest table that is sent to the tasks.
MAX_SLOTS = 5_000_011


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The number of a shard for each slot.

    Each shard prefers the slots in an order of its own, `offset + i * skip`
    modulo the prime number of slots, which visits every slot once. The shards
    take turns, each claiming the first slot on its list that is still free,
    until none is. Offset and skip come from a digest of the shard's name, so
    the table depends on the set of names alone: when a shard goes, few slots
    of the others change hands. Shares differ by one slot.
    """
    names = sorted(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need names of their own")
    if not _is_prime(slots) or slots < len(names) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    number = {name: i for i, name in enumerate(shards)}
    digests = [hashlib.sha256(name.encode()).digest() for name in names]
    at = [int.from_bytes(d[:8], "little") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "little") % max(1, slots - 1) + 1 for d in digests]
    owner, left = [-1] * slots, slots
    while left:
        for i, name in enumerate(names):
            if not left:
                break
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % slots
            owner[slot], at[i] = number[name], (slot + skip[i]) % slots
            left -= 1
    return np.array(owner, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by the hash of its text; null is a key of its own, apart from the empty text."""
    text = key.cast("string")
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), F.lit(slots)).cast("int")


def place(df: DataFrame, key_col: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """All rows and columns of `df` with `slot` and `shard`, without a shuffle.

    The table has one row per slot, at most MAX_SLOTS, and is sent to all
    tasks; each row finds its shard by one hash lookup. Equal keys share a
    shard, also a null key. Columns of `df` named `slot` or `shard` are
    replaced. An empty table stays empty.
    """
    owners = lookup_table(shards, slots)
    names = list(shards)
    table = df.sparkSession.createDataFrame([(s, names[o]) for s, o in enumerate(owners.tolist())], "slot int, shard string")
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key_col), slots))
    return rows.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write placed rows as one folder per shard.

    Rows are spread over `files_per_shard` files of their shard by a seeded
    hash of all their columns and their place in the input, so a key that a
    third of all rows share does not end up in one task.
    """
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files_per_shard))
    spread = placed.withColumn("_salt", salt)
    spread.repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
