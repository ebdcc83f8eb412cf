"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The table has at least this many slots, and a hundred for every shard.
LEAST_SLOTS = 65_537


def _prime(n: int) -> int:
    """The smallest prime that is at least ``n``."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@functools.lru_cache(maxsize=8)
def lookup(shards: tuple[str, ...], slots: int | None = None) -> np.ndarray:
    """Shard number of every slot. Shards take turns; each claims the next free slot in its own order.

    A shard's order is ``offset + k * skip`` modulo the prime size, both from a digest of its name, so
    adding or removing a shard moves few slots between the others. Every shard gets its share of slots
    but for one.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and differ")
    size = _prime(slots or max(LEAST_SLOTS, 100 * len(shards)))
    if size < len(shards):
        raise ValueError("fewer slots than shards")
    at, skip = [], []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(d[:8], "big") % size)
        skip.append(int.from_bytes(d[8:16], "big") % (size - 1) + 1)
    table, taken = np.full(size, -1, np.int32), 0
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            taken += 1
            if taken == size:
                return table


def place(docs: DataFrame, shards: int | tuple[str, ...] = 64, key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with slot and shard: the hash of ``key`` picks a slot of the table.

    Equal keys share a shard, so repeated rows do; null keys share one too. Columns of these names are replaced, all
    others stay; an empty table gives no rows. The broadcast table has a fixed size (``LEAST_SLOTS`` rows, or a hundred a shard), whatever the data; no row moves.
    """
    names = tuple(f"shard-{k:05d}" for k in range(shards)) if isinstance(shards, int) else tuple(shards)
    table = lookup(names)
    spark = docs.sparkSession
    slots = spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(table), dtype=np.int64), "shard": table.astype(np.int64)}), "slot long, shard long")
    keyed = docs.drop("slot", "shard")
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in keyed.columns]
    keyed = keyed.withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(len(table))))
    return keyed.join(F.broadcast(slots), "slot").select(*columns, "slot", "shard")
