"""Shard placement by a lookup table that shards fill by turns.

Every shard has a permutation of the slots of a prime-sized table, given by an
offset and a stride hashed from its name. The shards take turns; in a turn a
shard claims the next slot of its permutation that is still free (a shard of
weight w has w turns in a round). The full table is broadcast - its size is
the prime, whatever the data - and a row's shard is one lookup of its hashed
key. A shard added or removed moves few keys beyond its own share.

Rows that repeat a key share its shard, a null key has a slot of its own, long
keys are hashed whole, and an empty table stays empty. Columns ``slot`` and
``shard`` take the names given; columns that have these names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """Slot -> position of its shard in ``shards``. Names must be distinct, the size prime and at least 1 slot per turn."""
    turns = list(weights or [1] * len(shards))
    if not shards or len(set(shards)) != len(shards) or len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("shards must be distinct and have positive weights")
    if not _is_prime(size) or size < sum(turns):
        raise ValueError(f"{size} is no prime of at least {sum(turns)}")
    at = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "stride") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for k, n in enumerate(turns):
            for _ in range(n):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % size
                table[at[k]] = k
                free -= 1
                if not free:
                    return table


def slot_of(key: str | Column, size: int = TABLE_SIZE) -> Column:
    """From the first 52 bits of the key's MD5. A null key has a slot of its own, other than that of the empty text."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    digest = F.md5(F.coalesce(F.concat(F.lit("="), text), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the row's slot and shard; it isn't shuffled."""
    import pandas as pd

    table = fill_table(shards, size, weights)
    lookup = df.sparkSession.createDataFrame(pd.DataFrame({slot_col: pd.Series(range(size), dtype="int32"), shard_col: [shards[k] for k in table]}), f"`{slot_col}` int, `{shard_col}` string")
    kept = [f"`{c}`" for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    rows = df.select(*kept, slot_of(key, size).alias(slot_col))
    return rows.join(F.broadcast(lookup), slot_col, "left").select(*kept, slot_col, shard_col)


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, files_per_shard: int = 1, **options) -> None:
    """Write one folder per shard. Rows go to ``files_per_shard`` tasks per shard by slot, so a large shard isn't one task's work."""
    placed = place(df, key, shards, **options)
    slot, shard = placed.columns[-2:]
    placed.repartition(len(shards) * files_per_shard, shard, F.pmod(slot, F.lit(files_per_shard))).write.partitionBy(shard).parquet(path)
