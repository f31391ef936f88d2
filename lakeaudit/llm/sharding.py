"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size, from two hashes of its
name. Shards take turns; each claims the first slot of its permutation that is still free. So every
shard owns almost the same number of slots, and a shard that joins or leaves moves few of the
others' slots. A key's slot is its hash modulo the table size: placement costs one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime some hundred times the number of shards that we expect; the table never has more rows.
TABLE_SIZE = 65_537


def _hashes(name: str) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big")


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index of the shard that owns it. Shards take turns in the order of their names."""
    if not 0 < len(set(shards)) == len(shards) <= table_size:
        raise ValueError("shards need distinct names, one at least and at most one a slot")
    if table_size < 2 or any(table_size % k == 0 for k in range(2, int(table_size**0.5) + 1)):
        raise ValueError("the table size has to be a prime")
    order = sorted(range(len(shards)), key=lambda k: shards[k])
    start, skip = {}, {}
    for k in order:
        a, b = _hashes(shards[k])
        start[k], skip[k] = a % table_size, b % (table_size - 1) + 1
    owner = np.full(table_size, -1, np.int32)
    free = table_size
    while free:
        for k in order:
            at = start[k]
            while owner[at] >= 0:
                at = (at + skip[k]) % table_size
            owner[at] = k
            start[k] = (at + skip[k]) % table_size
            free -= 1
            if not free:
                break
    return owner


def place(df: DataFrame, shards: Sequence[str], key: str = "doc_id", table_size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (name).

    The table has ``table_size`` rows whatever the data, so it is broadcast: no shuffle, and no row
    waits for another. A null key hashes like any value, an empty one too, and equal keys share a slot. Input
    columns named slot or shard are replaced; an empty table stays empty.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, table_size)
    slots = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string")
    keyed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(table_size)).cast("int"))
    return keyed.join(F.broadcast(slots), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")
