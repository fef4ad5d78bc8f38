"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table whose size is prime: slot
``(offset + j * skip) mod size`` is its j-th choice. Shards take turns and each claims its best
slot that is still free, so all get the same number of slots to within one, and a shard that
leaves hands over little more than its own slots. A key is hashed to a slot, and the table, which has
``size`` rows whatever the data, is broadcast: placement is one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import added, hashed

SHARDS = 32
SLOTS = 4099  # prime, over a hundred slots for each shard


def _number(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def fill(shards: list[str], size: int = SLOTS) -> list[int]:
    """For each slot the position in ``shards`` of its owner."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table's size must be prime, not {size}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be one or more different names, no more than slots")
    skips = [_number("skip", s) % (size - 1) + 1 for s in shards]
    nexts = [_number("offset", s) % size for s in shards]
    owner = [-1] * size
    claimed = 0
    while True:
        for i, skip in enumerate(skips):
            while owner[nexts[i]] >= 0:
                nexts[i] = (nexts[i] + skip) % size
            owner[nexts[i]] = i
            claimed += 1
            if claimed == size:
                return owner


def lookup(spark: SparkSession, shards: list[str], size: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table, ``size`` rows."""
    owned = json.dumps([shards[i] for i in fill(shards, size)])
    return spark.sql(
        "SELECT CAST(pos AS BIGINT) AS slot, col AS shard FROM (SELECT posexplode(from_json(:owned, 'array<string>')))",
        args={"owned": owned},
    )


def place(df: DataFrame, key: str, shards: list[str], size: int = SLOTS) -> DataFrame:
    """The rows with ``slot`` (bigint) and ``shard`` (string).

    The key is taken as text; a null key counts as the empty text. Equal keys share a shard. Input columns
    called slot or shard are replaced. An empty table gives an empty one.
    """
    slotted = df.select(F.struct("*").alias("row")).withColumn("slot", hashed(F.col(f"row.`{key}`")) % size)
    return added(df, ["slot", "shard"], slotted.join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot"))
