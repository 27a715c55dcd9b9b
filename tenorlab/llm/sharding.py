"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (an offset and a step from its name); the shards
take turns, each claiming its next preferred slot that is still free, until the table is full. A row's key hashes to a slot
and the slot names the shard. The table has a fixed size, so broadcasting it is bounded whatever the data's size, and
when a shard joins or leaves only about its own share of the keys moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.llm._common import read

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def _number(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{purpose}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that claimed it. Same shards in the same order give the same table."""
    if not shards or len(set(shards)) != len(shards) or not is_prime(size) or len(shards) > size:
        raise ValueError("shards must be distinct and no more than the prime table size")
    at = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 15 hexadecimal digits of its MD5, a function that SQL engines share; a null key hashes as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (string).

    A null key has the empty text's slot; equal keys share a shard; an empty table stays empty; columns of ``df``
    already called slot or shard are replaced, and all others stay, whatever their names.
    """
    if key in ("slot", "shard"):
        raise ValueError("the key column cannot be called slot or shard")
    table = fill_table(shards, size)
    lookup = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(table)], "slot int, shard string")
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    rows = df.select(F.struct(*kept).alias("row"), slot_of(F.col(key), size).alias("slot"))
    return rows.join(F.broadcast(lookup), "slot").select("row.*", "slot", "shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard: doc_id, slot, shard."""
    return assign_shards(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", "slot", "shard")
