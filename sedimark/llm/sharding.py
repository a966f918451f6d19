"""Consistent sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, set by an offset and a skip. Shards take
turns; each claims the first slot of its order that is free. The filled table has a fixed size and is broadcast, so a
row is placed by one hash and one lookup. Only DataFrame functions touch the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the MD5 digest that make a hash: 60 bits, always a positive long.
_DIGITS = 15


def _hash(s: str) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:_DIGITS], 16)


def next_prime(n: int) -> int:
    """The smallest prime that is at least ``n``."""
    n = max(n, 2)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """For each slot, the index of the shard that claimed it."""
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if next_prime(size) != size or size < len(shards):
        raise ValueError("size must be a prime that is at least the number of shards")
    at = [_hash(f"offset:{s}") % size for s in shards]
    skip = [_hash(f"skip:{s}") % (size - 1) + 1 if size > 1 else 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            left -= 1
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """The table as rows (_slot, shard); its size is a parameter, not data."""
    owner = fill_table(shards, size)
    packed = F.split(F.lit(",".join(map(str, owner))), ",")
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    rows = spark.range(1).select(F.posexplode(packed).alias("_slot", "_i"))
    return rows.select("_slot", F.col("_i").cast("int").alias("shard_index")).withColumn("shard", F.element_at(names, F.col("shard_index") + 1))


def slot_of(key: Column, size: int) -> Column:
    """The table slot of a key; a null key hashes as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") % F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key_cols: Sequence[str], shards: Sequence[str], size: int | None = None) -> DataFrame:
    """``df`` with columns ``slot``, ``shard_index`` and ``shard`` (replacing columns of these names).

    ``size`` defaults to the smallest prime of at least 100 slots a shard, which keeps shares within one per cent.
    No row is shuffled. Several key columns are joined by an unprintable separator; a null is the empty string, so null keys, which
    all hash alike, land on one shard. Equal keys land together: give a fine-grained key, such as the document's id,
    where one coarse key may hold a large part of the rows. Empty table: empty result.
    """
    size = size or next_prime(100 * len(shards))
    base = df.drop("slot", "shard_index", "shard")
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key_cols]
    placed = base.withColumn("slot", slot_of(F.concat_ws("\x1f", *parts), size))
    return placed.join(F.broadcast(lookup_table(df.sparkSession, shards, size).withColumnRenamed("_slot", "slot")), "slot").select(*base.columns, "slot", "shard_index", "shard")


def write_shards(df: DataFrame, path: str, files_per_shard: int = 1, shard_col: str = "shard") -> None:
    """Write one folder per shard; ``files_per_shard`` spreads each shard over as many tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    df.withColumn("_salt", salt).repartition(shard_col, "_salt").drop("_salt").write.partitionBy(shard_col).parquet(path)
