"""Feature keys, SimHash and Hamming distance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.session import materialize


def feature_key(s: Column) -> Column:
    """The MD5 of a feature as hexadecimal digits: 128 bits without loss."""
    return F.md5(s)


def first64(s: Column) -> Column:
    """The first 64 bits of the MD5 as a signed long."""
    return F.conv(F.substring(F.md5(s), 1, 16), 16, -10).cast("long")


def last64(s: Column) -> Column:
    """The last 64 bits of the MD5 as a signed long."""
    return F.conv(F.substring(F.md5(s), 17, 16), 16, -10).cast("long")


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """A 64-bit SimHash of each group's distinct keys: bit i is set if more keys have it than not.

    Keys are distinct within a group by a first aggregate. Bits i and i + 32 are counted in the halves of one long, so
    32 partial sums do, and no group is gathered; a group may have 2**31 keys.
    """
    base = rows.where(F.col(key).isNotNull()).select(*by, key).distinct().select(*by, last64(F.col(key)).alias("_h"))
    lanes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(0x100000001))).alias(f"_s{i}") for i in range(32)]
    total = base.groupBy(*by).agg(F.count("*").alias("_n"), *lanes)
    word = F.lit(0).cast("long")
    for i in range(32):
        for count, at in ((F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i), (F.shiftrightunsigned(f"_s{i}", 32), i + 32)):
            word = word.bitwiseOR(F.when(count * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return total.select(*by, word.alias("simhash"))


def block_keys(value: Column, most: int = 5, blocks: int = 8) -> list[Column]:
    """Bits of a value by choices of ``blocks - most`` of its blocks: values within ``most`` bits have one of these keys in common, at the same place.

    With eight blocks and five bits a key has 24 bits, and there are 56 of them.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(masks, blocks - most)]
    return [value.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in chosen]


def near_values(values: DataFrame, most: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, y, distance) of all pairs x < y of distinct values ``v`` of a group that differ in ``most`` bits at most."""
    keys = block_keys(F.col("v"), most)
    cut = values.select(*by, F.col("v").alias("x"), F.posexplode(F.array(*keys)).alias("i", "k"))
    x = F.col("x").bitwiseXOR(F.col("y"))
    met = cut.join(cut.withColumnRenamed("x", "y"), [*by, "i", "k"]).where((F.col("x") < F.col("y")) & (F.bit_count(x) <= most))
    return met.select(*by, "x", "y").distinct().select(*by, "x", "y", hamming(F.col("x"), F.col("y")).cast("int").alias("distance"))


def hamming_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, value: str = "simhash", most: int = 5) -> DataFrame:
    """(a, b, distance) of all pairs within ``most`` bits. Values are compared once each, and their ids joined to those that are near."""
    a, b = (df.select(F.col(i).alias(n), F.col(value).alias(v)) for df, i, n, v in ((left, left_id, "a", "x"), (right, right_id, "b", "y")))
    values = materialize(a.select(F.col("x").alias("v")).union(b.select("y")).where("v IS NOT NULL").distinct(), "values")
    near = near_values(values, most)
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"), "distance")).unionByName(values.select(F.col("v").alias("x"), F.col("v").alias("y"), F.lit(0).alias("distance")))
    return a.join(both, "x").join(b, "y").select("a", "b", "distance")
