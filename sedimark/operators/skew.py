"""Joins that keep keys with a large share of the rows out of the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than a SHARE-th of all rows, so that SHARE keys can be hot at most; and LEAST rows aren't worth it.
SHARE, LEAST = 1000, 200


def hot_limit(total: int) -> int:
    return max(LEAST, total // SHARE)


def lookup(rows: DataFrame, facts: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each key, and in ``n`` the number of the key's rows.

    Facts of hot keys are broadcast, SHARE rows at most whatever the data; all others meet by shuffle. ``total`` is the
    number of rows. ``facts`` should be a written table, as it is read several times. Null keys meet nothing.
    """
    hot = facts.where(F.col(n) > hot_limit(total))
    if hot.isEmpty():
        return rows.join(facts, on, how)
    cold = facts.where(F.col(n) <= hot_limit(total))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def with_group(rows: DataFrame, key: str, agg: Column, total: int) -> DataFrame:
    """``rows`` beside an aggregate of their key's rows. Rows of hot keys aren't moved: their aggregates are broadcast."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_limit(total))
    hot = [r[0] for r in counts.select(key).collect()]  # SHARE keys at most
    facts = rows.groupBy(key).agg(agg)
    if not hot:
        return rows.join(facts, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(rows.where(is_hot).groupBy(key).agg(agg)), key).unionByName(rows.where(~is_hot).join(rows.where(~is_hot).groupBy(key).agg(agg), key))
