"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators.skew import with_group
from sedimark.session import materialize, release


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and in all likelihood for no others."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round replaces edges by as many at most: a node links its larger neighbours (large star), or its smaller
    ones (small star), to its smallest. A node with a large share of the edges isn't shuffled by. The rounds needed grow with the logarithm of a component's size. State is cut
    by a table in the shared folder each round. Loops and repeated edges don't matter; rows with a null end are
    ignored.
    """
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes_alone = known.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    e = materialize(known.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    mark = _fingerprint(e)
    if not mark[0]:
        return nodes_alone.select("node", F.col("node").alias("component"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = with_group(both, "u", F.least(F.min("v"), F.first("u")).alias("m"), 2 * mark[0])
        large = seen.where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now every edge is (larger, smaller)
        large = materialize(large, "edges")
        seen = with_group(large, "u", F.min("v").alias("m"), mark[0])
        small = seen.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v")
        new = materialize(small.distinct(), "edges")
        release(large)
        old, e, before, mark = e, new, mark, _fingerprint(new)
        release(old)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    alone = nodes_alone.join(out.select("node"), "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))
