"""Bottom-up matching of artifacts against the index with normalised inverse document frequency.

``edges``: child_type, child_id, parent_type, parent_id, uniq (distinct searched features below an inner child; 1 for
a leaf). ``nodes``: node_type, node_id, filetype, licensed. Roots are parents of type branch or repo. An index is built
of them once, and searched often.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimark.operators.index import ROOT_TYPES, reference_counts, type_counts
from sedimark.operators.skew import lookup
from sedimark.session import bucketed, materialize, shares

LEAF_TYPES = ("str", "var", "func", "funcname", "class", "normclass", "centroid")
#: Edges in one bucket of an index; rows of a query that are broadcast.
EDGES, FEW = 1 << 20, 50_000
COUNTED = ("str", "var", "func", "funcname")


@dataclass(frozen=True)
class Params:
    """Thresholds; the defaults are those for native libraries."""

    popular: int = 2000
    min_percent: float = 10.0
    low_score: float = 0.2
    accept_score: float = 0.4
    min_features: int = 50
    min_functions: int = 2
    refcnt_ratio: float = 2.0
    min_grouped: float = 0.1
    grouped_types: tuple[str, ...] = ("dir", "file", "dirs")
    rules: tuple[int, ...] = (1, 2, 3, 4)
    max_levels: int = 1000
    propagate: bool = True
    leaf_types: tuple[str, ...] = field(default=LEAF_TYPES)


def idf(total: Column, matching: Column) -> Column:
    """ln(total / (1 + matching)); null where it has no value."""
    x = F.try_divide(total.cast("double"), F.lit(1.0) + matching)
    return F.when(x > 0, F.ln(x))


def child_idf(total: Column, refcnt: Column) -> Column:
    """A child's idf over that of a child with one parent; null where it has no value, and then the child counts nowhere."""
    return F.when(refcnt > 0, F.try_divide(idf(total, refcnt), idf(total, F.lit(1))))


@dataclass(frozen=True)
class Index:
    """Written tables: all that a search reads."""

    weighted: DataFrame  # inner edges with refcnt and idf, in buckets by parent_id
    leaf_totals: DataFrame  # by parent and type of leaf: children, and the sum of their idf
    kids: DataFrame  # weighted edges of parents above files, with the child's attributes
    refs: DataFrame  # refcnt of nodes that aren't leaves
    roots: DataFrame  # node_type, node_id, root_type, root


def weighted_edges(edges: DataFrame, refs: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Inner edges with the child's refcnt and its idf under that type of parent. Edges of hot children aren't moved."""
    inner = edges.where(~F.col("parent_type").isin(*ROOT_TYPES))
    refs, totals = materialize(reference_counts(edges), "refs") if refs is None else refs, type_counts(edges) if totals is None else totals
    n = totals.agg(F.sum("n_edges")).first()[0] or 0
    by_type = totals.select(F.col("child_type").alias("parent_type"), F.col("n_edges").alias("total"))
    known = lookup(inner, refs, ["child_type", "child_id"], "refcnt", n, "left").join(F.broadcast(by_type), "parent_type", "left")  # a row a type
    return known.withColumn("idf", child_idf(F.col("total"), F.col("refcnt"))).select("child_type", "child_id", "parent_type", "parent_id", "uniq", "refcnt", "idf")


def build_index(edges: DataFrame, nodes: DataFrame, distinct: DataFrame | None = None) -> Index:
    """Edges are weighed, and dealt by parent once: what is summed by parent then moves nothing.

    ``distinct``: the distinct edges, where they can be had without a shuffle.
    """
    counted = (edges, False) if distinct is None else (distinct, True)
    refs, types = materialize(reference_counts(*counted), "refs"), materialize(type_counts(*counted), "types")
    n = types.agg(F.sum("n_edges")).first()[0] or 0
    weighted = bucketed(weighted_edges(edges, refs, types), "weighted", ["parent_id"], shares(edges.sparkSession, n, EDGES))
    leaf = F.col("child_type").isin(*LEAF_TYPES)
    totals = weighted.where(leaf).groupBy("parent_type", "parent_id", "child_type").agg(F.count("*").alias("kids"), F.sum("idf").alias("expected"))
    attributes = nodes.select(F.col("node_type").alias("child_type"), F.col("node_id").alias("child_id"), "filetype", F.coalesce("licensed", F.lit(False)).alias("licensed"))
    kids = weighted.where("parent_type <> 'file'").join(attributes, ["child_type", "child_id"], "left").withColumn("licensed", F.coalesce("licensed", F.lit(False)))
    roots = edges.where(F.col("parent_type").isin(*ROOT_TYPES)).select(F.col("child_type").alias("node_type"), F.col("child_id").alias("node_id"), F.col("parent_type").alias("root_type"), F.col("parent_id").alias("root")).distinct()
    return Index(weighted, materialize(totals, "totals"), materialize(kids, "kids"), materialize(refs.where(~leaf), "node-refs"), materialize(roots, "roots"))


def hits(query: DataFrame, leaves: DataFrame) -> DataFrame:
    """``artifact`` and the columns of the edges whose child an artifact has, partitioned by parent_id as the edges are.

    A query of FEW rows goes to the edges. Of a larger one each child is a row with the list of its artifacts, which is
    unfolded only where a parent's edges lie together.
    """
    by_child, names = ["child_type", "child_id"], leaves.columns
    wanted = query.select("artifact", *by_child).distinct()
    if wanted.limit(FEW + 1).count() <= FEW:
        return leaves.join(F.broadcast(wanted), by_child).select("artifact", *names)
    packed = wanted.groupBy(*by_child).agg(F.collect_list("artifact").alias("artifacts"))
    met = leaves.join(packed, by_child).select("artifacts", *names).repartition("parent_id")
    return met.select(F.explode("artifacts").alias("artifact"), *names)


def _own_refs(index: Index) -> DataFrame:
    return index.refs.select(F.col("child_type").alias("parent_type"), F.col("child_id").alias("parent_id"), F.col("refcnt").alias("own_ref"))


def leaf_level(query: DataFrame, index: Index, p: Params) -> DataFrame:
    """The files an artifact's features lead to: artifact, node_type, node_id, freq, cnt, score, norm, ref, and counts by type.

    All children's idf sum is one figure per file, so unmatched children aren't joined for each artifact.
    """
    per_file = index.leaf_totals.where(F.col("child_type").isin(*p.leaf_types)).groupBy("parent_type", "parent_id").agg(F.sum("kids").alias("kids"), F.sum("expected").alias("expected"))
    leaves = index.weighted.where(F.col("child_type").isin(*p.leaf_types) & (F.col("refcnt") <= p.popular)).select("child_type", "child_id", "parent_type", "parent_id", "idf")
    by_type = [F.count_if(F.col("child_type") == t).alias(f"g_{t}") for t in COUNTED]
    got = hits(query, leaves).groupBy("artifact", "parent_type", "parent_id").agg(F.count("*").alias("freq"), F.sum(F.greatest(F.col("idf"), F.lit(0.0))).alias("score"), *by_type)
    kept = got.join(per_file, ["parent_type", "parent_id"]).where(100.0 * F.col("freq") / F.col("kids") >= p.min_percent)
    norm = F.coalesce(F.try_divide(F.coalesce("score", F.lit(0.0)), "expected"), F.lit(0.0))
    return kept.join(_own_refs(index), ["parent_type", "parent_id"], "left").select(
        "artifact", F.col("parent_type").alias("node_type"), F.col("parent_id").alias("node_id"), "freq", F.col("kids").alias("cnt"), F.col("freq").alias("gfreq"), F.col("kids").alias("gcnt"),
        F.coalesce("score", F.lit(0.0)).alias("score"), norm.alias("norm"), F.coalesce("own_ref", F.lit(0)).cast("double").alias("ref"), *[f"g_{t}" for t in COUNTED], F.lit(0).alias("level"))


def _rules(p: Params, functions: Column, grouped_share: Column) -> list[Column]:
    """Reasons, apart from popularity, to leave a child of a directory out of its grouped counts."""
    fit = {
        1: (F.col("child_type") == "file") & F.coalesce(F.col("filetype").isin("C", "CPP"), F.lit(False)) & (functions < p.min_functions),
        2: (F.col("child_type") == "dir") & F.col("licensed"),
        4: F.col("child_type").isin(*p.grouped_types) & (grouped_share <= p.min_grouped),
    }
    return [fit[k] for k in p.rules if k in fit]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _unseen(index: Index, p: Params) -> tuple[DataFrame, DataFrame]:
    """(kids, per_parent): edges above files with what a child outside a tree is judged by, and each parent's sums."""
    zero = F.lit(0)
    judged = (F.col("parent_type") == "dir") & F.col("child_type").isin("file", "dir")
    may_be_popular = judged & F.col("child_type").isin(*p.grouped_types) & F.lit(3 in p.rules)
    out = judged & _any(_rules(p, zero, F.lit(0.0)))
    kids = index.kids.withColumns({"own": F.coalesce("refcnt", zero).cast("double"), "judged": judged, "may": may_be_popular, "counts": ~out})
    return kids, kids.groupBy("parent_type", "parent_id").agg(F.count("*").alias("n"), F.sum("own").alias("own_sum"), F.sum("uniq").alias("cnt"))


def _popular(p: Params, r: Column) -> Column:
    """Whether a child with this refcnt is far more popular than its siblings are in the mean."""
    return F.col("may") & (F.col("n") >= 2) & F.coalesce(r >= p.refcnt_ratio * (F.col("sum_r") - r) / (F.col("n") - 1), F.lit(False))


def _seen(parents: DataFrame, tree: DataFrame, kids: DataFrame, p: Params) -> DataFrame:
    """The children in the tree of (artifact, parent, n, own_sum) rows, and whether rules leave them ``out``."""
    state = tree.select("artifact", F.col("node_type").alias("child_type"), F.col("node_id").alias("child_id"), F.col("freq").alias("f"), F.col("gfreq").alias("gf"), F.col("gcnt").alias("gc"), F.col("ref").alias("r"), *[f"g_{t}" for t in COUNTED])
    seen = state.join(kids, ["child_type", "child_id"]).join(parents, ["artifact", "parent_type", "parent_id"])
    seen = seen.withColumn("sum_r", F.col("own_sum") + F.sum(F.col("r") - F.col("own")).over(Window.partitionBy("artifact", "parent_type", "parent_id")))
    share = F.coalesce(F.try_divide(F.col("gf"), F.col("gc")), F.lit(0.0))
    return seen.withColumn("out", (F.col("judged") & _any(_rules(p, F.col("g_func") + F.col("g_funcname"), share))) | _popular(p, F.col("r")))


def dir_level(matched: DataFrame, tree: DataFrame, index: Index, p: Params, level: int) -> DataFrame:
    """The parents of ``matched`` nodes, scored over all of their children; ``tree`` holds every node scored so far.

    Children outside the tree aren't joined for each artifact: what they add is summed per parent, by refcnt where
    popularity can rule them out, and corrected for the children that are in the tree.
    """
    zero, by_child, by_parent = F.lit(0), ["child_type", "child_id"], ["parent_type", "parent_id"]
    kids, per_parent = _unseen(index, p)
    unseen = kids.where("counts").groupBy(*by_parent, "may", F.when(F.col("may"), F.col("own")).alias("own")).agg(F.sum("uniq").alias("h_count"), F.sum(F.col("uniq") * F.col("idf")).alias("h_expected"))

    climb = matched.select("artifact", F.col("node_type").alias("child_type"), F.col("node_id").alias("child_id"), F.col("ref").alias("m_ref"))
    found = climb.join(kids.where(~((F.col("child_type") == "dir") & F.col("licensed"))).select(*by_child, *by_parent), by_child)
    parents = found.groupBy("artifact", *by_parent).agg(F.avg("m_ref").alias("mean_ref")).join(per_parent, by_parent)
    seen = _seen(parents, tree, kids, p).withColumn("was", F.col("counts") & ~_popular(p, F.col("own")))
    live = lambda c: F.sum(F.when(F.col("out"), zero).otherwise(c))
    scored = seen.groupBy("artifact", *by_parent).agg(
        F.sum(F.greatest(F.col("f"), zero)).alias("freq"), F.sum(F.col("gf") - F.when(F.col("out"), F.col("f")).otherwise(zero)).alias("gfreq"),
        (live(F.col("gc")) - F.sum(F.when(F.col("was"), F.col("uniq")).otherwise(zero))).alias("live_count"),
        (F.coalesce(live(F.col("gc") * F.col("idf")), F.lit(0.0)) - F.coalesce(F.sum(F.when(F.col("was"), F.col("uniq") * F.col("idf"))), F.lit(0.0))).alias("live_expected"),
        F.coalesce(live(F.greatest(F.col("gf") * F.col("idf"), F.lit(0.0))), F.lit(0.0)).alias("score"),
        *[live(F.col(f"g_{t}")).alias(f"g_{t}") for t in COUNTED], *[F.first(c).alias(c) for c in ("mean_ref", "cnt", "n", "sum_r")],
    )
    counted = F.when(_popular(p, F.col("own")), F.lit(None)).otherwise
    rest = scored.select("artifact", *by_parent, "n", "sum_r").join(unseen, by_parent).groupBy("artifact", *by_parent).agg(F.sum(counted(F.col("h_count"))).alias("rest_count"), F.sum(counted(F.col("h_expected"))).alias("rest_expected"))
    ref = F.coalesce("own_ref", zero) + (F.col("mean_ref") if p.propagate else F.lit(0.0))
    full = scored.join(rest, ["artifact", *by_parent], "left").withColumns({"gcnt": F.col("live_count") + F.coalesce("rest_count", zero), "expected": F.col("live_expected") + F.coalesce("rest_expected", F.lit(0.0))})
    # a sum of nothing but corrections is 0, whatever rounding leaves of it
    norm = F.coalesce(F.when(F.abs("expected") > 1e-9, F.col("score") / F.col("expected")), F.lit(0.0))
    return full.join(_own_refs(index), by_parent, "left").select(
        "artifact", F.col("parent_type").alias("node_type"), F.col("parent_id").alias("node_id"), "freq", "cnt", "gfreq", "gcnt",
        "score", norm.alias("norm"), ref.cast("double").alias("ref"), *[f"g_{t}" for t in COUNTED], F.lit(level).alias("level"))


def descend(tops: DataFrame, tree: DataFrame, index: Index, p: Params) -> DataFrame:
    """(artifact, top_id, node_type, node_id, below): the matched nodes under each (artifact, node_type, node_id) of ``tops``.

    The way down is that of the score: children in the tree that no rule leaves out. ``below`` counts the levels from 0, the top
    itself. Levels follow each other till none is left; their number is the depth of the paths.
    """
    kids, per_parent = _unseen(index, p)
    current = tops.select("artifact", F.col("node_id").alias("top_id"), "node_type", "node_id", F.lit(0).alias("below")).distinct()
    out, level = current, 0
    while level < p.max_levels:
        level += 1
        at = current.select("artifact", "top_id", F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id"))
        parents = at.drop("top_id").distinct().join(per_parent, ["parent_type", "parent_id"])
        live = _seen(parents, tree, kids, p).where(~F.col("out")).select("artifact", "parent_type", "parent_id", F.col("child_type").alias("node_type"), F.col("child_id").alias("node_id"))
        current = materialize(at.join(live, ["artifact", "parent_type", "parent_id"]).select("artifact", "top_id", "node_type", "node_id", F.lit(level).alias("below")).distinct(), "below")
        if current.isEmpty():
            break
        out = out.unionByName(current)
    return out


def matched_leaves(below: DataFrame, query: DataFrame, index: Index, p: Params) -> DataFrame:
    """(artifact, top_id, child_type, child_id): the artifact's features in the matched files under each top."""
    files = below.where("node_type = 'file'").select("artifact", "top_id", F.col("node_id").alias("parent_id")).distinct()
    leaves = index.weighted.where((F.col("parent_type") == "file") & F.col("child_type").isin(*p.leaf_types) & (F.col("refcnt") <= p.popular))
    return hits(query, leaves.select("child_type", "child_id", "parent_id")).join(files, ["artifact", "parent_id"]).select("artifact", "top_id", "child_type", "child_id").distinct()


def search(query: DataFrame, index: Index, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(tree, roots): every scored node, the latest level's score where one is met twice, and the accepted roots.

    Levels follow each other until no node survives; each level is a table in the shared folder, so lineage stays
    short and a lost executor costs its tasks only. The number of levels is the depth of the paths.
    """
    tree = materialize(leaf_level(query, index, p), "level")
    current, level = tree, 0
    while level < p.max_levels:
        survivors = current.where(F.col("norm") > p.low_score)
        if survivors.isEmpty():
            break
        level += 1
        current = materialize(dir_level(survivors, tree, index, p, level), "level")
        newest = current.select("artifact", "node_type", "node_id")
        tree = tree.join(newest, ["artifact", "node_type", "node_id"], "left_anti").unionByName(current)
        if level % 8 == 0:
            tree = materialize(tree, "tree")
    return tree, accept(tree.where(F.col("norm") > p.low_score), index, p)


def accept(survivors: DataFrame, index: Index, p: Params) -> DataFrame:
    """Roots of surviving nodes that meet the limits on features, functions and score."""
    fit = (F.col("gcnt") >= p.min_features) & (F.col("g_func") + F.col("g_funcname") >= p.min_functions) & (F.col("norm") >= p.accept_score)
    return survivors.where(fit).join(index.roots, ["node_type", "node_id"]).select("artifact", "root_type", "root", F.col("gfreq").alias("featfreq"), F.col("gcnt").alias("featcnt"), "score", "norm", *[f"g_{t}" for t in COUNTED])


def top_versions(matches: DataFrame, by: list[str], order: list[Column], n: int = 5) -> DataFrame:
    """The best versions of each component, with their rank."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
