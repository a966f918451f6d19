"""Index construction: counters, edges, reference counts, roll-ups, admission and thinning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimark.functions.hashing import near_values
from sedimark.session import materialize

#: Parents that don't count as references of a child.
ROOT_TYPES = ("branch", "repo")


def file_counters(features: DataFrame, by: Sequence[str], ftype: str, freq: str, types: Sequence[str]) -> DataFrame:
    """For each file, the total and the distinct number of features of each type. One row per distinct feature goes in."""
    aggs = [x for t in types for x in (F.sum(F.when(F.col(ftype) == t, F.col(freq)).otherwise(0)).alias(f"{t}_total"), F.count_if(F.col(ftype) == t).alias(f"{t}_unique"))]
    return features.groupBy(*by).agg(*aggs)


def _inner(edges: DataFrame, distinct: bool) -> DataFrame:
    inner = edges.where(~F.col("parent_type").isin(*ROOT_TYPES)).select("child_type", "child_id", "parent_type", "parent_id")
    return inner if distinct else inner.distinct()


def reference_counts(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(child_type, child_id, refcnt): distinct parents of each child, roots aside. ``distinct``: the edges are so already."""
    return _inner(edges, distinct).groupBy("child_type", "child_id").agg(F.count("*").alias("refcnt"))


def type_counts(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(child_type, n_edges): distinct edges whose child has the type, roots aside. ``distinct``: the edges are so already."""
    return _inner(edges, distinct).groupBy("child_type").agg(F.count("*").alias("n_edges"))


def ancestors(paths: DataFrame, path: str) -> DataFrame:
    """One row per directory above each path, with its depth; the first part is the root, of depth 1."""
    parts = F.split(F.col(path), "/")
    rows = paths.withColumn("_parts", parts).where(F.size("_parts") > 1)
    return rows.select(*paths.columns, F.explode(F.sequence(F.lit(1), F.size("_parts") - 1)).alias("depth"), "_parts").select(
        *paths.columns, "depth", F.array_join(F.slice("_parts", F.lit(1), F.col("depth")), "/").alias("dir"))


def roll_up(children: DataFrame, parent: str, child: str, counters: Sequence[str]) -> DataFrame:
    """Counters of each parent over its distinct children: equal children count once."""
    once = children.groupBy(parent, child).agg(*[F.max(c).alias(c) for c in counters])
    return once.groupBy(parent).agg(*[F.sum(c).alias(c) for c in counters], F.count("*").alias("n_children"))


def repo_stats(features: DataFrame, repo: str, feature: str, file: str, freq: str) -> DataFrame:
    """Per repository: features by file and by frequency, distinct features, and the extremes of a feature's number of files."""
    per = features.groupBy(repo, feature).agg(F.sum(freq).alias("_n"), F.count_distinct(file).alias("_files"))
    return per.groupBy(repo).agg(
        F.sum("_files").alias("total"), F.sum("_n").alias("total_freq"), F.count("*").alias("unique"),
        F.max("_files").alias("max_score"), F.min("_files").alias("min_score"))


def version_unique(facts: DataFrame, software: str, version: str, feature: str) -> DataFrame:
    """(software, feature, version) of features that one version alone has."""
    return facts.groupBy(software, feature).agg(F.min(version).alias(version), F.max(version).alias("_last")).where(F.col(version) == F.col("_last")).drop("_last")


def near_pairs_by_child(edges: DataFrame, value: str, most: int = 5, popular: int = 2000) -> DataFrame:
    """(a, b, distance): parents of one child whose values differ in ``most`` bits at most; popular children link nothing.

    Parents with the same value and the same unpopular children are a class. Near values are found first, then classes of
    such values are compared, and the pairs of parents are made of the classes last; the result has all pairs of a group
    of copies by definition, and so grows with its square.
    """
    base = edges.select("child_id", "parent_id", F.col(value).alias("v")).distinct()
    often = base.groupBy("child_id").agg(F.count("*").alias("n")).where(F.col("n") > popular).select("child_id")  # as many as popular ones, far fewer than children
    kept = base.where(F.col("child_id").isNotNull()).join(often, "child_id", "left_anti").groupBy("parent_id", "v").agg(F.array_sort(F.collect_list("child_id")).alias("children"))
    members = materialize(kept.withColumn("k", F.sha2(F.to_json("children"), 256)), "members")
    classes = materialize(members.groupBy("v", "k").agg(F.min("parent_id").alias("c"), F.count("*").alias("n")), "classes")
    values = classes.select("v").where("v IS NOT NULL").distinct()
    near = near_values(values, most)
    met = near.unionByName(values.select(F.col("v").alias("x"), F.col("v").alias("y"), F.lit(0).alias("distance")))
    one, two = classes.select(F.col("v").alias("x"), F.col("k").alias("xk"), F.col("c").alias("xc")), classes.select(F.col("v").alias("y"), F.col("k").alias("yk"), F.col("c").alias("yc"))
    pairs = materialize(met.join(one, "x").join(two, "y").where("x != y OR xk < yk"), "class-pairs")
    sets = members.select(F.col("parent_id").alias("c"), "v", "children").join(classes.select("c", "v", "k"), ["c", "v"])
    left, right = sets.select(F.col("c").alias("xc"), F.col("v").alias("x"), F.col("children").alias("xs")), sets.select(F.col("c").alias("yc"), F.col("v").alias("y"), F.col("children").alias("ys"))
    alike = pairs.join(left, ["xc", "x"]).join(right, ["yc", "y"]).where(F.arrays_overlap("xs", "ys")).select("x", "xk", "y", "yk", "distance")
    own = classes.where("n > 1 AND v IS NOT NULL").select(F.col("v").alias("x"), F.col("k").alias("xk"), F.col("v").alias("y"), F.col("k").alias("yk"), F.lit(0).alias("distance"))
    a, b = members.select(F.col("v").alias("x"), F.col("k").alias("xk"), F.col("parent_id").alias("a")), members.select(F.col("v").alias("y"), F.col("k").alias("yk"), F.col("parent_id").alias("b"))
    found = alike.unionByName(own).join(a, ["x", "xk"]).join(b, ["y", "yk"]).where("a != b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def best_candidate(rows: DataFrame, by: Sequence[str], candidate: str, weight: str) -> DataFrame:
    """Each group's candidate with the largest sum of weights, the smallest of equals."""
    total = rows.groupBy(*by, candidate).agg(F.sum(weight).alias("votes"))
    best = total.groupBy(*by).agg(F.max(F.struct(F.col("votes"), (-F.col(candidate)).alias("o"), F.col(candidate).alias("c"))).alias("b"))
    return best.select(*by, F.col("b.c").alias(candidate), F.col("b.votes").alias("votes"))


def first_by(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; order until no ties are left."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dealt(rows: DataFrame, order: Sequence[str], shares: int, name: str) -> DataFrame:
    """Rows with the number, from 1, of their share: equal stretches of the whole order, the first ones longer by a row.

    Rows are sorted by range into partitions and ranked within them; only the partitions' sizes meet in one place.
    """
    placed = materialize(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumns({"_before": before, "_total": F.sum("_n").over(Window.partitionBy())})
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = placed.withColumn("_rank", rank).join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_rank") + F.col("_before"))
    size, longer = F.floor(F.col("_total") / shares), F.col("_total") % shares
    long_rows = longer * (size + 1)
    share = F.when(F.col("_rank") < long_rows, F.floor(F.col("_rank") / (size + 1))).otherwise(longer + F.floor((F.col("_rank") - long_rows) / F.greatest(size, F.lit(1))))
    return ranked.select(*rows.columns, (share + 1).cast("long").alias(name))


def thin_tags(tags: DataFrame, repo: str, tag: str, date: str, months: int = 3, keep: int = 8) -> DataFrame:
    """Of each repository the newest tag of each stretch of ``months`` before its newest tag, of the newest ``keep`` stretches."""
    newest = F.max(date).over(Window.partitionBy(repo))
    age = (F.year(newest) - F.year(date)) * 12 + F.month(newest) - F.month(date)
    staged = tags.withColumn("bucket", F.floor(age / months).cast("int"))
    one = first_by(staged, [repo, "bucket"], [F.col(date).desc(), F.col(tag)])
    return first_by(one, [repo], [F.col("bucket")], keep)


def admitted(repos: DataFrame, repo_id: str, name: str, size: str, dirs: str, unwanted: Sequence[str], least: int = 4, most: int = 122880) -> DataFrame:
    """Repositories with a numeric id, a wanted name, a size in range, and no operating system's or boot loader's tree."""
    low = F.lower(F.regexp_extract(F.col(name), "([^/]*)$", 1))
    bad = F.lit(False)
    for w in unwanted:
        bad = bad | low.contains(w)
    has = lambda *d: F.size(F.array_intersect(F.col(dirs), F.array(*map(F.lit, d)))) == len(d)
    kernel, boot = has("Documentation", "arch", "mm", "kernel", "drivers"), has("api", "arch", "board", "common", "nand_spl", "drivers")
    return repos.where(F.col(repo_id).rlike("^-*[0-9]+$") & ~bad & F.col(size).between(least, most) & ~kernel & ~boot)
