"""Version pinpointing, co-location, result groups and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimark.functions.hashing import near_values
from sedimark.functions.scalar import is_version_feature, license_family
from sedimark.operators.components import connected_components
from sedimark.operators.overlap import overlapping, sets
from sedimark.session import materialize


def version_matches(unique: DataFrame, query: DataFrame, software: str, version: str, feature: str) -> DataFrame:
    """(artifact, software, version, matched) of version-unique features that a query has; software of one version is skipped."""
    several = unique.groupBy(software).agg(F.count_distinct(version).alias("_n")).where("_n > 1").select(software)
    return query.join(unique.join(several, software, "left_semi"), feature).groupBy("artifact", software, version).agg(F.count_distinct(feature).alias("matched"))


def colocated(index: DataFrame, query: DataFrame, feature: str, file: str, unit: str, least: float = 0.7, weights: DataFrame | None = None) -> DataFrame:
    """(unit, file, shared, ratio): query units and index files whose features overlap by Jaccard over ``least``.

    With ``weights`` (feature, weight), shared and all features count by their weight; a feature without one counts 1.
    """
    i, q = index.select(feature, file).distinct(), query.select(feature, unit).distinct()
    if weights is not None:
        w = weights.select(feature, F.col("weight").cast("double").alias("_w"))
        i, q = (x.join(w, feature, "left").withColumn("_w", F.coalesce("_w", F.lit(1.0))) for x in (i, q))
    weighted = weights is not None
    return overlapping(sets(q, feature, unit, weighted), sets(i, feature, file, weighted), unit, file, least, weighted)


def colocated_matches(matches: DataFrame, pairs: DataFrame, feature_units: DataFrame, feature_files: DataFrame, feature: str, file: str, unit: str, strict: bool = False) -> DataFrame:
    """``matches`` (with ``feature``) and whether a co-located pair of a unit and a file has the feature on both sides; only those if ``strict``.

    The default keeps all, as scores are taken over the unfiltered matches.
    """
    sure = pairs.select(unit, file).join(feature_units.select(feature, unit).distinct(), unit).join(feature_files.select(feature, file).distinct(), [feature, file]).select(feature).distinct()
    out = matches.join(sure.withColumn("colocated", F.lit(True)), feature, "left").withColumn("colocated", F.coalesce("colocated", F.lit(False)))
    return out.where("colocated") if strict else out


def version_scores(matches: DataFrame, by: list[str], tag: str, plain: str, tag_only: str) -> DataFrame:
    """Credit of each version: 100 for a feature whose text holds the version, 41 if only the tag found it, else 1."""
    good = is_version_feature(F.col(tag), F.col(plain))
    credit = F.when(F.col(tag_only), 41).when(good, 100).otherwise(1)
    return matches.groupBy(*by, tag).agg(F.sum(credit).cast("long").alias("score"))


def with_fallback(tfidf: DataFrame, versions: DataFrame, by: list[str], version: str) -> DataFrame:
    """Score rows that versions confirm; all of an artifact's, with version score 0, where none is confirmed."""
    joined = tfidf.join(versions, [*by, version], "left")
    sure = versions.join(tfidf.select(*by, version), [*by, version], "left_semi").select(*by).distinct().withColumn("_sure", F.lit(True))
    joined = joined.join(sure, by, "left")
    return joined.where(F.col("_sure").isNull() | F.col("version_score").isNotNull()).withColumn("version_score", F.coalesce("version_score", F.lit(0))).drop("_sure")


def group_ids(members: DataFrame, pairs: DataFrame, node: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group): the smallest member joined to a node by pairs, directly or not."""
    found = connected_components(pairs, a, b).withColumnsRenamed({"node": node, "component": "group"})
    return members.select(node).distinct().join(found, node, "left").withColumn("group", F.coalesce("group", node))


def verdict(license_name: Column, overlap: Column, least: float = 0.5) -> Column:
    """violation for gpl, and for lgpl whose classes aren't kept; compliant for lgpl that keeps them; else none."""
    family = license_family(license_name)
    return F.when(family == "gpl", "violation").when((family == "lgpl") & (overlap >= least), "compliant").when(family == "lgpl", "violation").otherwise("none")


def collapse_branches(branches: DataFrame, catalogue: DataFrame, by: list[str], branch: str, name: str, score: str, n: int = 5) -> DataFrame:
    """One row for each name that an artifact's branches belong to: the best score, its best ``n`` versions by falling score, and the licences of all.

    ``catalogue`` has name, version and licence of each branch; a branch that it doesn't know goes by its own id.
    """
    known = branches.join(catalogue, branch, "left").withColumn(name, F.coalesce(name, branch))
    rank = F.row_number().over(Window.partitionBy(*by, name).orderBy(F.col(score).desc(), F.col(branch)))
    top = known.withColumn("_rank", rank)
    kept = F.array_sort(F.collect_list(F.when(F.col("_rank") <= n, F.struct("_rank", "version"))))
    return top.groupBy(*by, name).agg(
        F.max(score).alias(score), F.count("*").alias("n_branches"), F.array_join(F.transform(kept, lambda x: F.coalesce(x["version"], F.lit("?"))), ",").alias("versions"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))


def pairs_within(rows: DataFrame, by: list[str], unit: str, value: str, most: int = 5) -> DataFrame:
    """(by, a, b): units of one group of which two values differ in ``most`` bits at most. A unit may have several values.

    Units with equal values are chained to the least of them, not paired.
    """
    values = materialize(rows.select(*by, unit, value).distinct(), "values")
    least = materialize(values.groupBy(*by, value).agg(F.min(unit).alias("a")), "least")
    same = values.join(least, [*by, value]).where(F.col(unit) != F.col("a")).select(*by, "a", F.col(unit).alias("b"))
    near = near_values(least.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")), most, by)
    met = near.join(least.withColumnRenamed(value, "x"), [*by, "x"]).join(least.withColumnsRenamed({value: "y", "a": "b"}), [*by, "y"]).where("a != b")
    return same.unionByName(met.select(*by, "a", "b")).select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
