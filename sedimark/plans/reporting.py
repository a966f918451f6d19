"""Queries over centroids, versions, groups, verdicts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimark.functions import hashing as H
from sedimark.functions import scalar as S
from sedimark.operators import centroid as C
from sedimark.operators import versions as V
from sedimark.operators.index import version_unique
from sedimark.plans.base import TOKENS_SQL, Section
from sedimark.plans.indexing import _SIMHASH_SQL, EDGES_SQL, _simhashes, corpus_edges, features
from sedimark.plans.matching import passages
from sedimark.session import shares, table

section = Section()
q = section.add
col = F.col

#: Bytes of lines, as stored, that one task gets.
LINE_BYTES = 8_000_000

# --- centroids ---


@q("SELECT o_orderkey AS method, CASE WHEN n = 1 THEN 0.0 ELSE round(sx / w, 6) END AS x, round(CASE WHEN n = 1 THEN d ELSE sy / w END, 6) AS y, w1::BIGINT AS w FROM ("
   "SELECT a.l_orderkey AS o_orderkey, any_value(c.n) AS n, sum(a.s * a.l_linenumber + b.s * b.l_linenumber)::DOUBLE AS sx, sum(a.s * a.dep + b.s * b.dep)::DOUBLE AS sy, sum(a.s + b.s)::DOUBLE AS w, 0 AS d, sum(a.s + b.s) AS w1 "
   "FROM (SELECT *, (l_quantity)::BIGINT AS s, l_suppkey % 4 AS dep FROM lineitem) a JOIN (SELECT *, (l_quantity)::BIGINT AS s, l_suppkey % 4 AS dep FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 "
   "JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_orderkey = a.l_orderkey GROUP BY 1)")  # fmt: skip
def centroid_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of chains of blocks: an order is a method, a line a block that leads to the next line."""
    li = table(spark, sf_dir, "lineitem")
    nxt = li.select("l_orderkey", (col("l_linenumber") - 1).alias("l_linenumber"), F.lit(True).alias("more")).distinct()
    blocks = li.join(nxt, ["l_orderkey", "l_linenumber"], "left").select(
        col("l_orderkey").alias("method"), col("l_linenumber").alias("seq"), F.lit(1).alias("out_degree"), (col("l_suppkey") % 4).alias("depth"), col("l_quantity").cast("long").alias("stmts"), F.lit(0).alias("invokes"),
        F.when(col("more"), F.array(col("l_linenumber") + 1)).otherwise(F.array().cast("array<int>")).alias("successors"))
    several = blocks.groupBy("method").agg(F.count("*").alias("n")).where("n > 1").select("method")
    c = C.centroids(blocks.join(several, "method", "left_semi")).where("w > 0")
    return c.select("method", F.round("x", 6).alias("x"), F.round("z", 6).alias("y"), "w")


_DIMS = 8


def _cent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[(col("embedding")[i].cast("double") + 1).alias(f"v{i}") for i in range(_DIMS)])


_CENT_SQL = "c AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE + 1 AS v{i}" for i in range(_DIMS)) + " FROM embeddings)"
_FIT = " AND ".join(f"b.v{i} BETWEEN a.v{i} * 0.95 / 1.05 AND a.v{i} * 1.05 / 0.95" for i in range(_DIMS))
_PAIRS_SQL = f"WITH {_CENT_SQL}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id FROM c a JOIN c b ON {_FIT})"


def _range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cent(spark, sf_dir)
    return C.range_join(c.withColumnRenamed("vec_id", "query_id"), c, "query_id", "vec_id", [f"v{i}" for i in range(_DIMS)], 0.05)


q(f"{_PAIRS_SQL} SELECT * FROM p", "centroid_range")(_range_pairs)
q(f"{_PAIRS_SQL} SELECT query_id, vec_id FROM p WHERE query_id IN (SELECT query_id FROM p GROUP BY 1 HAVING count(*) <= 3)", "centroid_guard")(lambda s, d: C.selective(_range_pairs(s, d), "query_id", 3))

_BIN_SQL = """lo AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_extendedprice * 1.01 / 0.99 - l_extendedprice * 0.99 / 1.01 AS d FROM lineitem),
b AS (SELECT *, floor(x * pow(10.0, -(floor(log10(d)) + 1))) / pow(10.0, -(floor(log10(d)) + 1)) AS base FROM lo),
r AS (SELECT *, base * 1.01 / 0.99 - base * 0.99 / 1.01 AS e FROM b),
s AS (SELECT *, CASE WHEN base = 0 THEN floor(d * pow(10.0, -(floor(log10(d)) - 1))) / pow(10.0, -(floor(log10(d)) - 1)) ELSE floor(e * pow(10.0, -(floor(log10(nullif(e, 0))) - 1))) / pow(10.0, -(floor(log10(nullif(e, 0))) - 1)) END AS step FROM r)"""


@q(f"WITH {_BIN_SQL} SELECT l_orderkey, l_linenumber, round(base + floor((x - base) / step) * step, 6) AS low, round(base + floor((x - base) / step) * step + step, 6) AS high FROM s")
def centroid_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid values around each value."""
    low, high = C.grid_bin(col("l_extendedprice"), 0.01)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@q("WITH RECURSIVE li AS (SELECT l_orderkey AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS b, l_partkey AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), "
   "k AS (SELECT *, (2 * b <= n)::INT + (2 * b + 1 <= n)::INT AS s, p % 7 AS st, md5(p::VARCHAR) AS d FROM li), "
   "r AS (SELECT *, row_number() OVER (PARTITION BY m, b // 2 ORDER BY s DESC, st DESC, d DESC, b DESC) AS o FROM k), "
   "t AS (SELECT m, b, '' AS path FROM r WHERE b = 1 UNION ALL SELECT r.m, r.b, t.path || r.o::VARCHAR FROM t JOIN r ON r.m = t.m AND r.b // 2 = t.b AND r.b > 1) "
   "SELECT m AS method, b::INT AS block, (row_number() OVER (PARTITION BY m ORDER BY path))::INT AS seq FROM t")  # fmt: skip
def bb_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the blocks of orders taken as methods: block k leads to 2k and 2k + 1."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("k"))  # an order's lines are few
    rows = li.select(col("l_orderkey").alias("method"), F.size("k").alias("n"), F.posexplode("k").alias("at", "p")).withColumn("b", col("at") + 1)
    kids = F.filter(F.array(col("b") * 2, col("b") * 2 + 1), lambda v: v <= col("n"))
    return C.number_blocks(rows.select("method", col("b").alias("block"), (col("p") % 7).cast("int").alias("stmts"), F.md5(col("p").cast("string")).alias("digest"), kids.alias("successors")))


# --- versions ---

_UNIQUE_SQL = f"{TOKENS_SQL}, u AS (SELECT source, token, min(lang) AS lang FROM feat GROUP BY 1, 2 HAVING count(DISTINCT lang) = 1), several AS (SELECT source FROM u GROUP BY 1 HAVING count(DISTINCT lang) > 1), qq AS (SELECT DISTINCT item_id AS artifact, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM benchmark)".replace("{{", "{").replace("}}", "}")
_VM_SQL = f"WITH {_UNIQUE_SQL}, vm AS (SELECT artifact, source, lang, count(DISTINCT token) AS matched FROM qq JOIN u USING (token) WHERE source IN (SELECT source FROM several) GROUP BY 1, 2, 3)"


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_unique(features(spark, sf_dir), "source", "lang", "token")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.version_matches(_unique(spark, sf_dir), passages(spark, sf_dir).select("artifact", col("child_id").alias("token")), "source", "lang", "token")


q(f"{_VM_SQL} SELECT * FROM vm", "version_matches")(_matches)


@q(f"{_VM_SQL}, tf AS (SELECT qq.artifact, source, lang, count(*) AS hits FROM qq JOIN (SELECT DISTINCT source, lang, token FROM feat) f USING (token) GROUP BY 1, 2, 3 HAVING count(*) >= 5), j AS (SELECT tf.*, matched FROM tf LEFT JOIN vm USING (artifact, source, lang)), "
   "s AS (SELECT *, max(matched) OVER (PARTITION BY artifact, source) AS m FROM j) SELECT artifact, source, lang, hits, coalesce(matched, 0) AS version_score FROM s WHERE m IS NULL OR matched IS NOT NULL")  # fmt: skip
def distinct_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows that unique features confirm, or all of them where none is confirmed."""
    query = passages(spark, sf_dir).select("artifact", col("child_id").alias("token"))
    tf = query.join(features(spark, sf_dir).select("source", "lang", "token").distinct(), "token").groupBy("artifact", "source", "lang").agg(F.count("*").alias("hits")).where("hits >= 5")
    return V.with_fallback(tf, _matches(spark, sf_dir).withColumnRenamed("matched", "version_score"), ["artifact", "source"], "lang")


@q(f"WITH {TOKENS_SQL}, i AS (SELECT doc_id, token, count(*) OVER (PARTITION BY doc_id) AS ni FROM feat), c AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM conversations), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS nq FROM c), "
   "b AS (SELECT conv_id, doc_id, count(*) AS shared, min(ni) AS ni, min(nq) AS nq FROM n JOIN i USING (token) GROUP BY 1, 2) SELECT conv_id, doc_id, shared, round(shared::DOUBLE / (ni + nq - shared), 6) AS ratio FROM b WHERE shared::DOUBLE / (ni + nq - shared) > 0.13".replace("{{", "{").replace("}}", "}"))  # fmt: skip
def colocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and documents whose words overlap."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    return V.colocated(features(spark, sf_dir), conv, "token", "doc_id", "conv_id", 0.13).withColumn("ratio", F.round("ratio", 6))


_CREDIT = ["o_custkey", "concat('v', cast(o_custkey % 3 AS string), '.', cast(o_orderkey % 5 AS string)) AS tag", "concat('lib ', cast(o_custkey % 3 AS string), '.', cast(o_orderkey % 7 AS string), ' ok') AS plain", "o_orderkey % 11 = 0 AS tag_only"]


@q(f"SELECT o_custkey, tag, sum(CASE WHEN tag_only THEN 41 WHEN regexp_matches(plain, concat('(^|v|[^,:.\\w])', replace(substr(tag, 2), '.', '[.\\-_]'), '($|[^,:.\\w])')) THEN 100 ELSE 1 END)::BIGINT AS score FROM (SELECT {', '.join(_CREDIT)} FROM orders) GROUP BY 1, 2")
def version_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version's credit."""
    return V.version_scores(table(spark, sf_dir, "orders").selectExpr(*_CREDIT), ["o_custkey"], "tag", "plain", "tag_only")


@q(f"WITH {_UNIQUE_SQL}, a AS (SELECT DISTINCT source, lang FROM documents) SELECT a.source, a.lang, count(token) AS n FROM a LEFT JOIN u ON u.source = a.source AND u.lang = a.lang GROUP BY 1, 2")
def unique_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique features of every version, none included."""
    versions = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return versions.join(_unique(spark, sf_dir), ["source", "lang"], "left").groupBy("source", "lang").agg(F.count("token").alias("n"))


@q("SELECT s.s_suppkey AS id, coalesce(n.n_name, cast(s.s_suppkey AS VARCHAR)) AS name FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_suppkey")
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the catalogue; unknown ids keep the id."""
    n = table(spark, sf_dir, "nation").select(col("n_nationkey").cast("long").alias("id"), "n_name")
    return table(spark, sf_dir, "supplier").select(col("s_suppkey").alias("id")).join(n, "id", "left").select("id", F.coalesce("n_name", col("id").cast("string")).alias("name"))


# --- groups ---

_SOURCE_SIM = _SIMHASH_SQL.replace("doc_id, ('0x'", "source AS doc_id, ('0x'")


def _source_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.simhash(features(spark, sf_dir), ["source"], "token")


@q(f"WITH {_SOURCE_SIM} SELECT doc_id AS source, printf('%016x', v) AS simhash FROM simhash")
def matched_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash of each component's features."""
    return _source_simhash(spark, sf_dir).select("source", H.hex64(col("simhash")).alias("simhash"))


@q(f"WITH {_SOURCE_SIM} SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.v, b.v)::UBIGINT)::INT AS distance FROM simhash a JOIN simhash b ON a.doc_id < b.doc_id")
def content_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of components of one result, which are few."""
    s = _source_simhash(spark, sf_dir)
    pairs = s.select(col("source").alias("a"), col("simhash").alias("x")).join(s.select(col("source").alias("b"), col("simhash").alias("y")), col("a") < col("b"))
    return pairs.select("a", "b", H.hamming(col("x"), col("y")).cast("int").alias("distance"))


@q("SELECT a.l_orderkey AS artifact, a.l_partkey AS a, b.l_partkey AS b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey")
def group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of components that one artifact matched; an artifact's matches are few."""
    m = table(spark, sf_dir, "lineitem").select(col("l_orderkey").alias("artifact"), col("l_partkey").alias("a")).distinct()
    return m.join(m.withColumnRenamed("a", "b"), "artifact").where("a < b").select("artifact", "a", "b")


_LINK = "SELECT DISTINCT least(o_custkey, o_custkey * 7 % 1500) AS a, greatest(o_custkey, o_custkey * 7 % 1500) AS b FROM orders"


@q(f"WITH RECURSIVE l AS ({_LINK}), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT c_custkey AS node, c_custkey AS g FROM customer UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.node) SELECT node AS c_custkey, min(g) AS \"group\" FROM r WHERE node IN (SELECT c_custkey FROM customer) GROUP BY 1")
def repo_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components joined into groups by pairs."""
    pairs = table(spark, sf_dir, "orders").select(F.least(col("o_custkey"), col("o_custkey") * 7 % 1500).alias("a"), F.greatest(col("o_custkey"), col("o_custkey") * 7 % 1500).alias("b")).distinct()
    known = table(spark, sf_dir, "customer").select("c_custkey")
    return V.group_ids(known, pairs, "c_custkey")


@q("WITH RECURSIVE f AS (SELECT l_orderkey, l_suppkey, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS m FROM lineitem), l AS (SELECT DISTINCT m AS a, l_suppkey AS b FROM f), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), "
   "r AS (SELECT a AS node, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.node) SELECT node, min(g) AS \"group\" FROM r GROUP BY 1")  # fmt: skip
def app_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups merged over all libraries of an app."""
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    first = m.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"))
    pairs = m.join(first, "l_orderkey").select("a", col("l_suppkey").alias("b")).distinct()
    return V.group_ids(m.select(col("l_suppkey").alias("node")), pairs, "node")


@q(f"WITH RECURSIVE {_SIMHASH_SQL}, l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM simhash a JOIN simhash b ON a.doc_id <> b.doc_id WHERE bit_count(xor(a.v, b.v)::UBIGINT) <= 5), "
   "r AS (SELECT doc_id AS node, doc_id AS g FROM simhash UNION SELECT l.b, r.g FROM r JOIN l ON l.a = r.node) SELECT node AS doc_id, min(g) AS \"group\" FROM r GROUP BY 1")  # fmt: skip
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files grouped by SimHash distance of at most five bits, chained; equal values are linked once, not in pairs."""
    s = _simhashes(spark, sf_dir)
    return V.group_ids(s.select("doc_id"), V.pairs_within(s, [], "doc_id", "simhash"), "doc_id")


@q(f"WITH {TOKENS_SQL} SELECT artifact, source, count(DISTINCT token) AS n_leaves, md5(string_agg(DISTINCT token, ',' ORDER BY token)) AS leaves FROM (SELECT DISTINCT item_id AS artifact, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM benchmark) JOIN (SELECT DISTINCT source, token FROM feat) USING (token) GROUP BY 1, 2".replace("{{", "{").replace("}}", "}"))
def matched_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each component that an artifact matched."""
    hit = passages(spark, sf_dir).select("artifact", col("child_id").alias("token")).join(features(spark, sf_dir).select("source", "token").distinct(), "token")
    return hit.groupBy("artifact", "source").agg(F.count("*").alias("n_leaves"), F.md5(F.array_join(F.array_sort(F.collect_list("token")), ",")).alias("leaves"))


# --- verdicts ---

_MATCH = ["o_orderkey", "o_custkey", "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END AS software", "CASE cast(o_orderkey % 4 AS int) WHEN 0 THEN 'GPL-3' WHEN 1 THEN 'LGPL' WHEN 2 THEN 'MIT' ELSE 'Apache' END AS license", "(o_orderkey % 10) / 10.0 AS overlap"]
_FAMILY = "CASE WHEN lower(license) LIKE '%lgpl%' THEN 'lgpl' WHEN lower(license) LIKE '%gpl%' THEN 'gpl' ELSE 'nongpl' END"


@q(f"SELECT o_orderkey, coalesce(software::VARCHAR, concat('path/', o_orderkey::VARCHAR)) AS software, {_FAMILY} AS family FROM (SELECT {', '.join(_MATCH)} FROM orders)")
def license_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by licence family; a match without an id goes by its path."""
    m = table(spark, sf_dir, "orders").selectExpr(*_MATCH)
    return m.select("o_orderkey", F.coalesce(col("software").cast("string"), F.concat(F.lit("path/"), col("o_orderkey").cast("string"))).alias("software"), S.license_family(col("license")).alias("family"))


@q(f"WITH v AS (SELECT o_custkey, CASE WHEN f = 'gpl' THEN 'violation' WHEN f = 'lgpl' AND overlap >= 0.5 THEN 'compliant' WHEN f = 'lgpl' THEN 'violation' ELSE 'none' END AS verdict FROM (SELECT *, {_FAMILY} AS f FROM (SELECT {', '.join(_MATCH)} FROM orders))) SELECT o_custkey, verdict, count(*) AS n FROM v GROUP BY 1, 2")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on matches, counted for each artifact."""
    m = table(spark, sf_dir, "orders").selectExpr(*_MATCH)
    return m.select("o_custkey", V.verdict(col("license"), col("overlap")).alias("verdict")).groupBy("o_custkey", "verdict").agg(F.count("*").alias("n"))


@q(f"SELECT o_custkey, bool_and(regexp_matches(lower(license), 'gpl|see|unclassified')) AS is_gpl, bool_or(contains(lower(license), 'lgpl')) AS is_lgpl FROM (SELECT {', '.join(_MATCH)} FROM orders) GROUP BY 1")
def native_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gpl only if every licence of every version says so."""
    m = table(spark, sf_dir, "orders").selectExpr(*_MATCH)
    return m.groupBy("o_custkey").agg(F.bool_and(F.lower("license").rlike("gpl|see|unclassified")).alias("is_gpl"), F.bool_or(F.lower("license").contains("lgpl")).alias("is_lgpl"))


# --- reports ---


@q(f"WITH {TOKENS_SQL} SELECT token, count(*) AS n_files, sum(freq)::BIGINT AS freq FROM feat GROUP BY 1")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and total frequency of each feature."""
    return features(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n_files"), F.sum("freq").alias("freq"))


@q(f"WITH {TOKENS_SQL} SELECT token, sum(freq)::BIGINT AS freq FROM feat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def popular_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent features."""
    return features(spark, sf_dir).groupBy("token").agg(F.sum("freq").alias("freq")).orderBy(col("freq").desc(), "token").limit(100)


@q(f"WITH {TOKENS_SQL} SELECT doc_id, token FROM feat WHERE token NOT IN (SELECT token FROM feat GROUP BY 1 HAVING count(*) > 20)")
def subtract_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features without those that many files share."""
    f = features(spark, sf_dir)
    common = f.groupBy("token").agg(F.count("*").alias("n")).where("n > 20").select("token")
    return f.select("doc_id", "token").join(common, "token", "left_anti")


@q(f"WITH {TOKENS_SQL}, c AS (SELECT token FROM feat GROUP BY 1 HAVING count(*) > 20) SELECT doc_id, count(*) AS n_all, count(*) FILTER (token IN (SELECT token FROM c)) AS n_common, count(*) FILTER (token LIKE 'th%' AND token NOT IN (SELECT token FROM c)) AS n_prefixed FROM feat GROUP BY 1")
def subtract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artifact's features, the common ones among them, and the rest with a prefix."""
    f = features(spark, sf_dir)
    common = f.groupBy("token").agg(F.count("*").alias("n")).where("n > 20").select("token", F.lit(True).alias("common"))
    j = f.join(common, "token", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    return j.groupBy("doc_id").agg(F.count("*").alias("n_all"), F.count_if("common").alias("n_common"), F.count_if(col("token").startswith("th") & ~col("common")).alias("n_prefixed"))


@q(f"WITH {TOKENS_SQL}, f AS (SELECT token, count(DISTINCT source) AS n_repos FROM feat GROUP BY 1) SELECT n_repos, count(*) AS n_features FROM f GROUP BY 1")
def freq_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by the number of repositories that have them."""
    per = features(spark, sf_dir).groupBy("token").agg(F.count_distinct("source").alias("n_repos"))
    return per.groupBy("n_repos").agg(F.count("*").alias("n_features"))


@q(f"WITH {TOKENS_SQL}, r AS (SELECT source, count(*) AS total, count(DISTINCT token) AS uniq FROM feat GROUP BY 1) SELECT source, total, uniq, round(uniq::DOUBLE / total, 6) AS ratio, least(floor(uniq::DOUBLE / total * 50)::INT + 1, 50) AS bucket FROM r")
def repo_unique_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct over total features of each repository, in fifty steps."""
    r = features(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), F.count_distinct("token").alias("uniq"))
    ratio = col("uniq") / col("total")
    return r.select("source", "total", "uniq", F.round(ratio, 6).alias("ratio"), F.least(F.floor(ratio * 50) + 1, F.lit(50)).cast("int").alias("bucket"))


@q("WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT v, n, round(sum(n) OVER (ORDER BY v)::DOUBLE / sum(n) OVER (), 6) AS cdf FROM c")
def cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution function of a measure over its distinct values, which are few."""
    c = table(spark, sf_dir, "lineitem").groupBy(col("l_quantity").alias("v")).agg(F.count("*").alias("n"))
    run = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("v", "n", F.round(F.sum("n").over(run) / F.sum("n").over(Window.partitionBy()), 6).alias("cdf"))


@q(f"WITH {EDGES_SQL} SELECT child_type, child_id, count(*) AS n_parents FROM edges GROUP BY 1, 2 HAVING count(*) > 1")
def shared_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with several parents."""
    return corpus_edges(spark, sf_dir).groupBy("child_type", "child_id").agg(F.count("*").alias("n_parents")).where("n_parents > 1")


@q(f"WITH {EDGES_SQL} SELECT parent_type AS kind, count(DISTINCT parent_id) AS n FROM edges GROUP BY 1")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind."""
    return corpus_edges(spark, sf_dir).groupBy(col("parent_type").alias("kind")).agg(F.count_distinct("parent_id").alias("n"))


@q("SELECT l_suppkey AS component, count(DISTINCT o_custkey) AS apps, count(*) AS files, count(*) FILTER (l_returnflag = 'A') AS so_files, max(l_quantity) AS best, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS best_file FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 5 GROUP BY 1")
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per component: apps, files by kind, and the best match."""
    j = table(spark, sf_dir, "lineitem").where("l_quantity >= 5").join(table(spark, sf_dir, "orders"), col("l_orderkey") == col("o_orderkey"))
    return j.groupBy(col("l_suppkey").alias("component")).agg(
        F.count_distinct("o_custkey").alias("apps"), F.count("*").alias("files"), F.count_if(col("l_returnflag") == "A").alias("so_files"),
        F.max("l_quantity").alias("best"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("best_file"))


@q("SELECT o_custkey AS app, l_suppkey AS component, max(l_extendedprice) AS score, count(DISTINCT l_orderkey) AS libs FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def apk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library results rolled up to apps."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = shares(spark, int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), LINE_BYTES)
    # a library is counted once for each app and component, so that nothing distinct is left to be counted after the join
    found = lines.select("l_orderkey", "l_suppkey", "l_extendedprice").repartition(n, "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    owners = orders.repartition(n, "o_orderkey").distinct()
    j = found.join(owners, col("l_orderkey") == col("o_orderkey")).select(col("o_custkey").alias("app"), col("l_suppkey").alias("component"), "score").repartition(n, "app", "component")
    return j.groupBy("app", "component").agg(F.max("score").alias("score"), F.count("*").alias("libs"))


@q("WITH a AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT count(*) AS apps, count(*) FILTER (n > 0) AS with_libs, round(avg(n) FILTER (n > 0), 6) AS libs_per_app, max(n) AS most FROM a")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apps, those with libraries, and libraries per app."""
    n = table(spark, sf_dir, "orders").groupBy(col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    a = table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left")
    return a.agg(F.count("*").alias("apps"), F.count("n").alias("with_libs"), F.round(F.avg("n"), 6).alias("libs_per_app"), F.max("n").alias("most"))


@q("WITH r AS (SELECT l_suppkey, l_partkey, l_extendedprice AS s, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS k FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_shipdate >= DATE '1995-01-01') SELECT l_suppkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS versions, max(s) AS score FROM r WHERE k = 1 GROUP BY 1")
def viewer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered matches; each component's best versions, ties together."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity BETWEEN 10 AND 40 AND l_shipdate >= '1995-01-01'")
    best = rows.groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    top = rows.join(best, "l_suppkey").where(col("l_extendedprice") == col("score"))
    return top.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("versions"), F.max("score").alias("score"))


_SNAP = "SELECT o_orderkey, o_orderstatus AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 10 <> 0", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE o_orderpriority END AS b FROM orders WHERE o_orderkey % 11 <> 0"


@q(f"WITH o AS ({_SNAP[0]}), n AS ({_SNAP[1]}), j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.a AS oa, n.a AS na, o.b AS ob, n.b AS nb FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey) "
   "SELECT o_orderkey, 'a' AS cell, oa AS old, na AS new FROM j WHERE oa IS DISTINCT FROM na UNION ALL SELECT o_orderkey, 'b', ob, nb FROM j WHERE ob IS DISTINCT FROM nb")  # fmt: skip
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that differ between two snapshots."""
    t = table(spark, sf_dir, "orders")
    old = t.where("o_orderkey % 10 <> 0").select("o_orderkey", col("o_orderstatus").alias("oa"), col("o_orderpriority").alias("ob"))
    new = t.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS na", "CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE o_orderpriority END AS nb")
    cells = old.join(new, "o_orderkey", "full").selectExpr("o_orderkey", "stack(2, 'a', oa, na, 'b', ob, nb) AS (cell, old, new)")
    return cells.where(~col("old").eqNullSafe(col("new")))


@q(f"WITH {TOKENS_SQL}, a AS (SELECT DISTINCT token FROM feat WHERE source = 'src1'), b AS (SELECT DISTINCT token FROM feat WHERE source = 'src2') SELECT coalesce(a.token, b.token) AS token, CASE WHEN b.token IS NULL THEN 'left' WHEN a.token IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.token = b.token")
def feature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of two dumps, with the side that has them."""
    f = features(spark, sf_dir)
    a, b = (f.where(col("source") == s).select("token", F.lit(True).alias(n)).groupBy("token").agg(F.first(n).alias(n)) for s, n in (("src1", "l"), ("src2", "r")))
    return a.join(b, "token", "full").select("token", F.when(col("r").isNull(), "left").when(col("l").isNull(), "right").otherwise("both").alias("side"))


@q("WITH e AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) "
   "SELECT user_id, before AS stage, count(*) AS n, (sum(epoch_us(ts) - epoch_us(prev)) // 1000000)::BIGINT AS seconds FROM e WHERE prev IS NOT NULL GROUP BY 1, 2")  # fmt: skip
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time spent in each stage, from the start of one log line to the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(col("ts").cast("timestamp")).alias("us"), F.lag("event_type").over(w).alias("stage"), F.lag(F.unix_micros(col("ts").cast("timestamp"))).over(w).alias("prev"))
    return e.where("prev IS NOT NULL").groupBy("user_id", "stage").agg(F.count("*").alias("n"), F.expr("sum(us - prev) div 1000000").alias("seconds"))


@q("SELECT p_type AS package, count(DISTINCT p_name) AS classes, count(*) FILTER (contains(p_brand, '1')) AS public_methods, count(DISTINCT p_brand) AS strings FROM part GROUP BY 1")
def api_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, public methods and strings of each package."""
    return table(spark, sf_dir, "part").groupBy(col("p_type").alias("package")).agg(F.count_distinct("p_name").alias("classes"), F.count_if(col("p_brand").contains("1")).alias("public_methods"), F.count_distinct("p_brand").alias("strings"))


@q("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS size, max(n_chars) AS largest FROM documents GROUP BY 1")
def sig_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sizes of each repository."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"), F.max("n_chars").alias("largest"))


@q("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def monitor_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by the hour."""
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(col("w.start").alias("start"), "event_type", "n", "total")


QUERIES, ORACLE = section.queries, section.oracle
