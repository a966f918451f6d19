"""Queries that match artifacts against the index, level by level and as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import match as M
from sedimark.operators.index import reference_counts
from sedimark.plans.base import Section
from sedimark.plans.indexing import EDGES_SQL, TYPE_SQL, _leaf_edges, _upper_edges, corpus_edges, features
from sedimark.session import materialize, once, table

section = Section()
q = section.add
col = F.col

#: Thresholds fit for passages: far fewer features than a library has.
P = M.Params(min_percent=8.0, low_score=0.05, accept_score=0.0001, min_features=1, min_functions=2)
LOOSE = M.Params(min_percent=2.0, low_score=0.02, accept_score=0.0001, min_features=1, min_functions=0)


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the text corpus."""
    docs = table(spark, sf_dir, "documents")
    sub = F.concat_ws("/", "source", "lang")
    files = features(spark, sf_dir).groupBy(col("doc_id").cast("string").alias("id")).agg(F.count("*").alias("u"))
    placed = docs.select(col("doc_id").cast("string").alias("id"), sub.alias("sub"), "source").join(files, "id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    uniq = (
        placed.select(F.lit("file").alias("child_type"), col("id").alias("child_id"), "u")
        .unionByName(placed.groupBy("sub").agg(F.sum("u").alias("u")).select(F.lit("dir").alias("child_type"), col("sub").alias("child_id"), "u"))
        .unionByName(placed.groupBy("source").agg(F.sum("u").alias("u")).select(F.lit("dir").alias("child_type"), col("source").alias("child_id"), "u"))
    )
    upper = _upper_edges(spark, sf_dir).join(uniq, ["child_type", "child_id"], "left").withColumn("uniq", F.coalesce("u", F.lit(1))).drop("u")
    edges = _leaf_edges(spark, sf_dir).withColumn("uniq", F.lit(1).cast("long")).unionByName(upper)
    file_nodes = docs.select(F.lit("file").alias("node_type"), col("doc_id").cast("string").alias("node_id"), F.when(col("doc_id") % 3 == 0, "C").otherwise("H").alias("filetype"), F.lit(False).alias("licensed"))
    dir_nodes = docs.select(F.lit("dir").alias("node_type"), sub.alias("node_id"), F.lit(None).cast("string").alias("filetype"), (sub == "src3/fr").alias("licensed")).distinct()
    return edges, file_nodes.unionByName(dir_nodes)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact, child_type, child_id of every benchmark item."""
    words = table(spark, sf_dir, "benchmark").select(col("item_id").alias("artifact"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    return words.select("artifact", F.expr(TYPE_SQL).alias("child_type"), col("token").alias("child_id")).distinct()


BASE_SQL = f"""{EDGES_SQL},
files AS (SELECT doc_id::VARCHAR AS id, count(*) AS u FROM feat GROUP BY 1),
placed AS (SELECT d.doc_id::VARCHAR AS id, concat_ws('/', d.source, d.lang) AS sub, d.source, coalesce(u, 0) AS u FROM documents d LEFT JOIN files f ON f.id = d.doc_id::VARCHAR),
uq AS (SELECT 'file' AS t, id, u::BIGINT AS u FROM placed UNION ALL SELECT 'dir', sub, sum(u)::BIGINT FROM placed GROUP BY sub UNION ALL SELECT 'dir', source, sum(u)::BIGINT FROM placed GROUP BY source),
e AS (SELECT child_type, child_id, parent_type, parent_id, coalesce(u, 1) AS uniq FROM edges LEFT JOIN uq ON t = child_type AND id = child_id WHERE parent_type <> 'repo'),
refs AS (SELECT child_type, child_id, count(DISTINCT (parent_type, parent_id)) AS refcnt FROM e GROUP BY 1, 2),
totals AS (SELECT child_type AS t, count(*) AS total FROM e GROUP BY 1),
nodes AS (SELECT 'file' AS nt, doc_id::VARCHAR AS ni, CASE WHEN doc_id % 3 = 0 THEN 'C' ELSE 'H' END AS filetype, false AS licensed FROM documents
  UNION ALL SELECT DISTINCT 'dir', concat_ws('/', source, lang), NULL, concat_ws('/', source, lang) = 'src3/fr' FROM documents),
w AS (SELECT e.*, refcnt, total, CASE WHEN refcnt > 0 AND total > 0 THEN ln(total / (1.0 + refcnt)) / nullif(ln(total / 2.0), 0) END AS idf
  FROM e LEFT JOIN refs USING (child_type, child_id) LEFT JOIN totals ON totals.t = e.parent_type),
q AS (SELECT DISTINCT artifact, {TYPE_SQL} AS child_type, token AS child_id FROM (SELECT item_id AS artifact, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM benchmark))"""
_G = ", ".join(f"g_{t}" for t in M.COUNTED)


def level0_sql(p: M.Params) -> str:
    counts = ", ".join(f"count(*) FILTER (child_type = '{t}') AS g_{t}" for t in M.COUNTED)
    return f"""per_file AS (SELECT parent_type, parent_id, count(*) AS kids, sum(idf) AS expected FROM w WHERE parent_type = 'file' GROUP BY 1, 2),
hits AS (SELECT artifact, parent_type, parent_id, count(*) AS freq, coalesce(sum(greatest(idf, 0)), 0) AS score, {counts} FROM q JOIN w USING (child_type, child_id) WHERE refcnt <= {p.popular} GROUP BY 1, 2, 3),
t0 AS (SELECT artifact, parent_type AS node_type, parent_id AS node_id, freq, kids AS cnt, freq AS gfreq, kids AS gcnt, score, coalesce(score / nullif(expected, 0), 0) AS norm, coalesce(refcnt, 0)::DOUBLE AS ref, {_G}
  FROM hits JOIN per_file USING (parent_type, parent_id) LEFT JOIN refs ON refs.child_type = parent_type AND refs.child_id = parent_id WHERE 100.0 * freq / kids >= {p.min_percent})"""


def level_sql(k: int, p: M.Params) -> str:
    """Level ``k`` from level ``k - 1``; on this corpus a node belongs to one level only."""
    g = ", ".join(f"coalesce(t.g_{t}, 0) AS g_{t}" for t in M.COUNTED)
    live = ", ".join(f"sum(CASE WHEN out THEN 0 ELSE g_{t} END)::BIGINT AS g_{t}" for t in M.COUNTED)
    rules = {
        1: f"(child_type = 'file' AND coalesce(filetype IN ('C', 'CPP'), false) AND g_func + g_funcname < {p.min_functions})",
        2: "(child_type = 'dir' AND coalesce(licensed, false))",
        3: f"(n >= 2 AND r >= {p.refcnt_ratio} * (sum_r - r) / nullif(n - 1, 0))",
        4: f"(coalesce(gf / nullif(gc, 0)::DOUBLE, 0) <= {p.min_grouped})",
    }
    return f"""s{k} AS (SELECT artifact, t.node_type, t.node_id, t.ref FROM t{k - 1} t LEFT JOIN nodes ON nt = node_type AND ni = node_id WHERE norm > {p.low_score} AND NOT (node_type = 'dir' AND coalesce(licensed, false))),
p{k} AS (SELECT artifact, parent_type, parent_id, avg(ref) AS mean_ref FROM s{k} JOIN w ON child_type = node_type AND child_id = node_id GROUP BY 1, 2, 3),
k{k} AS (SELECT p{k}.artifact, w.*, mean_ref, filetype, licensed, coalesce(t.freq, 0) AS f, coalesce(t.gfreq, 0) AS gf, coalesce(t.gcnt, uniq) AS gc, coalesce(t.ref, refcnt, 0)::DOUBLE AS r, {g}
  FROM p{k} JOIN w USING (parent_type, parent_id) LEFT JOIN nodes ON nt = child_type AND ni = child_id LEFT JOIN t{k - 1} t ON t.artifact = p{k}.artifact AND t.node_type = child_type AND t.node_id = child_id),
n{k} AS (SELECT *, count(*) OVER x AS n, sum(r) OVER x AS sum_r FROM k{k} WINDOW x AS (PARTITION BY artifact, parent_type, parent_id)),
o{k} AS (SELECT *, coalesce({' OR '.join(rules[i] for i in p.rules)}, false) AS out FROM n{k}),
a{k} AS (SELECT artifact, parent_type, parent_id, sum(greatest(f, 0))::BIGINT AS freq, sum(uniq)::BIGINT AS cnt, sum(gf - CASE WHEN out THEN f ELSE 0 END)::BIGINT AS gfreq, sum(CASE WHEN out THEN 0 ELSE gc END)::BIGINT AS gcnt,
  coalesce(sum(CASE WHEN out THEN 0 ELSE greatest(gf * idf, 0) END), 0) AS score, sum(CASE WHEN out THEN 0 ELSE gc * idf END) AS expected, {live}, any_value(mean_ref) AS mean_ref FROM o{k} GROUP BY 1, 2, 3),
t{k} AS (SELECT artifact, parent_type AS node_type, parent_id AS node_id, freq, cnt, gfreq, gcnt, score, coalesce(score / nullif(expected, 0), 0) AS norm, coalesce(refcnt, 0) + mean_ref AS ref, {_G}
  FROM a{k} LEFT JOIN refs ON refs.child_type = parent_type AND refs.child_id = parent_id)"""


def search_sql(p: M.Params) -> str:
    return f"WITH {BASE_SQL}, {level0_sql(p)}, {level_sql(1, p)}, {level_sql(2, p)}"


_TREE_OUT = f"artifact, node_type, node_id, freq, cnt, gfreq, gcnt, round(score, 6) AS score, round(norm, 6) AS norm, round(ref, 6) AS ref, {_G}"


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def index_of(spark: SparkSession, sf_dir: str) -> M.Index:
    """The text corpus's index, built by the first query that needs it."""
    return once(spark, sf_dir, "documents", "index", lambda: M.build_index(*corpus(spark, sf_dir), corpus_edges(spark, sf_dir, True)))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, M.Index]:
    return passages(spark, sf_dir), index_of(spark, sf_dir)


@q("SELECT n AS total, k AS matching, round(CASE WHEN n > 0 THEN ln(n / (1.0 + k)) END, 6) AS idf FROM (SELECT p_partkey AS n, p_size::BIGINT AS k FROM part)")
def idf_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain inverse document frequency."""
    p = table(spark, sf_dir, "part").select(col("p_partkey").alias("total"), col("p_size").cast("long").alias("matching"))
    return p.select("total", "matching", F.round(M.idf(col("total"), col("matching")), 6).alias("idf"))


@q("SELECT o_orderkey, round((l.q / s.total) * ln(s.n / (1.0 + l.m)), 6) AS tfidf FROM (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS q, count(*) AS m FROM lineitem GROUP BY 1) l, (SELECT sum(l_quantity) AS total, count(DISTINCT l_orderkey) AS n FROM lineitem) s")
def tfidf_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency by a repository's total, times the inverse document frequency."""
    li = table(spark, sf_dir, "lineitem")
    one = li.agg(F.sum("l_quantity").alias("total"), F.count_distinct("l_orderkey").alias("n"))  # a single row
    per = li.groupBy(col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("m"))
    return per.join(F.broadcast(one)).select("o_orderkey", F.round(col("q") / col("total") * M.idf(col("n"), col("m")), 6).alias("tfidf"))


@q(f"WITH {BASE_SQL} SELECT child_type, child_id, parent_type, min(refcnt) AS refcnt, round(min(idf), 6) AS idf FROM w GROUP BY 1, 2, 3")
def child_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child's normalised idf under each type of parent."""
    w = index_of(spark, sf_dir).weighted
    return w.groupBy("child_type", "child_id", "parent_type").agg(F.min("refcnt").alias("refcnt"), F.round(F.min("idf"), 6).alias("idf"))


@q(f"WITH {BASE_SQL} SELECT artifact, parent_id, count(*) AS matched FROM q JOIN w USING (child_type, child_id) GROUP BY 1, 2")
def match_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted-index look-up: features to the files that have them."""
    query, index = _parts(spark, sf_dir)
    return M.hits(query, index.weighted).groupBy("artifact", "parent_id").agg(F.count("*").alias("matched"))


@q(f"WITH {BASE_SQL} SELECT child_type, child_id, refcnt FROM refs WHERE refcnt > 200")
def popular_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features too popular to be followed."""
    return reference_counts(corpus_edges(spark, sf_dir, True), True).where("refcnt > 200")


@q(f"WITH {BASE_SQL}, {level0_sql(P)} SELECT artifact, node_id, freq, cnt FROM t0")
def ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which a large enough share is matched."""
    return M.leaf_level(*_parts(spark, sf_dir), P).select("artifact", "node_id", "freq", "cnt")


@q(f"WITH {BASE_SQL}, {level0_sql(LOOSE)}, m AS (SELECT DISTINCT artifact, node_id FROM t0), k AS (SELECT artifact, node_id, w.child_type, w.child_id FROM m JOIN w ON w.parent_type = 'file' AND w.parent_id = m.node_id) "
   "SELECT k.artifact, k.node_id, count(*) FILTER (q.child_id IS NULL) AS unmatched, count(*) AS kids FROM k LEFT JOIN q ON q.artifact = k.artifact AND q.child_type = k.child_type AND q.child_id = k.child_id GROUP BY 1, 2")  # fmt: skip
def unmatched_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All children of the matched files, and how many of them aren't matched."""
    query, index = _parts(spark, sf_dir)
    files = M.leaf_level(query, index, LOOSE).select("artifact", "node_id")
    kids = files.join(index.weighted.where("parent_type = 'file'").select(col("parent_id").alias("node_id"), "child_type", "child_id"), "node_id")
    joined = kids.join(query.withColumn("hit", F.lit(1)), ["artifact", "child_type", "child_id"], "left")
    return joined.groupBy("artifact", "node_id").agg(F.count_if(col("hit").isNull()).alias("unmatched"), F.count("*").alias("kids"))


def _one_level(p: M.Params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query, index = _parts(spark, sf_dir)
        leaf = materialize(M.leaf_level(query, index, p), "level")
        return M.dir_level(leaf.where(col("norm") > p.low_score), leaf, index, p, 1)

    return run


def _level1_sql(p: M.Params, out: str) -> str:
    return f"WITH {BASE_SQL}, {level0_sql(p)}, {level_sql(1, p)} SELECT {out} FROM t1"


def _with_rules(*rules: int) -> M.Params:
    return M.Params(**{**P.__dict__, "rules": rules, "low_score": 0.03, "min_percent": 4.0})


q(_level1_sql(_with_rules(4), "artifact, node_id, freq, cnt"), "parent_counts")(lambda s, d: _one_level(_with_rules(4))(s, d).select("artifact", "node_id", "freq", "cnt"))
q(_level1_sql(_with_rules(4), "artifact, node_id, round(ref, 6) AS ref"), "refcnt_propagation")(lambda s, d: _round(_one_level(_with_rules(4))(s, d).select("artifact", "node_id", "ref"), "ref"))
q(_level1_sql(_with_rules(4), f"artifact, node_id, gfreq, gcnt, {_G}"), "grouped_counts")(lambda s, d: _one_level(_with_rules(4))(s, d).select("artifact", "node_id", "gfreq", "gcnt", *[f"g_{t}" for t in M.COUNTED]))
for _name, _rule in (("rule_no_func", 1), ("rule_licensed_dir", 2), ("rule_popular_child", 3), ("rule_low_ratio", 4)):
    q(_level1_sql(_with_rules(_rule), "artifact, node_id, gfreq, gcnt, round(norm, 6) AS norm"), _name)(
        lambda s, d, r=_rule: _round(_one_level(_with_rules(r))(s, d).select("artifact", "node_id", "gfreq", "gcnt", "norm"), "norm"))


@q(f"WITH {BASE_SQL}, {level0_sql(P)} SELECT artifact, node_id, freq, cnt, round(score, 6) AS score, round(norm, 6) AS norm FROM t0 WHERE norm > {P.low_score}")
def filter_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose normalised score lets them climb."""
    return _round(M.leaf_level(*_parts(spark, sf_dir), P).where(col("norm") > P.low_score).select("artifact", "node_id", "freq", "cnt", "score", "norm"), "score", "norm")


def _tree(p: M.Params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return M.search(*_parts(spark, sf_dir), p)

    return run


_ALL = "(SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)"
q(f"{search_sql(P)} SELECT {_TREE_OUT} FROM {_ALL}", "search_full")(lambda s, d: _round(_tree(P)(s, d)[0].drop("level"), "score", "norm", "ref"))


def _accept_sql(p: M.Params) -> str:
    return f"""{search_sql(p)}, roots AS (SELECT artifact, concat('repo:', node_id) AS root, gfreq AS featfreq, gcnt AS featcnt, score, norm, {_G} FROM t2
  WHERE norm > {p.low_score} AND gcnt >= {p.min_features} AND g_func + g_funcname >= {p.min_functions} AND norm >= {p.accept_score})"""


_ROOT_OUT = f"artifact, root, featfreq, featcnt, round(score, 6) AS score, round(norm, 6) AS norm, {_G}"
_EASY = M.Params(**{**LOOSE.__dict__, "rules": (2, 4), "low_score": 0.01})
q(f"{_accept_sql(_EASY)} SELECT {_ROOT_OUT} FROM roots", "accept_repos")(lambda s, d: _round(_tree(_EASY)(s, d)[1].drop("root_type"), "score", "norm"))


@q(f"{_accept_sql(_EASY)}, r AS (SELECT artifact, root, round(score, 6) AS score, row_number() OVER (PARTITION BY artifact ORDER BY round(score, 6) DESC, root) AS rank FROM roots) SELECT artifact, root, score, rank::INT AS rank FROM r")
def rank_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact's components by falling score."""
    roots = _round(_tree(_EASY)(spark, sf_dir)[1], "score").select("artifact", "root", "score")
    return M.top_versions(roots, ["artifact"], [col("score").desc(), col("root")], 1 << 30)


@q(f"{_accept_sql(_EASY)}, r AS (SELECT artifact, root, round(score, 6) AS score, row_number() OVER (PARTITION BY artifact ORDER BY round(score, 6) DESC, root) AS rank FROM roots) SELECT artifact, root, score, rank::INT AS rank FROM r WHERE rank <= 5")
def topk_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each artifact."""
    roots = _round(_tree(_EASY)(spark, sf_dir)[1], "score").select("artifact", "root", "score")
    return M.top_versions(roots, ["artifact"], [col("score").desc(), col("root")], 5)


_NATIVE_SQL = f"{_accept_sql(_EASY)} SELECT artifact, replace(root, 'repo:', '') AS component, featfreq, featcnt, round(norm, 6) AS norm, 'native' AS kind FROM roots"


def _drive(kind: str, p: M.Params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        roots = _tree(p)(spark, sf_dir)[1]
        return _round(roots.select("artifact", F.replace("root", F.lit("repo:"), F.lit("")).alias("component"), "featfreq", "featcnt", "norm", F.lit(kind).alias("kind")), "norm")

    return run


#: Java artifacts: a larger share of a file must match, and the rules on functions and low shares are off.
_JAVA = M.Params(**{**_EASY.__dict__, "rules": (2, 3), "min_percent": 4.0})
_JAVA_SQL = _NATIVE_SQL.replace(_accept_sql(_EASY), _accept_sql(_JAVA)).replace("'native'", "'java'")
q(_NATIVE_SQL, "native_search")(_drive("native", _EASY))
q(_JAVA_SQL, "java_search")(_drive("java", _JAVA))


@q(f"SELECT artifact % 7 AS app, component, kind, max(norm) AS norm, count(*) AS n_artifacts FROM ((SELECT * FROM ({_NATIVE_SQL})) UNION ALL (SELECT * FROM ({_JAVA_SQL}))) GROUP BY 1, 2, 3")
def app_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An app's libraries and its own code, searched apart and put together."""
    both = _drive("native", _EASY)(spark, sf_dir).unionByName(_drive("java", _JAVA)(spark, sf_dir))
    return both.groupBy((col("artifact") % 7).alias("app"), "component", "kind").agg(F.max("norm").alias("norm"), F.count("*").alias("n_artifacts"))


@q(f"WITH {EDGES_SQL} SELECT source, string_agg(DISTINCT {TYPE_SQL}, ',' ORDER BY {TYPE_SQL}) AS types, count(DISTINCT token) AS n FROM feat WHERE {TYPE_SQL} IN ('str', 'func') GROUP BY 1")
def combine_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the requested types only."""
    f = features(spark, sf_dir).withColumn("t", F.expr(TYPE_SQL)).where("t IN ('str', 'func')")
    return f.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("types"), F.count_distinct("token").alias("n"))


@q(f"WITH {BASE_SQL}, b AS (SELECT source, count(DISTINCT token) AS n FROM feat WHERE {TYPE_SQL} = 'func' GROUP BY 1), h AS (SELECT artifact, source, count(DISTINCT token) AS k FROM q JOIN feat ON token = child_id WHERE child_type = 'func' GROUP BY 1, 2) "
   "SELECT artifact, source, k AS shared, round(k::DOUBLE / n, 6) AS overlap FROM h JOIN b USING (source)")  # fmt: skip
def lgpl_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a component's features of one type that an artifact has."""
    f = features(spark, sf_dir).where(F.expr(TYPE_SQL) == "func").select("source", "token").distinct()
    size = f.groupBy("source").agg(F.count("*").alias("n"))
    hit = passages(spark, sf_dir).where("child_type = 'func'").select("artifact", col("child_id").alias("token")).join(f, "token").groupBy("artifact", "source").agg(F.count("*").alias("shared"))
    return hit.join(size, "source").select("artifact", "source", "shared", F.round(col("shared") / col("n"), 6).alias("overlap"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark passage, the files that match it best by normalised score, and their source."""
    tree, _ = M.search(*_parts(spark, sf_dir), M.Params(**{**LOOSE.__dict__, "low_score": 0.1}))
    files = tree.where("node_type = 'file'").select("artifact", col("node_id").alias("doc_id"), "freq", "cnt", F.round("norm", 6).alias("norm"))
    best = M.top_versions(files, ["artifact"], [col("norm").desc(), col("doc_id")], 5)
    docs = table(spark, sf_dir, "documents").select(col("doc_id").cast("string").alias("doc_id"), "source")
    return best.join(docs, "doc_id").select("artifact", "rank", "doc_id", "source", "freq", "cnt", "norm")


QUERIES, ORACLE = section.queries, section.oracle
