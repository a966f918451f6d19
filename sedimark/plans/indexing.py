"""Queries that build an index, and catalogue and file queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions import hashing as H
from sedimark.functions import scalar as S
from sedimark.operators import index as I
from sedimark.plans.base import TOKENS_SQL, Section
from sedimark.session import bucketed, materialize, new_path, once, shares, table
from sedimark.sources import files

section = Section()
q = section.add
col = F.col

#: The text corpus's feature types, by a token's length.
TYPE_SQL = "CASE length(token) % 3 WHEN 0 THEN 'str' WHEN 1 THEN 'func' ELSE 'funcname' END"

#: Bytes of documents, as stored, in one bucket of features.
FEATURE_BYTES = 8_000_000


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, doc_id, token, freq: the text corpus's features, words of ASCII letters as in a feature list; written once.

    Texts are dealt by file before they are cut into words, so that no word is moved, and what is asked of files moves nothing.
    """

    def build() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        n = shares(spark, int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), FEATURE_BYTES)
        docs = docs.select("source", "lang", "doc_id", "text").repartition(n, "doc_id")
        words = docs.select("source", "lang", "doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
        return bucketed(words.groupBy("source", "lang", "doc_id", "token").agg(F.count("*").alias("freq")), "features", ["doc_id"], n, there=True)

    return once(spark, sf_dir, "documents", "features", build)


def corpus_edges(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    """child_type, child_id, parent_type, parent_id of the text corpus: token, document, source/language, source, repository.

    ``distinct`` edges cost no shuffle of the features, as these lie in buckets by document.
    """
    leaf, upper = _leaf_edges(spark, sf_dir, distinct), _upper_edges(spark, sf_dir)
    return leaf.unionByName(upper.distinct() if distinct else upper)


def _leaf_edges(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    f = features(spark, sf_dir).select("token", "doc_id")
    f = f.distinct() if distinct else f
    return f.select(F.expr(TYPE_SQL).alias("child_type"), col("token").alias("child_id"), F.lit("file").alias("parent_type"), col("doc_id").cast("string").alias("parent_id"))


def _upper_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sub = F.concat_ws("/", "source", "lang")
    files = docs.select(F.lit("file").alias("child_type"), col("doc_id").cast("string").alias("child_id"), F.lit("dir").alias("parent_type"), sub.alias("parent_id"))
    dirs = docs.select(F.lit("dir").alias("child_type"), sub.alias("child_id"), F.lit("dir").alias("parent_type"), col("source").alias("parent_id")).distinct()
    roots = docs.select(F.lit("dir").alias("child_type"), col("source").alias("child_id"), F.lit("repo").alias("parent_type"), F.concat(F.lit("repo:"), "source").alias("parent_id")).distinct()
    return files.unionByName(dirs).unionByName(roots)


EDGES_SQL = f"""{TOKENS_SQL},
edges AS (SELECT {TYPE_SQL} AS child_type, token AS child_id, 'file' AS parent_type, doc_id::VARCHAR AS parent_id FROM feat
  UNION ALL SELECT 'file', doc_id::VARCHAR, 'dir', concat_ws('/', source, lang) FROM documents
  UNION ALL SELECT DISTINCT 'dir', concat_ws('/', source, lang), 'dir', source FROM documents
  UNION ALL SELECT DISTINCT 'dir', source, 'repo', concat('repo:', source) FROM documents)"""

# --- files, catalogue, artifact lists ---

_FILE = "concat('d', cast(l_suppkey % 13 AS string), '/s', cast(l_linenumber AS string), '/f', cast(l_partkey % 50 AS string), CASE WHEN l_partkey % 3 = 0 THEN '.c' ELSE '.txt' END)"


@q(f"SELECT regexp_extract(p, '([^/]*)$', 1) AS name, max(p) AS path FROM (SELECT {_FILE} AS p FROM lineitem) GROUP BY 1")
def scan_unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path for each base name, the last in order."""
    p = table(spark, sf_dir, "lineitem").selectExpr(f"{_FILE} AS path")
    return p.groupBy(S.basename(col("path")).alias("name")).agg(F.max("path").alias("path"))


_TREE = ["l_suppkey", "concat(CASE WHEN l_suppkey % 4 = 0 OR l_linenumber % 2 = 0 THEN 'external/' ELSE 'src/' END, 'f', cast(l_partkey AS string), CASE WHEN l_partkey % 2 = 0 THEN '.c' ELSE '.md' END) AS path"]


@q(f"WITH t AS (SELECT DISTINCT l_suppkey, path, regexp_matches(path, '^external/') AS third FROM (SELECT {', '.join(_TREE)} FROM lineitem) WHERE path LIKE '%.c'), "
   "w AS (SELECT *, count(*) FILTER (NOT third) OVER (PARTITION BY l_suppkey) AS own FROM t) SELECT l_suppkey, path FROM w WHERE NOT third OR own = 0")  # fmt: skip
def src_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files outside third-party directories; all source files of a repository that has no others."""
    files = table(spark, sf_dir, "lineitem").selectExpr(*_TREE).where(S.file_kind(col("path")).isNotNull()).distinct().withColumn("third", S.is_third_party(col("path")))
    own = files.groupBy("l_suppkey").agg(F.count_if(~col("third")).alias("own"))
    return files.join(own, "l_suppkey").where(~col("third") | (col("own") == 0)).select("l_suppkey", "path")


@q("SELECT page_id, url AS input_path FROM pages")
def csv_alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV list whose path column goes by one of several names: the first known one counts."""
    path = f"{new_path(spark, 'list')}/pages.csv"
    files.write_dump(table(spark, sf_dir, "pages").select("page_id", col("url").alias("input_path"), col("url").alias("other")), path)
    return files.read_artifact_list(spark, path, ["page_id"]).select(col("page_id").cast("long").alias("page_id"), "input_path")


@q("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def sig_cache_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts without a cached signature."""
    done = table(spark, sf_dir, "orders").select(col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(done, "c_custkey", "left_anti")


@q("SELECT l_partkey AS digest, min(l_shipdate) AS first_seen, count(*) AS n_paths FROM lineitem GROUP BY 1")
def component_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by digest, each once."""
    return table(spark, sf_dir, "lineitem").groupBy(col("l_partkey").alias("digest")).agg(F.min("l_shipdate").alias("first_seen"), F.count("*").alias("n_paths"))


@q("SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'mime' WHEN grouping(l_linestatus) = 0 THEN 'suffix' ELSE 'dir' END AS kind, "
   "coalesce(l_returnflag, l_linestatus, cast(l_linenumber AS VARCHAR)) AS label, round(sum(l_quantity), 2) AS size FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))")  # fmt: skip
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by type, suffix and directory in one pass."""
    rows = table(spark, sf_dir, "lineitem").select(col("l_returnflag").alias("m"), col("l_linestatus").alias("s"), col("l_linenumber").cast("string").alias("d"), "l_quantity")
    sets = rows.groupingSets([["m"], ["s"], ["d"]], "m", "s", "d").agg(F.round(F.sum("l_quantity"), 2).alias("size"), F.grouping_id().alias("g"))
    kind = F.when(col("g") == 3, "mime").when(col("g") == 5, "suffix").otherwise("dir")
    return sets.select(kind.alias("kind"), F.coalesce("m", "s", "d").alias("label"), "size")


@q("SELECT o_custkey AS app, count(DISTINCT l_partkey) AS n_components, count(DISTINCT l_suppkey) FILTER (l_suppkey % 2 = 0) AS so_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def app_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct components and shared libraries of each app."""
    bridge = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), col("l_orderkey") == col("o_orderkey")).select(col("o_custkey").alias("app"), "l_partkey", "l_suppkey")
    return bridge.groupBy("app").agg(F.count_distinct("l_partkey").alias("n_components"), F.count_distinct(F.when(col("l_suppkey") % 2 == 0, col("l_suppkey"))).alias("so_count"))


@q("SELECT 'a' AS db, s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0 UNION ALL SELECT 'b', c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0")
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality look-up over several catalogues."""
    s = table(spark, sf_dir, "supplier").where("s_nationkey = 3 AND s_acctbal > 0").select(F.lit("a").alias("db"), col("s_suppkey").alias("id"), col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3 AND c_acctbal > 0").select(F.lit("b").alias("db"), col("c_custkey").alias("id"), col("c_name").alias("name"))
    return s.unionByName(c)


@q("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey = 7 GROUP BY 1")
def catalog_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a catalogue that meet a condition."""
    return table(spark, sf_dir, "customer").where("c_nationkey = 7").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@q("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def migrate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a source that the destination lacks."""
    have = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").join(have, "o_orderkey", "left_anti")


@q("SELECT l_orderkey, l_linenumber, l_partkey % 3 - 1 AS cnt FROM lineitem WHERE NOT (l_linestatus = 'F' AND l_partkey % 3 - 1 <= 0)")
def edge_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without those to files and directories whose count isn't positive."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", (col("l_partkey") % 3 - 1).alias("cnt"))
    return rows.where(~((col("l_linestatus") == "F") & (col("cnt") <= 0))).drop("l_linestatus")


@q("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def sample_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed random sample: the first hundred by a hash."""
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy(F.md5(col("o_orderkey").cast("string")), "o_orderkey").limit(100)


@q("SELECT s_suppkey, ntile(4) OVER (ORDER BY md5(s_suppkey::VARCHAR), s_suppkey) AS shard FROM supplier")
def shard_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list dealt into four equal shares in a shuffled order."""
    ids = table(spark, sf_dir, "supplier").select("s_suppkey", F.md5(col("s_suppkey").cast("string")).alias("m"))
    return I.dealt(ids, ["m", "s_suppkey"], 4, "shard").select("s_suppkey", "shard")


@q("SELECT event_id, user_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND f.value > 60)")
def skip_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that weren't processed or failed before."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type <> 'error'").select("event_id", "user_id").join(e.where("event_type = 'error' AND value > 60").select("user_id"), "user_id", "left_anti")


@q("SELECT page_id, sha256(html) AS digest, strlen(html)::BIGINT AS size FROM pages")
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and sizes of contents."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))


_SDK = "concat('{\"sdk', cast(s_suppkey AS string), '\": [\"url\", \"a', cast(s_nationkey AS string), '\", \"b', cast(s_suppkey AS string), '\"]}')"


@q("SELECT concat('sdk', s_suppkey::VARCHAR) AS sdk, unnest([concat('a', s_nationkey::VARCHAR), concat('b', s_suppkey::VARCHAR)]) AS artifact FROM supplier")
def sdk_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON map of name to list: the list's tail, one row each."""
    m = table(spark, sf_dir, "supplier").select(F.from_json(F.expr(_SDK), "map<string,array<string>>").alias("m")).select(F.explode("m").alias("sdk", "v"))
    return m.select("sdk", F.explode(F.slice("v", F.lit(2), F.size("v"))).alias("artifact"))


@q("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS so, count(*) FILTER (l_returnflag = 'R') AS dex, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS all_ids FROM lineitem GROUP BY 1")
def components_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each app, parted by type."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(col("l_returnflag") == "A").alias("so"), F.count_if(col("l_returnflag") == "R").alias("dex"), ids.alias("all_ids"))


@q("SELECT s.s_suppkey AS lib, coalesce(n.n_name, c.c_name) AS identity, CASE WHEN n.n_nationkey IS NOT NULL THEN 1 ELSE 2 END AS source FROM supplier s "
   "LEFT JOIN nation n ON s.s_suppkey = n.n_nationkey LEFT JOIN customer c ON s.s_suppkey = c.c_custkey")  # fmt: skip
def software_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact's identity from the first catalogue that knows it."""
    s = table(spark, sf_dir, "supplier").select(col("s_suppkey").alias("lib"))
    n = table(spark, sf_dir, "nation").select(col("n_nationkey").cast("long").alias("lib"), "n_name")
    c = table(spark, sf_dir, "customer").select(col("c_custkey").alias("lib"), "c_name")
    return s.join(n, "lib", "left").join(c, "lib", "left").select("lib", F.coalesce("n_name", "c_name").alias("identity"), F.when(col("n_name").isNotNull(), 1).otherwise(2).alias("source"))


@q(f"WITH {TOKENS_SQL} SELECT doc_id, count(*) FILTER (token IN ('the', 'and', 'que', 'der')) AS distinct_calls, coalesce(sum(freq) FILTER (token IN ('the', 'and', 'que', 'der')), 0)::BIGINT AS calls FROM feat GROUP BY 1")
def syscall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to a list of known calls, per file."""
    known = col("token").isin("the", "and", "que", "der")
    return features(spark, sf_dir).groupBy("doc_id").agg(F.count_if(known).alias("distinct_calls"), F.coalesce(F.sum(F.when(known, col("freq"))), F.lit(0)).alias("calls"))


@q("SELECT user_id, count(*) AS calls FROM events WHERE contains(props, '(') OR (event_type <> 'error' AND NOT contains(event_type, 'view')) GROUP BY 1")
def export_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that are calls and neither static nor private, per file."""
    fit = F.contains("props", F.lit("(")) | ((col("event_type") != "error") & ~F.contains("event_type", F.lit("view")))
    return table(spark, sf_dir, "events").where(fit).groupBy("user_id").agg(F.count("*").alias("calls"))


@q("SELECT e.event_id, CASE event_type WHEN 'error' THEN 'LOG' WHEN 'click' THEN 'TOUCH' END AS permission FROM events e")
def api_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call's permission by a small map."""
    m = spark.sql("SELECT * FROM VALUES ('error', 'LOG'), ('click', 'TOUCH') AS t(event_type, permission)")
    return table(spark, sf_dir, "events").select("event_id", "event_type").join(F.broadcast(m), "event_type", "left").select("event_id", "permission")


@q(f"WITH {TOKENS_SQL} SELECT doc_id, coalesce(sum(freq) FILTER (t = 'str'), 0)::BIGINT + coalesce(sum(freq) FILTER (t = 'func'), 0)::BIGINT AS featcnt, count(*) FILTER (t IN ('str', 'func')) AS uniqfeatcnt "
   f"FROM (SELECT *, {TYPE_SQL} AS t FROM feat) GROUP BY 1")  # fmt: skip
def featcnt_by_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters summed over the searched types only."""
    c = I.file_counters(features(spark, sf_dir).withColumn("t", F.expr(TYPE_SQL)), ["doc_id"], "t", "freq", ["str", "func", "funcname"])
    return c.select("doc_id", (col("str_total") + col("func_total")).alias("featcnt"), (col("str_unique") + col("func_unique")).alias("uniqfeatcnt"))


# --- index ---


@q(f"WITH {TOKENS_SQL}, t AS (SELECT *, {TYPE_SQL} AS t FROM feat) SELECT doc_id, " + ", ".join(
    f"coalesce(sum(freq) FILTER (t = '{t}'), 0)::BIGINT AS {t}_total, count(*) FILTER (t = '{t}') AS {t}_unique" for t in ("str", "func", "funcname")) + " FROM t GROUP BY 1")
def file_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and distinct features of each type, per file."""
    return I.file_counters(features(spark, sf_dir).withColumn("t", F.expr(TYPE_SQL)), ["doc_id"], "t", "freq", ["str", "func", "funcname"])


_SIMHASH_SQL = f"""{TOKENS_SQL}, k AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(token), 17, 16))::UBIGINT AS h FROM feat),
simhash AS (SELECT doc_id, bit_or(CASE WHEN s > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END) AS v FROM
  (SELECT doc_id, i, sum(((h >> i::UBIGINT) & 1::UBIGINT)::INT * 2 - 1) AS s FROM k, range(64) t(i) GROUP BY doc_id, i) GROUP BY doc_id)"""


def _simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, simhash of each file's features; written once, as it is joined with itself."""
    return once(spark, sf_dir, "documents", "simhash", lambda: materialize(H.simhash(features(spark, sf_dir), ["doc_id"], "token"), "simhash"))


@q(f"WITH {_SIMHASH_SQL} SELECT doc_id, printf('%016x', v) AS simhash FROM simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash of each file's features."""
    return _simhashes(spark, sf_dir).select("doc_id", H.hex64(col("simhash")).alias("simhash"))


@q(f"WITH {_SIMHASH_SQL} SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.v, b.v)::UBIGINT)::INT AS distance FROM simhash a JOIN simhash b ON b.doc_id = a.doc_id + 1")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance between each file's SimHash and the next one's."""
    s = _simhashes(spark, sf_dir)
    nxt = s.select((col("doc_id") - 1).alias("doc_id"), col("simhash").alias("other"))
    return s.join(nxt, "doc_id").select(col("doc_id").alias("a"), (col("doc_id") + 1).alias("b"), H.hamming(col("simhash"), col("other")).cast("int").alias("distance"))


@q(f"WITH {_SIMHASH_SQL} SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.v, b.v)::UBIGINT)::INT AS distance FROM simhash a JOIN simhash b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.v, b.v)::UBIGINT) <= 5")
def simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of files within five bits, by chunks that are equal."""
    s = _simhashes(spark, sf_dir)
    return H.hamming_join(s, s, "doc_id", "doc_id").where("a < b")


_NEAR_SQL = f"""{_SIMHASH_SQL}, close AS (SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.v, b.v)::UBIGINT)::INT AS distance FROM simhash a JOIN simhash b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.v, b.v)::UBIGINT) <= 5),
rare AS (SELECT token FROM feat GROUP BY token HAVING count(*) <= 2000), near AS (SELECT a, b, distance FROM close WHERE EXISTS (SELECT 1 FROM feat x JOIN feat y ON x.token = y.token JOIN rare ON rare.token = x.token WHERE x.doc_id = close.a AND y.doc_id = close.b))"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = features(spark, sf_dir).select(col("token").alias("child_id"), "doc_id").join(_simhashes(spark, sf_dir), "doc_id").withColumnRenamed("doc_id", "parent_id")
    return I.near_pairs_by_child(e, "simhash", 5)


@q(f"WITH {_NEAR_SQL} SELECT a, b, distance FROM near")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that share a feature of at most 2000 files and differ in five bits at most."""
    return _near(spark, sf_dir)


@q(f"WITH {_NEAR_SQL} SELECT d.doc_id AS node, coalesce(min(n.a), d.doc_id) AS canonical FROM documents d LEFT JOIN near n ON n.b = d.doc_id AND n.a NOT IN (SELECT b FROM near) GROUP BY d.doc_id")
def canonical_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's leader: the smallest near file that has no smaller near file itself; no chains."""
    near = _near(spark, sf_dir).select("a", "b")
    leaders = near.join(near.select(col("b").alias("a")).distinct(), "a", "left_anti")
    best = leaders.groupBy(col("b").alias("node")).agg(F.min("a").alias("c"))
    return table(spark, sf_dir, "documents").select(col("doc_id").alias("node")).join(best, "node", "left").select("node", F.coalesce("c", "node").alias("canonical"))


@q("WITH v AS (SELECT l_suppkey, l_partkey % 20 AS node, sum(l_quantity)::DOUBLE AS votes FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_max(node, (votes, -node)) AS node, max(votes) AS votes FROM v GROUP BY 1")
def node_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a node's candidate ids, that which most of its children's totals name."""
    return I.best_candidate(table(spark, sf_dir, "lineitem").withColumn("node", col("l_partkey") % 20), ["l_suppkey"], "node", "l_quantity")


@q(f"WITH p AS (SELECT DISTINCT {_FILE} AS path FROM lineitem) SELECT path, d::INT AS depth, array_to_string(string_split(path, '/')[1:d], '/') AS dir FROM p, range(1, 3) t(d)")
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All directories above each file."""
    return I.ancestors(table(spark, sf_dir, "lineitem").selectExpr(f"{_FILE} AS path").distinct(), "path")


@q("WITH f AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, md5(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR)) AS id FROM lineitem GROUP BY 1), "
   "d AS (SELECT DISTINCT o_custkey, id, n FROM f JOIN orders ON o_orderkey = l_orderkey) SELECT o_custkey AS dir, sum(n)::BIGINT AS n, count(*) AS n_children FROM d GROUP BY 1")  # fmt: skip
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory's counters over its distinct files: files with the same features count once."""
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", col("l_partkey").cast("string").alias("p")).distinct()
    files = parts.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("p")), ",")).alias("id"))
    placed = files.join(table(spark, sf_dir, "orders"), col("l_orderkey") == col("o_orderkey")).select(col("o_custkey").alias("dir"), "id", "n")
    return I.roll_up(placed, "dir", "id", ["n"])


@q("SELECT l_orderkey, md5(string_agg(DISTINCT md5(l_partkey::VARCHAR), ',' ORDER BY md5(l_partkey::VARCHAR))) AS node_id FROM lineitem GROUP BY 1")
def node_id_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's id from its sorted distinct keys."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", F.md5(col("l_partkey").cast("string")).alias("k")).distinct()
    return keys.groupBy("l_orderkey").agg(F.md5(F.array_join(F.array_sort(F.collect_list("k")), ",")).alias("node_id"))


@q(f"WITH {EDGES_SQL} SELECT child_id AS source, parent_id AS repo, (SELECT count(DISTINCT token) FROM feat WHERE feat.source = edges.child_id) AS uniq FROM edges WHERE parent_type = 'repo'")
def root_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from top directories to repositories with the number of distinct features."""
    roots = corpus_edges(spark, sf_dir).where("parent_type = 'repo'").select(col("child_id").alias("source"), col("parent_id").alias("repo"))
    return roots.join(features(spark, sf_dir).groupBy("source").agg(F.count_distinct("token").alias("uniq")), "source")


@q(f"WITH {TOKENS_SQL}, p AS (SELECT source, token, sum(freq)::BIGINT AS n, count(DISTINCT doc_id) AS k FROM feat GROUP BY 1, 2) SELECT source, sum(k)::BIGINT AS total, sum(n)::BIGINT AS total_freq, count(*) AS \"unique\", max(k) AS max_score, min(k) AS min_score FROM p GROUP BY 1")
def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, distinct features and extremes, per repository."""
    return I.repo_stats(features(spark, sf_dir), "source", "token", "doc_id", "freq")


@q(f"WITH {TOKENS_SQL} SELECT source, token, sum(freq)::BIGINT AS freq FROM feat GROUP BY 1, 2")
def repo_feature_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's frequency in each repository."""
    return features(spark, sf_dir).groupBy("source", "token").agg(F.sum("freq").alias("freq"))


@q("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS licenses FROM lineitem GROUP BY 1")
def node_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the licences found at a node."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("licenses"))


@q("WITH l AS (SELECT l_suppkey AS dir, CASE WHEN l_linenumber = 1 AND l_suppkey <> 0 THEN 'THIRD-PARTY' WHEN l_linenumber > 1 THEN l_returnflag END AS x FROM lineitem) "
   "SELECT dir, string_agg(DISTINCT x, ',' ORDER BY x) AS licenses FROM l WHERE x IS NOT NULL GROUP BY 1")  # fmt: skip
def dir_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of directories, and a mark for files of others outside the root."""
    x = F.when((col("l_linenumber") == 1) & (col("l_suppkey") != 0), "THIRD-PARTY").when(col("l_linenumber") > 1, col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select(col("l_suppkey").alias("dir"), x.alias("x")).where("x IS NOT NULL")
    return rows.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("licenses"))


@q(f"WITH {EDGES_SQL} SELECT child_type, child_id, count(DISTINCT (parent_type, parent_id)) AS refcnt FROM edges WHERE parent_type <> 'repo' GROUP BY 1, 2")
def refcnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parents of each key."""
    return I.reference_counts(corpus_edges(spark, sf_dir, True), True)


@q(f"WITH {EDGES_SQL} SELECT child_type, count(*) AS n_edges FROM edges WHERE parent_type <> 'repo' GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the child's type."""
    return I.type_counts(corpus_edges(spark, sf_dir, True), True)


@q("SELECT p_brand AS software, count(DISTINCT p_size) AS n_versions, count(DISTINCT p_type) AS n_licenses FROM part GROUP BY 1")
def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and details of each software."""
    return table(spark, sf_dir, "part").groupBy(col("p_brand").alias("software")).agg(F.count_distinct("p_size").alias("n_versions"), F.count_distinct("p_type").alias("n_licenses"))


@q(f"WITH {TOKENS_SQL} SELECT source, token, min(lang) AS lang FROM feat GROUP BY 1, 2 HAVING count(DISTINCT lang) = 1")
def version_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a software that one version alone has."""
    return I.version_unique(features(spark, sf_dir), "source", "lang", "token")


@q("SELECT DISTINCT printf('%.2f,%.2f', embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS centroid FROM embeddings")
def centroid_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids, each once."""
    return table(spark, sf_dir, "embeddings").select(F.format_string("%.2f,%.2f", col("embedding")[0].cast("double"), col("embedding")[1].cast("double")).alias("centroid")).distinct()


_REPO = ["CASE WHEN s_suppkey % 9 = 0 THEN concat('x', cast(s_suppkey AS string)) ELSE cast(s_suppkey AS string) END AS id", "concat('own/', CASE cast(s_suppkey % 7 AS int) WHEN 0 THEN 'my-kernel' WHEN 1 THEN 'QEMU' ELSE s_name END) AS name", "cast(s_acctbal AS bigint) AS size", "CASE WHEN s_suppkey % 5 = 0 THEN 'Documentation,arch,mm,kernel,drivers' ELSE 'src,arch' END AS dirs"]


@q(f"SELECT id, name FROM (SELECT {', '.join(_REPO)} FROM supplier) WHERE regexp_full_match(id, '-*[0-9]+') AND NOT regexp_matches(lower(name), 'kernel|qemu|kvm|xen|u-boot|uboot') AND size BETWEEN 4 AND 122880 AND dirs <> 'Documentation,arch,mm,kernel,drivers'")
def repo_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories fit for the index."""
    r = table(spark, sf_dir, "supplier").selectExpr(*_REPO).withColumn("dirs", F.split("dirs", ","))
    return I.admitted(r, "id", "name", "size", "dirs", S.UNWANTED_REPOS).select("id", "name")


_TAGS = ["o_custkey", "o_orderdate", "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'v' ELSE 'release-' END, cast(o_orderkey % 4 AS string), '.', cast(o_custkey % 3 AS string)) AS tag"]


@q(f"SELECT o_custkey, version, arg_min(tag, (length(tag), tag)) AS tag FROM (SELECT *, array_to_string(regexp_extract_all(tag, '(\\d+[a-zA-Z]*)', 1), '.') AS version FROM (SELECT {', '.join(_TAGS)} FROM orders)) GROUP BY 1, 2")
def tag_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tags of one version the shortest."""
    t = table(spark, sf_dir, "orders").selectExpr(*_TAGS).withColumn("version", S.version_string(col("tag"))).select("o_custkey", "version", "tag").distinct()
    return I.first_by(t, ["o_custkey", "version"], [F.length("tag"), col("tag")])


@q("WITH t AS (SELECT o_custkey, o_orderkey::VARCHAR AS tag, o_orderdate AS d, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders), "
   "b AS (SELECT *, floor(((year(m) - year(d)) * 12 + month(m) - month(d)) / 3)::INT AS bucket FROM t), "
   "n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, bucket ORDER BY d DESC, tag) AS rn FROM b), "
   "k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY bucket) AS r FROM n WHERE rn = 1) SELECT o_custkey, tag, bucket FROM k WHERE r <= 8")  # fmt: skip
def tag_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest tag of each quarter, of the newest eight."""
    t = table(spark, sf_dir, "orders").select("o_custkey", col("o_orderkey").cast("string").alias("tag"), "o_orderdate")
    return I.thin_tags(t, "o_custkey", "tag", "o_orderdate").select("o_custkey", "tag", "bucket")


QUERIES, ORACLE = section.queries, section.oracle
