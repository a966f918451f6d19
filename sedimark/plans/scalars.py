"""Queries over scalar feature functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions import hashing as H
from sedimark.functions import scalar as S
from sedimark.plans.base import Section
from sedimark.session import table

section = Section()
col = F.col

_PATH = ["l_orderkey", "l_linenumber", (
    "concat('repo', cast(l_suppkey AS string), '/', CASE l_linenumber % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'external' WHEN 2 THEN 'lib/3rdparty' ELSE 'docs' END, '/', "
    "CASE cast(l_partkey % 9 AS int) WHEN 0 THEN 'LICENSE' WHEN 1 THEN 'COPYING.txt' WHEN 2 THEN 'ChangeLog' WHEN 3 THEN 'README.md' ELSE concat('f', cast(l_partkey AS string)) END, "
    "CASE cast(l_partkey % 7 AS int) WHEN 0 THEN '.c' WHEN 1 THEN '.H' WHEN 2 THEN '.cpp' WHEN 3 THEN '.hpp' WHEN 4 THEN '.java' ELSE '' END) AS path")]  # fmt: skip
_WORDS = lambda words: "\\b(" + "|".join(words) + ")\\b"

section.expressions(
    "license_filename", "lineitem", _PATH,
    lambda: ["l_orderkey", "l_linenumber", "path", S.is_license_file(col("path")).alias("is_license"), S.is_independent_file(col("path")).alias("is_independent")],
    f"SELECT l_orderkey, l_linenumber, path, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{_WORDS(S.LICENSE_WORDS)}', 'i') AS is_license, "
    f"regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{_WORDS(S.INDEPENDENT_WORDS)}', 'i') AS is_independent FROM {{input}}",
)
section.expressions(
    "file_type", "lineitem", _PATH, lambda: ["l_orderkey", "l_linenumber", S.file_kind(col("path")).alias("kind")],
    "SELECT l_orderkey, l_linenumber, CASE regexp_extract(path, '\\.([^./]+)$', 1) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.FILE_KINDS.items()) + " END AS kind FROM {input}",
)
section.expressions(
    "inflate_strings", "documents", ["doc_id", "concat(text, chr(10)) AS text"], lambda: ["doc_id", F.explode(S.inflated(col("text"))).alias("value")],
    "SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_append(l, replace(t, chr(10), '\\n')) ELSE l END) AS value FROM (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM "
    "(SELECT doc_id, regexp_replace(replace(text, chr(13), ''), '\\n$', '') AS t FROM {input}))",
)
section.expressions(
    "ascii_filter", "conversations", ["conv_id", "turn", "text"],
    lambda: ["conv_id", "turn", S.is_ascii(col("text")).alias("ascii"), S.is_feature_string(col("text")).alias("is_feature")],
    "SELECT conv_id, turn, regexp_full_match(text, '[\\x15-\\x7F]*') AS ascii, regexp_full_match(text, '[\\x15-\\x7F]*') AND length(text) >= 3 AS is_feature FROM {input}",
)

_FUNC = ["p_partkey", "concat(CASE cast(p_partkey % 5 AS int) WHEN 0 THEN 'std::' WHEN 1 THEN 'a::b::' WHEN 2 THEN 'ns::' ELSE '' END, replace(p_name, ' ', '_')) AS bare",
         "CASE cast(p_partkey % 3 AS int) WHEN 0 THEN '' WHEN 1 THEN concat('(std::string const&, ns::', p_type, '*, int)') ELSE '(a::b::c, std::map<x::k, std::v>)' END AS params"]
section.expressions(
    "func_normalize", "part", _FUNC,
    lambda: ["p_partkey", *(c.alias(n) for c, n in zip(S.function_parts(col("bare"), F.concat("bare", "params")), ("func", "funcname"), strict=True))],
    "SELECT p_partkey, CASE WHEN ok THEN concat(bare, replace(regexp_replace(replace(params, 'std::', chr(1)), '\\w+::', '', 'g'), chr(1), 'std::')) END AS func, "
    "CASE WHEN ok THEN string_split(bare, '::')[-1] END AS funcname FROM (SELECT *, NOT starts_with(bare, 'std::') AND (params <> '' OR NOT contains(bare, '::')) AS ok FROM {input})",
)

_SOURCE = ["c_custkey", (
    "concat('#include \"', c_name, '.h\"', chr(10), '// kept \"yes\"', chr(10), '/* not \"kept\" */', chr(10), 'static int first_', cast(c_custkey AS string), '(int a) {', chr(10), "
    "'  if (a) { log(\"', c_mktsegment, ' error: %d\", a); }', chr(10), '}', chr(10), 'int ', c_mktsegment, '::run_', cast(c_custkey % 50 AS string), '(const char* p) {', chr(10), "
    "'  puts(\"', c_name, '\"); puts(\"\"); return R\"x(raw ', c_mktsegment, ')x\";', chr(10), '} void next_', cast(c_custkey % 7 AS string), '(char c) const { put(', chr(39), 'q', chr(39), '); x = 1; static int own(void) { } }', chr(10)) AS src")]  # fmt: skip
section.expressions(
    "regex_strings", "customer", _SOURCE, lambda: ["c_custkey", F.explode(S.string_literals(col("src"))).alias("literal")],
    """SELECT c_custkey, literal FROM (SELECT c_custkey, unnest(list_transform(regexp_extract_all(line, '\\x27[^\\x27]*\\x27|R"x\\(.*?\\)x"|"[^"]*"'), """
    """lambda m: CASE WHEN m[1] = 'R' THEN m[5:-4] WHEN m[1] = '"' THEN m[2:-2] ELSE '' END)) AS literal FROM """
    """(SELECT c_custkey, unnest(string_split(src, chr(10))) AS line FROM {input}) WHERE NOT starts_with(line, '#include') AND NOT starts_with(line, '/*')) WHERE literal <> ''""",
)
section.expressions(
    "regex_functions", "customer", _SOURCE, lambda: ["c_custkey", F.explode(S.function_names(col("src"))).alias("function")],
    "SELECT c_custkey, concat('run_', cast(c_custkey % 50 AS VARCHAR)) AS function FROM {input} UNION ALL SELECT c_custkey, concat('next_', cast(c_custkey % 7 AS VARCHAR)) FROM {input}",
)
section.expressions(
    "parse_feature_record", "orders", ["o_orderkey", (
        "concat(CASE cast(o_orderkey % 3 AS int) WHEN 0 THEN 's' WHEN 1 THEN 'f' ELSE 'v' END, ':', cast(o_custkey % 4 AS string), ':', cast(o_custkey % 3 AS string), ':', cast(o_orderkey % 97 AS string), ':2:', "
        "cast(o_orderkey % 97 + 1 AS string), ':9:', CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(34), o_orderpriority, ':x', chr(34)) ELSE concat('ns::', o_orderpriority) END) AS record")],
    lambda: ["o_orderkey", *(c.alias(n) for n, c in S.parsed_record(col("record"), 7).items())],
    "SELECT o_orderkey, p[1] AS type, p[2]::INT AS grp, p[3]::INT AS export_type, p[4]::INT AS start_row, p[5]::INT AS start_col, p[6]::INT AS end_row, p[7]::INT AS end_col, "
    "CASE WHEN p[1] = 's' THEN substr(f, 2, length(f) - 2) ELSE f END AS feature FROM (SELECT o_orderkey, string_split(record, ':') AS p, array_to_string(string_split(record, ':')[8:], ':') AS f FROM {input})",
)

_METHOD = ["p_partkey", "concat('com.app.', p_type, '.C', cast(p_size AS string)) AS cls", "CASE WHEN p_partkey % 6 = 0 THEN 'toString' WHEN p_partkey % 6 = 1 THEN '<init>' ELSE replace(p_name, ' ', '') END AS method",
           "concat('int,java.lang.String,com.app.', p_type, CASE WHEN p_size % 2 = 0 THEN ',android.os.Bundle' ELSE '' END) AS params", "CASE WHEN p_size % 3 = 0 THEN 'void' ELSE concat('com.x.', p_type) END AS returns"]


def _framework():
    return F.array(F.lit("java.lang.String"), F.lit("android.os.Bundle"))


_FRAME_SQL = "['java.lang.String', 'android.os.Bundle']"
section.expressions(
    "no_package_func", "part", _METHOD,
    lambda: ["p_partkey", S.no_package_signature(col("cls"), col("method"), F.split("params", ","), col("returns"), _framework()).alias("signature")],
    "SELECT p_partkey, concat(string_split(returns, '.')[-1], ' ', string_split(cls, '.')[-1], '.', method, '(', array_to_string(list_transform(string_split(params, ','), "
    f"lambda t: CASE WHEN list_contains({_FRAME_SQL}, t) THEN t ELSE string_split(t, '.')[-1] END), ','), ')') AS signature FROM {{input}}",
)
_NORM = (
    "concat('norm:', CASE WHEN returns = 'void' THEN 'void' ELSE 'APP_CLASS' END, ' ', CASE WHEN method IN ('toString', '<init>') THEN method ELSE 'APP_METHOD' END, '(', "
    f"array_to_string(list_transform(string_split(params, ','), lambda t: CASE WHEN t = 'int' OR list_contains({_FRAME_SQL}, t) THEN t ELSE 'APP_CLASS' END), ','), ')')"
)
section.expressions(
    "norm_func", "part", _METHOD, lambda: ["p_partkey", S.normal_signature(col("method"), F.split("params", ","), col("returns"), _framework()).alias("signature")],
    f"SELECT p_partkey, {_NORM} AS signature FROM {{input}}",
)


@section.add(f"SELECT cls, concat(string_agg(s, ',' ORDER BY s), ',') AS class_string FROM (SELECT cls, {_NORM} AS s FROM (SELECT {', '.join(_METHOD)} FROM part)) GROUP BY cls")
def class_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class as the sorted multiset of its methods' normal signatures."""
    rows = table(spark, sf_dir, "part").selectExpr(*_METHOD)
    one = S.normal_signature(col("method"), F.split("params", ","), col("returns"), _framework())
    return rows.groupBy("cls").agg(S.class_string(F.collect_list(one)).alias("class_string"))


_PAIR = ["concat(CASE cast(l_partkey % 4 AS int) WHEN 0 THEN 'java.util.' WHEN 1 THEN 'org.json.' WHEN 2 THEN 'com.app.' ELSE 'android.os.' END, 'K', cast(l_partkey % 40 AS string)) AS class2",
         "concat('com.app.C', cast(l_suppkey AS string)) AS class1", "CASE cast(l_linenumber AS int) WHEN 1 THEN 'CALL' WHEN 2 THEN 'INHERITANCE' ELSE 'FIELD' END AS relation", "l_partkey % 4 = 2 AS is_app"]


@section.add(f"SELECT DISTINCT class2 FROM (SELECT {', '.join(_PAIR)} FROM lineitem) WHERE NOT is_app AND ("
             + " OR ".join(f"starts_with(class2, '{p}')" for p in S.FRAMEWORK_PREFIXES) + ")")
def framework_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framework classes that application classes refer to."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_PAIR).where(~col("is_app") & S.is_framework(col("class2"))).select("class2").distinct()


@section.add(f"SELECT class1, class2, relation, count(*) AS n FROM (SELECT {', '.join(_PAIR)} FROM lineitem) GROUP BY ALL")
def class_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each relation of each pair of classes."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_PAIR).groupBy("class1", "class2", "relation").agg(F.count("*").alias("n"))


@section.add("SELECT vec_id, 'centroids' || printf('(%.4f,%.4f,%.4f,', embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE) || label::VARCHAR || ')' || printf('(%.4f,%.4f,%.4f,', embedding[4]::DOUBLE, embedding[5]::DOUBLE, embedding[6]::DOUBLE) || (label + 1)::VARCHAR || ')' AS centroid FROM embeddings")
def centroid_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centroid as text, with and without invocations."""
    e = table(spark, sf_dir, "embeddings")
    places = [col("embedding")[i] for i in range(6)]
    return e.select("vec_id", S.centroid_text([*places[:3], col("label")], [*places[3:], col("label") + 1]).alias("centroid"))


section.expressions(
    "feature_key", "documents", ["doc_id", "text"], lambda: ["doc_id", H.feature_key(col("text")).alias("key"), H.hex64(H.first64(col("text"))).alias("first64"), H.hex64(H.last64(col("text"))).alias("last64")],
    "SELECT doc_id, md5(text) AS key, substr(md5(text), 1, 16) AS first64, substr(md5(text), 17, 16) AS last64 FROM {input}",
)
section.expressions(
    "typed_key", "orders", ["o_orderkey", "o_orderstatus"], lambda: ["o_orderkey", F.concat_ws("-", F.when(col("o_orderstatus") == "F", "file").otherwise("dir"), col("o_orderkey").cast("string")).alias("key"), F.concat_ws("-", F.lit("r"), F.when(col("o_orderstatus") == "F", "files").otherwise("dirs"), col("o_orderkey").cast("string")).alias("reverse_key")],
    "SELECT o_orderkey, concat(CASE WHEN o_orderstatus = 'F' THEN 'file-' ELSE 'dir-' END, o_orderkey::VARCHAR) AS key, concat('r-', CASE WHEN o_orderstatus = 'F' THEN 'files-' ELSE 'dirs-' END, o_orderkey::VARCHAR) AS reverse_key FROM {input}",
)


@section.add("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, CASE "
             + " ".join(f"WHEN regexp_matches(lower(line), '{p}') THEN '{n}'" for p, n in S.LICENSE_RULES)
             + " END AS license FROM l) SELECT DISTINCT doc_id, license FROM m WHERE license IS NOT NULL")
def license_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in each document's lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", S.license_of_line(col("line")).alias("license")).where("license is not null").distinct()


_LICENSE = ["o_orderkey", "CASE cast(o_custkey % 5 AS int) WHEN 0 THEN 'LGPL-2.1' WHEN 1 THEN 'GPLv3' WHEN 2 THEN 'AGPL' WHEN 3 THEN 'MIT' ELSE o_orderpriority END AS license"]
section.expressions(
    "license_family", "orders", _LICENSE, lambda: ["o_orderkey", S.license_family(col("license")).alias("family")],
    "SELECT o_orderkey, CASE WHEN lower(license) LIKE '%lgpl%' THEN 'lgpl' WHEN lower(license) LIKE '%gpl%' THEN 'gpl' ELSE 'nongpl' END AS family FROM {input}",
)
_PAGE = ["page_id", "concat(url, ' see https://github.com/o/r', cast(page_id AS string), ' and http://gitlab.example.org/x ', html) AS content"]
section.expressions(
    "oss_links", "pages", _PAGE, lambda: ["page_id", F.posexplode(S.links(col("content"))).alias("pos", "url")],
    "SELECT page_id, (unnest(range(len(l))))::INT AS pos, unnest(l) AS url FROM (SELECT page_id, regexp_extract_all(content, 'https?://[^\\s\"''<>]+') AS l FROM {input})",
)
section.expressions(
    "app_openness", "pages", _PAGE,
    lambda: ["page_id", F.size(S.links(col("content"))).cast("long").alias("n_links"), F.exists(S.links(col("content")), lambda u: S.is_oss_host(S.host(u))).alias("is_open")],
    "SELECT page_id, len(l)::BIGINT AS n_links, len(list_filter(l, lambda u: regexp_matches(lower(regexp_extract(u, '^https?://([^/?#\\s]+)', 1)), 'github\\.|bitbucket\\.|gitlab\\.'))) > 0 AS is_open "
    "FROM (SELECT page_id, regexp_extract_all(content, 'https?://[^\\s\"''<>]+') AS l FROM {input})",
)

_TAG = ["o_orderkey", ("concat(CASE cast(o_orderkey % 5 AS int) WHEN 0 THEN 'OpenSSL_' WHEN 1 THEN 'v' WHEN 2 THEN 'Release-v' WHEN 3 THEN 'lib-' ELSE '' END, cast(o_custkey % 4 AS string), "
        "CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE '_' END, cast(o_orderkey % 12 AS string), CASE cast(o_custkey % 6 AS int) WHEN 0 THEN 'rc1' WHEN 1 THEN '-beta' WHEN 2 THEN 'k' WHEN 3 THEN '.4' ELSE '' END) AS tag"),
        "concat('lib version ', cast(o_custkey % 4 AS string), '.', cast(o_orderkey % 12 AS string), ' - ', o_orderpriority) AS banner"]
section.expressions(
    "version_string", "orders", _TAG, lambda: ["o_orderkey", S.version_string(col("tag")).alias("version")],
    "SELECT o_orderkey, array_to_string(regexp_extract_all(tag, '(\\d+[a-zA-Z]*)', 1), '.') AS version FROM {input}",
)
_RUN_SQL = "regexp_extract(tag, '^(?:[^\\d,.\\-_/|\\\\]*[,.\\-_/|\\\\])*([^,.\\-_/|\\\\]*\\d[^,.\\-_/|\\\\]*(?:[,.\\-_/|\\\\][^,.\\-_/|\\\\]*\\d[^,.\\-_/|\\\\]*)*)', 1)"
_PATTERN_SQL = f"concat('(^|v|[^,:.\\w])', array_to_string(regexp_extract_all({_RUN_SQL}, '(\\d+[a-zA-Z]*)', 1), '[.\\-_]'), '($|[^,:.\\w])')"
section.expressions(
    "version_pattern", "orders", _TAG, lambda: ["o_orderkey", S.version_pattern(col("tag")).alias("pattern")],
    f"SELECT o_orderkey, {_PATTERN_SQL} AS pattern FROM {{input}}",
)
section.expressions(
    "version_feature", "orders", _TAG, lambda: ["o_orderkey", S.is_version_feature(col("tag"), col("banner")).alias("is_version")],
    f"SELECT o_orderkey, len(regexp_extract_all(tag, '(\\d+)', 1)) > 1 AND regexp_matches(banner, {_PATTERN_SQL}) AS is_version FROM {{input}}",
)
section.expressions(
    "unstable_tag", "orders", _TAG, lambda: ["o_orderkey", S.is_unstable(col("tag")).alias("unstable")],
    "SELECT o_orderkey, regexp_matches(lower(tag), '\\drc|rc\\d|alpha|beta|preview|unstable') AS unstable FROM {input}",
)
section.expressions(
    "name_distance", "part", ["p_partkey", "p_name", "lower(p_brand) AS brand"], lambda: ["p_partkey", F.round(S.name_distance(col("p_name"), col("brand")), 6).alias("distance")],
    "SELECT p_partkey, round(levenshtein(p_name, brand)::DOUBLE / nullif(greatest(length(p_name), length(brand)), 0), 6) AS distance FROM {input}",
)
section.expressions(
    "exclude_dirs", "part", ["p_partkey", "concat('root/', CASE WHEN p_size % 4 = 0 THEN 'src/' ELSE '' END, replace(p_name, ' ', '_')) AS dir", "lower(p_type) AS repo", "p_size % 3 = 0 AS licensed"],
    lambda: ["p_partkey", (col("licensed") & ~col("dir").rlike(S.word_pattern(S.SOURCE_WORDS)) & (S.name_distance(S.basename(col("dir")), col("repo")) > 0.5)).alias("excluded")],
    "SELECT p_partkey, licensed AND NOT regexp_matches(dir, '\\b(src|source)\\b', 'i') AND levenshtein(regexp_extract(dir, '([^/]*)$', 1), repo)::DOUBLE / greatest(length(regexp_extract(dir, '([^/]*)$', 1)), length(repo)) > 0.5 AS excluded FROM {input}",
)
section.expressions(
    "numeric_helpers", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_suppkey"],
    lambda: ["l_orderkey", "l_linenumber", F.round(100 * col("l_quantity") / 50, 2).alias("percentage"), (F.floor(F.log10(col("l_quantity"))) + 1).cast("int").alias("digits"), F.floor(col("l_linenumber") * col("l_suppkey") / 100).cast("long").alias("fraction"), F.size(F.sequence(F.lit(25), F.lit(25) * col("l_linenumber"), F.lit(25))).cast("int").alias("steps")],
    "SELECT l_orderkey, l_linenumber, round(100 * l_quantity / 50, 2) AS percentage, (floor(log10(l_quantity)) + 1)::INT AS digits, floor(l_linenumber * l_suppkey / 100.0)::BIGINT AS fraction, len(generate_series(25, 25 * l_linenumber, 25))::INT AS steps FROM {input}",
)
section.expressions(
    "time_helpers", "orders", ["o_orderkey", "o_orderdate"], lambda: ["o_orderkey", F.unix_timestamp("o_orderdate").alias("epoch"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")],
    "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS epoch, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM {input}",
)
section.expressions(
    "sig_digits", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice - 20000 AS x"], lambda: ["l_orderkey", "l_linenumber", F.round(S.cut_to_digits(col("x"), 2), 6).alias("two"), F.round(S.cut_to_scale(col("x"), F.lit(1)), 6).alias("tens")],
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * floor(abs(x) * pow(10.0, -(floor(log10(abs(x))) - 1))) / pow(10.0, -(floor(log10(abs(x))) - 1)) END, 6) AS two, round(sign(x) * floor(abs(x) * pow(10.0, -1)) / pow(10.0, -1), 6) AS tens FROM {input}",
)
section.expressions(
    "split_name_version", "part", ["p_partkey", "CASE WHEN p_size % 4 = 0 THEN replace(p_name, ' ', '') ELSE concat(replace(p_name, ' ', '-'), '-', cast(p_size AS string), '.1') END AS stem"],
    lambda: ["p_partkey", *(c.alias(n) for c, n in zip(S.split_name_version(col("stem")), ("name", "version"), strict=True))],
    "SELECT p_partkey, CASE WHEN contains(stem, '-') THEN regexp_extract(stem, '^(.*)-([^-]*)$', 1) ELSE stem END AS name, CASE WHEN contains(stem, '-') THEN regexp_extract(stem, '^(.*)-([^-]*)$', 2) END AS version FROM {input}",
)


@section.add("WITH w AS (SELECT unnest(string_split(text, ' ')) AS s FROM conversations) SELECT b AS bucket, count(*) FILTER (length(s) >= floor(b * 8 / 100)) AS total, "
             "count(*) FILTER (length(s) >= floor(b * 8 / 100) AND regexp_full_match(s, '[\\x15-\\x7F]*')) AS ascii FROM w, (SELECT unnest([25, 50, 75, 100, 125, 150, 175])::INT AS b) GROUP BY b")  # fmt: skip
def strlen_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of at least 25 to 175 % of a minimum length of 8, all and ASCII: one pass of conditional counts."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("s"))
    steps = range(25, 176, 25)
    total = [F.count_if(F.length("s") >= b * 8 // 100).alias(f"t{b}") for b in steps]
    ascii_ = [F.count_if((F.length("s") >= b * 8 // 100) & S.is_ascii(col("s"))).alias(f"a{b}") for b in steps]
    one = words.agg(*total, *ascii_)
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), col(f"t{b}").alias("total"), col(f"a{b}").alias("ascii")) for b in steps])
    return one.select(F.inline(rows))


section.expressions(
    "export_filter", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey % 4 AS export_type"], lambda: ["l_orderkey", "l_linenumber", (col("export_type").bitwiseAND(F.lit(1)) == 1).alias("exported")],
    "SELECT l_orderkey, l_linenumber, (export_type & 1) = 1 AS exported FROM {input}",
)
section.expressions(
    "fallback_features", "orders", ["o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS parser", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS lexer", "cast(o_custkey AS string) AS regex"],
    lambda: ["o_orderkey", F.coalesce("parser", "lexer", "regex").alias("features"), F.when(col("parser").isNotNull(), "PARSER").when(col("lexer").isNotNull(), "LEXER").otherwise("REGEX").alias("mode")],
    "SELECT o_orderkey, coalesce(parser, lexer, regex) AS features, CASE WHEN parser IS NOT NULL THEN 'PARSER' WHEN lexer IS NOT NULL THEN 'LEXER' ELSE 'REGEX' END AS mode FROM {input}",
)

QUERIES, ORACLE = section.queries, section.oracle
