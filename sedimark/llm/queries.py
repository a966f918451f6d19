"""The registered queries of this subpackage, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import decontaminate, jaccard, langid, line_dedup, media, packing, quality, sharding, token_count, toxicity
from sedimark.session import table

SHARDS = [f"shard-{i:02d}" for i in range(32)]
MIN_SITES = 10


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on ten or more sources; each such line's first place stays."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class under five-word Jaccard similarity of 0.8 or more, and its number of links."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), threshold=0.8, n=5, recall=0.999)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by its id, over 32 shards."""
    out = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)
    return out.select("doc_id", F.col("slot").cast("long").alias("slot"), "shard")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), limit=4096)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity, and its sentence most likely to offend."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality by the marginals of its lines."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a GIF and read back."""
    return media.media_digests(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_sharding": op4_sharding,
        "op5_token_counts": op5_token_counts,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_media_columns": op9_media_columns,
        "op10_language_id": op10_language_id,
    }


_OP1 = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
boiler AS (
  SELECT line, min({{'d': doc_id, 'p': pos}}) AS f FROM lines WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.pos, l.line, b.f IS NOT NULL AND NOT (b.f.d = l.doc_id AND b.f.p = l.pos) AS gone
  FROM lines l LEFT JOIN boiler b ON l.line = b.line)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.kept, '') END AS text,
       coalesce(m.n, 0)::BIGINT AS n_lines, coalesce(m.k, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept, count(*) AS n,
         count(*) FILTER (gone) AS k FROM marked GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""

_SIZE = sharding.next_prime(100 * len(SHARDS))
_OP4 = f"""
WITH RECURSIVE shard AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i)),
pref AS (
  SELECT list(('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {_SIZE} ORDER BY i) AS o,
         list(('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % {_SIZE - 1} + 1 ORDER BY i) AS s FROM shard),
fill AS (
  SELECT 0::BIGINT AS t, list_transform(range({_SIZE}), lambda x: -1::BIGINT) AS owner
  UNION ALL
  SELECT t + 1, list_concat(list_concat(owner[1:slot], [t % {len(SHARDS)}]), owner[slot + 2:])
  FROM (SELECT t, owner, (o + s * list_filter(range({_SIZE}), lambda j: owner[(o + j * s) % {_SIZE} + 1] = -1)[1]) % {_SIZE} AS slot
        FROM (SELECT f.t, f.owner, p.o[f.t % {len(SHARDS)} + 1] AS o, p.s[f.t % {len(SHARDS)} + 1] AS s
              FROM fill f, pref p WHERE f.t < {_SIZE}))),
placed AS (SELECT owner FROM fill WHERE t = {_SIZE}),
slots AS (SELECT unnest(range({_SIZE})) AS slot, unnest(owner) AS i FROM placed),
doc AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {_SIZE} AS slot FROM documents)
SELECT doc.doc_id, doc.slot, shard.name AS shard
FROM doc JOIN slots ON doc.slot = slots.slot JOIN shard ON slots.i = shard.i
"""

_WORDS = "list_filter(string_split_regex(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
_MASKS = ", ".join(str(list(decontaminate.offsets(m))) for m in decontaminate.MASKS)
# For items of ten words or more and scripts with spaces, as those of the tables; windows meet on their kept words themselves.
_OP8 = f"""
WITH masks AS (SELECT unnest([{_MASKS}]) AS m),
d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, md5(text) AS t, m, p, list_transform(m, lambda o: w[p + o + 1]) AS k FROM (SELECT *, unnest(range(greatest(len(w) - m[-1], 0))) AS p FROM d, masks)),
bw AS (SELECT item_id, m, p, list_transform(m, lambda o: w[p + o + 1]) AS k FROM (SELECT *, unnest(range(greatest(len(w) - m[-1], 0))) AS p FROM b, masks)),
hits AS (SELECT DISTINCT dw.doc_id, dw.t, bw.item_id, dw.p - bw.p AS al FROM dw JOIN bw ON dw.m = bw.m AND dw.k = bw.k),
cells AS (SELECT h.*, j, len(b.w) AS size, d.w[al + j + 1] = b.w[j + 1] AS eq FROM hits h JOIN d ON d.doc_id = h.doc_id AND md5(d.text) = h.t JOIN b ON b.item_id = h.item_id, LATERAL (SELECT unnest(range(greatest(0, -al), least(len(b.w), len(d.w) - al))) AS j)),
sums AS (SELECT *, sum(CASE WHEN eq THEN 1 ELSE -2 END) OVER a AS total, count(*) FILTER (eq) OVER a AS n FROM cells WINDOW a AS (PARTITION BY doc_id, t, item_id, al ORDER BY j)),
lows AS (SELECT *, least(0, min(total) OVER a) AS low FROM sums WINDOW a AS (PARTITION BY doc_id, t, item_id, al ORDER BY j)),
ends AS (SELECT doc_id, t, item_id, al, size, max({{'gain': total - low, 'j': -j}}) AS e FROM lows GROUP BY ALL),
starts AS (SELECT e.doc_id, e.t, e.item_id, e.al, e.size, -e.e.j + 1 AS stop, max(l.total) FILTER (l.j = -e.e.j) AS total, max(l.n) FILTER (l.j = -e.e.j) AS n, e.e.gain AS gain
  FROM ends e JOIN lows l USING (doc_id, t, item_id, al) GROUP BY ALL),
runs AS (SELECT s.doc_id, s.t, s.item_id, s.al, s.size, s.stop, s.n - coalesce(max_by(l.n, l.j), 0) AS n, coalesce(max(l.j) + 1, greatest(0, -s.al)) AS start
  FROM starts s LEFT JOIN lows l ON l.doc_id = s.doc_id AND l.t = s.t AND l.item_id = s.item_id AND l.al = s.al AND l.j < s.stop AND l.total = s.total - s.gain GROUP BY s.doc_id, s.t, s.item_id, s.al, s.size, s.stop, s.n),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t, item_id ORDER BY n DESC, al) AS r FROM runs WHERE n >= least(13, ceil(0.8 * size)))
SELECT doc_id, item_id, al + start AS doc_start, start AS item_start, stop - start AS n_words, n AS n_matched FROM best WHERE r = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op4_sharding": _OP4, "op8_benchmark_decontamination": _OP8}
