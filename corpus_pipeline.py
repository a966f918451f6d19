"""A corpus pipeline of five of the operators; each stage's result is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import decontaminate, jaccard, langid, line_dedup, packing
from sedimark.session import materialize, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its main language is unknown or has a smaller share of its letters.
MIN_LANGUAGE_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null and empty texts, and those without a letter, too. Repeated rows share a fate."""
    return langid.keep_identified(docs, langid.fit(docs), min_score=MIN_LANGUAGE_SHARE).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten or more sources go, but for their first place; n_chars follows the text. No row goes; a null source is no source, and repeated rows are treated alike."""
    out = line_dedup.dedup_lines(docs, min_sites=10)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the document with the smallest id stays, and so do rows that repeat it; a row whose id is null always stays."""
    return jaccard.keep_one(docs, threshold=0.8, n=5, recall=0.999).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, whatever their id. Null and empty texts overlap nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of at most 1024 tokens. A null or empty text is its end token; repeated rows are packed each."""
    return packing.pack_documents(docs, capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]

#: Learned models, sketches of token sets and tokenizers have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way, and its input, go when it ends."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with stage(docs) as kept:
            docs = materialize(step(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
