"""Helpers to register a section's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimark.session import table

#: Word features of the text corpus: file = document, component = source, version = language.
TOKENS_SQL = """tok AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents),
feat AS (SELECT source, lang, doc_id, token, count(*) AS freq FROM tok GROUP BY ALL)"""


class Section:
    """Collects queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def put(f):
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"registered twice: {key}")
            self.queries[key] = f
            if sql:
                self.oracle[key] = sql
            return f

        return put

    def expressions(self, name: str, source: str, inputs: list[str], outputs: Callable[[], list], sql: str) -> None:
        """A query over one table: ``inputs`` are expressions that both engines read, ``outputs`` columns made of them.

        In ``sql``, ``{input}`` stands for the table of the inputs.
        """

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return table(spark, sf_dir, source).selectExpr(*inputs).select(*outputs())

        run.__name__ = name
        self.add(sql.replace("{input}", f"(SELECT {', '.join(inputs)} FROM {source})"))(run)
