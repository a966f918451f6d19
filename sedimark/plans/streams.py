"""Streaming queries, run over all events there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimark.plans.base import Section
from sedimark.session import new_path
from sedimark.streaming import events as E

section = Section()
q = section.add


@q("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream."""
    return E.run_to_table(E.tumbling(E.read_events(spark, sf_dir)), new_path(spark, "stream"), "complete").drop("end")


@q("WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts)::TIMESTAMP - i * INTERVAL 30 MINUTE AS start, event_type, value FROM events, range(2) t(i)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly counts over hours of a stream."""
    return E.run_to_table(E.sliding(E.read_events(spark, sf_dir)), new_path(spark, "stream"), "complete").drop("end")


@q("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), "
   "g AS (SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, start, n FROM g")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions of a stream; a pause of exactly 30 minutes doesn't end one."""
    return E.run_to_table(E.sessions(E.read_events(spark, sf_dir)), new_path(spark, "stream"), "complete").drop("end")


@q("SELECT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream, each id once."""
    return E.run_to_table(E.deduplicated(E.read_events(spark, sf_dir), ["event_id"]).select("event_id", "user_id"), new_path(spark, "stream"))


QUERIES, ORACLE = section.queries, section.oracle
