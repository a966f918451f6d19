"""Streaming operators over an event table: windows, late data, deduplication, running reference counts.

Each takes a streaming (or batch) DataFrame with ``ts``, ``user_id``, ``event_type``, ``event_id`` and ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type."""
    return _sums(_timed(events, late).groupBy(F.window("ts", width), "event_type"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """The same over overlapping windows."""
    return _sums(_timed(events, late).groupBy(F.window("ts", width, step), "event_type"))


def _sums(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's sessions: events no further apart than ``gap``."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first event of each key within the watermark."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def running_refcnt(events: DataFrame, child: str, parent: str) -> DataFrame:
    """Distinct parents of each child, kept up as edges arrive; approximate sets would lose parents, so this is exact."""
    return events.select(child, parent).where(F.col(parent).isNotNull()).dropDuplicates([child, parent]).groupBy(child).agg(F.count("*").alias("refcnt"))


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is now into a parquet table under ``path``, with its checkpoint beside it, and read that.

    In append mode the groups that the watermark leaves open aren't emitted; in complete mode each batch writes all
    groups, and the last batch's table is read.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode != "complete":
        writer.format("parquet").option("path", f"{path}/data").start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
    batches: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/{number}")
        batches.append(number)

    writer.foreachBatch(put).start().awaitTermination()
    if not batches:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data/{batches[-1]}")
