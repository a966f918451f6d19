"""File, list and dump readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.scalar import basename

#: Known names of the path column of artifact lists, the first present counts.
PATH_NAMES = ("store_path", "so_path", "filepath", "apk_path", "path", "app_path", "input_path", "inpath", "downloaded_path")


def list_files(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "", ignore_case: bool = False) -> DataFrame:
    """path, modificationTime, length of files under a folder by prefix and suffix of their names; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    name = basename(F.col("path"))
    fold = F.lower if ignore_case else (lambda c: c)
    low = str.lower if ignore_case else str
    return files.where(fold(name).startswith(low(prefix)) & fold(name).endswith(low(suffix)))


def source_files(files: DataFrame, wanted: Callable[[Column], Column], path: str = "path") -> DataFrame:
    """Regular files whose path a predicate wants; hidden files and folders are none of a source tree's."""
    return files.where(wanted(F.col(path)) & ~F.col(path).rlike(r"(^|/)\.[^/.]"))


def last_by_name(files: DataFrame, path: str = "path") -> DataFrame:
    """One path for each base name, the last in order."""
    return files.groupBy(basename(F.col(path)).alias("name")).agg(F.max(path).alias(path))


def any_column(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of ``names`` that ``df`` has."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    raise ValueError(f"none of {list(names)} in {df.columns}")


def read_artifact_list(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """input_path of every artifact: of a CSV with a known column (and its columns ``keep``), of a plain list, or the files of a folder, or the file itself."""
    if path.endswith(".csv"):
        table = spark.read.option("header", "true").csv(path)
        return table.select(*keep, any_column(table, PATH_NAMES).alias("input_path"))
    if path.endswith((".txt", ".list")):
        return spark.read.text(path).select(F.trim("value").alias("input_path")).where(F.col("input_path") != "")
    return list_files(spark, path).select(F.col("path").alias("input_path"))


def missing(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other table lacks: what is still to be done."""
    return wanted.join(have.select(*keys), list(keys), "left_anti")


def write_dump(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A dump as CSV, JSON or parquet."""
    writer = df.write.option("header", "true") if fmt == "csv" else df.write
    writer.format(fmt).save(path)
