"""Labelled rows for training: the folds by checksum, and bounded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Classes are few by contract; more are refused.
MOST_CLASSES = 1000
#: Bytes of text that a sample brings to the driver, at most.
SAMPLE_BYTES = 64 << 20


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids have none."""
    return (F.crc32(F.col(f"`{id_col}`").cast("string")) % folds).cast("int")


def sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, class_col: str, per_class: int) -> list:
    """Rows (id, text, class) of at most ``per_class`` ids and SAMPLE_BYTES / classes bytes of each class, by a hash of the id.

    ``known`` has the ids and classes; an id with two different classes is left out. Ids are picked from it alone, so texts
    are read once, for the picked ids. Null texts are left out, and so is a text that alone would fill an eighth of its
    class's bytes; of an id that repeats, its first text in order is taken.
    """
    known = known.select(F.col(id_col).alias("_id"), F.col(class_col).alias("_class")).where("_class IS NOT NULL AND _id IS NOT NULL")
    known = known.groupBy("_id").agg(F.min("_class").alias("_class"), F.max("_class").alias("_other")).where("_class = _other").drop("_other")
    classes = [r[0] for r in known.select("_class").distinct().limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"{class_col} has over {MOST_CLASSES} classes")
    if not classes:
        return []
    order = [F.xxhash64("_id", F.lit(7)), F.col("_id")]
    parts = [known.where(F.col("_class") == c).orderBy(*order).limit(per_class) for c in sorted(classes)]
    picked = reduce(DataFrame.unionByName, parts)
    share = SAMPLE_BYTES // len(classes)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.octet_length(F.col(f"`{text_col}`")).alias("_size")).where(F.col("_size") <= share // 8)
    found = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_class").agg(F.min(F.struct("_text", "_size")).alias("_t"))  # per_class rows a class
    filled = F.sum("_t._size").over(Window.partitionBy("_class").orderBy(*order))
    got = found.withColumn("_filled", filled).where(F.col("_filled") <= share).select("_id", "_t._text", "_class").collect()
    return sorted(((r["_id"], r["_text"], r["_class"]) for r in got), key=lambda r: (str(r[0]), r[1]))
