"""Session helpers: table loading, the shared folder, and materialised intermediate tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where one machine does everything and the session names no shared folder, as in tests.
LOCAL_SHARED_DIR = "file:///tmp/sedimark-shared"

#: Bytes after which a batch of rows on its way to Python ends, and rows that are read from parquet at once, where rows hold whole texts.
BATCH_BYTES, READ_ROWS = 1 << 20, 512

#: Folders of this application that still have to go, and those of them that all its queries share.
_written: dict[str, SparkSession] = {}
_lasting: set[str] = set()
#: Catalogue entries of bucketed tables, by folder.
_names: dict[str, str] = {}
_built: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; on a cluster the session has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return LOCAL_SHARED_DIR


def new_path(spark: SparkSession, tag: str) -> str:
    """A new folder's name in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sedimark/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts lineage so that a lost executor costs only the tasks it ran. The files go by ``release``, at the end of a
    ``stage``, or when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._materialized_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within the block hands texts to Python a MB at a time.

    Otherwise all texts of a task, up to 10,000 rows, are one batch. Each task holds it several times over outside
    the JVM's heap, in buffers that grow by doubling, and once more in Python; the session's other queries don't mind.
    """
    most = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}
    before = {k: spark.conf.get(k, None) for k in most}
    try:
        for k, v in most.items():
            if before[k] is None or not before[k].isdigit() or int(before[k]) > v:
                spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shares(spark: SparkSession, amount: int, each: int) -> int:
    """A number of partitions that grows with what they hold: the session's, or more so that each has ``each`` at most in the mean."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def bucketed(df: DataFrame, tag: str, by: list[str], buckets: int | None = None, there: bool = False) -> DataFrame:
    """Like ``materialize``, hashed into buckets by columns, so that joins and groups by these need no shuffle.

    ``there``: made of a table that was repartitioned into that many by these columns, and still lies as it did.
    """
    spark = df.sparkSession
    path, buckets = new_path(spark, tag), buckets or shares(spark, 0, 1)
    name = f"sedimark_{uuid.uuid4().hex}"
    (df if there else df.repartition(buckets, *by)).write.bucketBy(buckets, *by).option("path", path).saveAsTable(name)
    _names[path] = name
    out = spark.table(name)
    out._materialized_at = path
    return out


def once[T](spark: SparkSession, sf_dir: str, source: str, what: str, build: Callable[[], T]) -> T:
    """What ``build`` makes of the table ``source``, built once by an application for each state of the table's files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{source}.parquet")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.getContentSummary(where)
    key = (spark.sparkContext.applicationId, sf_dir, source, fs.getFileStatus(where).getModificationTime(), files.getLength(), files.getFileCount(), what)
    if key not in _built:
        known = set(_written)
        _built[key] = build()
        _lasting.update(p for p in _written if p not in known)
    return _built[key]


def release(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more; other DataFrames are left alone."""
    path = getattr(df, "_materialized_at", None)
    if path in _written:
        _discard(path)


@contextmanager
def stage(*last: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes, when the block ends, what it materialised and the tables ``last``, but for what it puts into the list."""
    known, kept = set(_written), []
    yield kept
    keep = {getattr(df, "_materialized_at", None) for df in kept}
    for path in [p for p in _written if p not in known and p not in keep and p not in _lasting]:
        _discard(path)
    for df in last:
        release(df)


def _discard(path: str) -> None:
    spark = _written.pop(path)
    if path in _names:
        spark.sql(f"DROP TABLE IF EXISTS {_names.pop(path)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        try:
            _discard(path)
        except Exception:  # noqa: S112 - a session or its JVM may be gone; the others' tables still have to go
            continue
