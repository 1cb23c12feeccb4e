"""Places and small table helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as one string: space and U+0009 to U+000D.
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: A word, as a pattern that Java, Python and RE2 read alike.
WORD = "[^\\x20\\x09-\\x0D]+"


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting (a test) gets a folder of its own: on a
    cluster each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-caseloom-", dir="/tmp")
    return _own_dirs[app]


#: Rows of an Arrow batch: texts of a megabyte each are then a gigabyte at most, usual ones a few megabytes.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its JVM hold at once; a session's own smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


#: Folders of the tables that ``materialize`` wrote.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as zstd Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so that later jobs
    neither recompute the text pass nor depend on one machine's disk.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _folders[written] = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` whose last reader has been written as a table itself."""
    for df in written:
        hadoop = df.sparkSession.sparkContext
        path = hadoop._jvm.org.apache.hadoop.fs.Path(_folders.pop(df))
        path.getFileSystem(hadoop._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, rows: int, width: int) -> DataFrame:
    """A table of ``rows`` counted rows of about ``width`` bytes as a join's side: broadcast if short, else joined by a shuffle."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files behind tables that are written by now: its cleaner
    follows the driver's garbage collection, which a driver with little to do may not run for long."""
    spark.sparkContext._jvm.java.lang.System.gc()


def lean(rows):
    """``rows`` (what mapInArrow or applyInArrow calls) which gives memory that it freed back to the system when a
    task ends: workers stay alive between tasks, beside those of other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            _give_back()

    return task


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


#: What operators keep in a Python worker from task to task, by their names.
worker_caches: dict[str, dict] = {}


def forget_others(own: str) -> None:
    """Let go what other operators keep in this worker: one that goes on to another stage needn't hold the last one's words."""
    held = [cache for name, cache in worker_caches.items() if name != own and cache]
    for cache in held:
        cache.clear()
    if held:
        gc.collect()
        _give_back()


def let(value, body):
    """Bind a column expression to a lambda variable so that ``body`` reads it
    many times while it is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def count_words(text):
    """Words of a text column; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
