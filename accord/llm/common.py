"""Shared-folder tables, size-checked broadcasts and Arrow helpers of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast (a row here is at most a few numbers and a short string, so all of them some 10 MB); beyond it, joins shuffle.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset in a local session (tests), a folder of this process, set for the session. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="accord-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean, spark)
    _MADE.append(path)
    return path


def _clean(spark: SparkSession) -> None:
    try:
        for path in _MADE:
            _delete(spark, path)
    except Exception:  # the session is gone: the files stay for whoever keeps the shared folder
        return


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(spark, folder)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (counted, unless told), else df as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def cutoff(df: DataFrame, column: str, most: int, steps: int = 64) -> float:
    """A value that at most `most` rows reach in a column of positive numbers, from a histogram of their logarithms (some thousand bins at most, whatever the rows); the least value if no more rows are there."""
    bins = df.filter(F.col(column) > 0).groupBy(F.floor(F.log2(column) * steps).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least")).collect()
    total, least = 0, float("inf")
    for r in sorted(bins, key=lambda r: -r["b"]):
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return least


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch between Spark and a worker; Spark's own limit is four times as much.
BATCH = 4 << 20


def lean(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH bytes: both sides of the pipe keep whole batches."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(limit)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH:
        spark.conf.set(limit, str(BATCH))


def released(f: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]):
    """f, after which a worker gives unused memory back: workers outlive their tasks."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def rested(spark: SparkSession) -> None:
    """Let executors collect their garbage, so that heaps grown by one stage of a pipeline go back to the system before the next one: Python workers share an executor's memory with its heap. Tasks are as many as slots, so every executor gets some; a JVM that ignores the call changes nothing."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str, most: int = 4 << 20, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a function of one batch; batches are cut into pieces of about `most` bytes, so long texts stay within memory. done: called at the end of a task."""

    def run(batches):
        try:
            for batch in batches:
                for piece in pieces(batch, most):
                    made = f(piece)
                    if isinstance(made, pa.RecordBatch):
                        yield made
                    else:
                        yield from made
        finally:
            if done:
                done()

    lean(df.sparkSession)
    return df.mapInArrow(released(run), schema)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def with_texts(documents: DataFrame, *others: str) -> DataFrame:
    """doc_id, text and the named columns only: other columns of any name play no part."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
