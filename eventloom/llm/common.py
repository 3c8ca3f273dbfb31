"""What several operators of this subpackage share: the shared folder, written
intermediate tables and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = "4000", "8388608"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``; only where that is unset (a local session)
    a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        own = tempfile.mkdtemp(prefix="eventloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends, on any file system."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_end, spark, path)
    for own in _RECORDED:
        own.append(path)
    return path


#: Lists that get the paths made while they are here.
_RECORDED: list[list[str]] = []


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """All paths made inside are added to the list."""
    _RECORDED.append(paths)
    try:
        yield
    finally:
        _RECORDED.pop()


def release(spark: SparkSession, paths: list[str], needed_by: DataFrame) -> None:
    """Delete intermediate tables, unless the frame still reads any of them."""
    read = needed_by.inputFiles()
    for path in [p for p in paths if not any(p.rpartition("/")[2] in f for f in read)]:
        remove(spark, path)
        paths.remove(path)


def _at_end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut,
    and losing executors costs no more than reading the table again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a row id that is data: it is drawn once and written, so that every
    later read of a row has the same, however ``docs`` was made."""
    return written(docs.withColumn(row, row_id()), "numbered")


#: Rows of ids alone that are broadcast at most.
FEW = 200_000


def few(ids: DataFrame) -> DataFrame:
    """A (written) table of ids, to be broadcast where its counted rows allow; a join
    with it gives the same either way."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such allocator
        ctypes.CDLL(None).malloc_trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, which shrinks a heap that has grown: otherwise
    it keeps the largest size that any stage took, beside the Python workers of the next. One
    task a core, so that an idle executor gets some; which do decides on memory alone."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def slices(batch: pa.RecordBatch, rows: int = 200, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch's rows some at a time, by number and by bytes of their texts."""
    at = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    i = 0
    while i < batch.num_rows:
        j = min(i + rows, max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + size, side="right"))))
        yield batch.slice(i, j - i)
        i = j


def free_name(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.StringArray:
    """The column as strings with 32-bit offsets, nulls as empty texts."""
    col = batch.column(name)
    col = col.cast(pa.string()) if not pa.types.is_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    return col


def bytes_of(col: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and the offsets in them."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_id() -> F.Column:
    """A number for each row of one evaluation. Another evaluation of the same frame may
    number its rows otherwise, so rows are joined by it only once it is written."""
    return F.monotonically_increasing_id()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
