"""Helpers shared by the corpus operators: shared folders, table access and Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled by one round of array operations; bounds the temporaries of a worker.
SLICE_BYTES = 1 << 20


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="tesela-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables; it is never reused, so a retried job can't read stale rows."""
    path = f"{shared_base(spark)}/tesela/{name}-{uuid.uuid4().hex}"
    _work.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_work: dict[str, list[str]] = {}


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """What make returns, written to a folder of that name, and the folder; make's intermediate tables are deleted."""
    made = _work.setdefault(spark.sparkContext.applicationId, [])
    path, before = work_path(spark, name), len(made)
    out = materialize(make(), path)
    remove(spark, *made[before:])
    del made[before:]
    return out, path


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables that operators of this application have made.

    Results that aren't written yet read such tables, so write them first.
    """
    remove(spark, *_work.pop(spark.sparkContext.applicationId, []))


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet into a shared folder and read it back, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate folders through Hadoop's file system, whatever store they are in."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


#: Keys that count as hot at most; the rows of a hot key are more than a HOT_KEYS-th of all.
HOT_KEYS = 1000


def join_counted(
    left: DataFrame, right: DataFrame, key: str | list[str], count: str, total: int, strategy: str | None = None
) -> DataFrame:
    """left joined with right, which has one row for each key and, in count, the number of left's rows with it.

    total: left's rows, or more. Keys with more than a HOT_KEYS-th of them number less than HOT_KEYS, whatever the input, so
    their rows of right (which must be small) are broadcast, and their rows of left stay where they are; all others meet
    by a shuffle, with the strategy that is named.
    """
    bound = max(1, total // HOT_KEYS)
    hot = right.where(F.col(count) > bound)
    others = right.where(F.col(count) <= bound)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(others.hint(strategy) if strategy else others, key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large-string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a large-string array into runs of whole rows of about limit bytes.

    Yields (first row, row after the last, bytes, offsets from the slice's start). A row longer than limit
    comes alone.
    """
    n = len(column)
    if not n:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with this package on the executors' path; a worker is trimmed after each task."""
    ship_package(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim_worker()

    return df.mapInArrow(tidy, schema)


def trim_worker() -> None:
    """Give freed memory back to the system: Spark keeps idle workers, and the next stage's memory comes on top."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc has it
        libc.malloc_trim(0)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, unless PYTHONPATH already leads there."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(context.applicationId)
    target = Path(tempfile.mkdtemp(prefix="tesela-code-")) / "tesela.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for file in sorted((root / "tesela").rglob("*.py")):
            bundle.write(file, file.relative_to(root))
    context.addPyFile(str(target))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim_driver(spark: SparkSession) -> None:
    """Give back to the system what the driver's Python and JVM have freed, and the shuffle files of finished plans.

    The JVM's heap shrinks with its garbage. What its compiler has freed outside the heap stays with malloc until the JVM's
    command for that (Java 17.0.9 or later, with glibc) is run. Its bean is called through the interface, as Java hides the
    class; a JVM that lacks the command keeps that memory.
    """
    release_shuffles(spark)
    trim_worker()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    find = jvm.java.lang.Class.forName
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    values = (bean, "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0))
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.Object, 4)
    for k in range(4):
        kinds[k], given[k] = find(names[k]), values[k]
    call = find("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
    with contextlib.suppress(Py4JJavaError):
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
