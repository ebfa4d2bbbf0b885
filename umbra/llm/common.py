"""What the training-data operators share: the shared folder, stored intermediate tables, Arrow byte views."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra import workers

#: Text bytes that one step of a Python task works on at a time (one longer text is one step).
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch that Spark hands to a Python task, where the session doesn't say.
BATCH_BYTES = 4 << 20

#: The column that numbered() adds. Names that begin with __umbra_ are this library's; any other column may be in a table.
ROW = "__umbra_row"


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each Spark application, and bound Arrow batches by bytes: rows may be long."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    workers.ship(spark)


def lean(run: Callable, *forget: Callable) -> Callable:
    """run over Arrow batches, and at the end of the task call `forget` and give memory back: Spark reuses Python workers for other steps."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return task


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own beside the warehouse or, in local mode, in /tmp."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="umbra-shared-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_umbra"
        spark.conf.set("spark.checkpoint.dir", found)
    if ":" not in found:  # a path of Spark's default file system, whatever reads it
        default = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).toString()
        found = ("file://" if default.startswith("file:") else default.rstrip("/")) + os.path.abspath(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/umbra-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps survive lost executors and don't compute it again."""
    path, spark, schema = scratch(df.sparkSession, name), df.sparkSession, df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """docs (all columns) with a number of each row, stored, so that a row has the same number whenever it is read."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def without(rows: DataFrame, hit: DataFrame) -> DataFrame:
    """Numbered rows without those whose number is in hit (one column), and without the number."""
    return rows.join(hit.toDF("__umbra_hit"), F.col(ROW) == F.col("__umbra_hit"), "left_anti").drop(ROW)


def renamed(docs: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """docs with names that clash with nothing, and these names with their types."""
    names = [f"__umbra_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [(n, f.dataType.simpleString()) for n, f in zip(names, docs.schema.fields, strict=True)]


def tidy(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop shuffle files of finished steps."""
    for path in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        if path.rpartition("/")[2].startswith("umbra-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def id_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns that operators need, whatever else the table holds."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def bytes_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and each row's bounds in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, at = len(column), column.offset
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column has at most `most` bytes in each, or is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False), np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


_FACTOR, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch first..last of the data, eight bytes at a time."""
    size = last - first
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    with np.errstate(over="ignore"):
        out = (size.astype(np.uint64) + np.uint64(1)) * _FACTOR
        live, at = np.arange(len(first)), 0
        while len(live):
            word = eight[first[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]
            h = (out[live] ^ word) * _MORE
            out[live] = (h ^ (h >> np.uint64(29))) * _FACTOR + np.uint64(at)
            at += 8
            live = live[size[live] > at]
        return out ^ (out >> np.uint64(32))


def record(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in arrays], names)
