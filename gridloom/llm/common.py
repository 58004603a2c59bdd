"""What the training-data operators share: the shared scratch folder, staged tables and text batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_BYTES = 16 << 20
_own: dict[str, str] = {}
_open: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made, but only in local mode,
    where every executor is this machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/") + "/gridloom"
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return _own[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.gridloom_path = path
    if _open:
        _open[-1].append(out)
    release(spark)
    return out


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches for Python workers hold a bounded number of bytes, however long the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, old)


@contextmanager
def temporaries() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside goes at the end, but for tables that the function given here is called with (results read them later)."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(own)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _open.remove(own)
        for df in own:
            if not any(df is k for k in kept):
                drop_staged(df)
            elif _open:
                # the result of an operator inside another one goes with that one's
                _open[-1].append(df)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs: it does so once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    spark, path = df.sparkSession, df.gridloom_path
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def hot_join(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n", most: int = 1000) -> DataFrame:
    """Inner join with a staged table that has a row per key and counts in ``n`` how many of ``rows`` have it.

    Keys with more than one in ``most`` of the rows are fewer than ``most``: they
    go to all tasks, and their rows stay where they are. All others are shuffled.
    """
    limit = (counted.agg(F.sum(n)).first()[0] or 0) / most
    hot = F.broadcast(counted.filter(F.col(n) > limit))
    if hot.isEmpty():
        return rows.join(counted, keys)
    cold = rows.join(F.broadcast(counted.filter(F.col(n) > limit).select(keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(counted.filter(F.col(n) <= limit), keys))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and path; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``max_bytes`` of text each (a longer text comes alone, whole)."""
    for batch in batches:
        column, start, size, held = batch.column(text).cast(pa.binary()), 0, 0, []
        for i, value in enumerate(column):
            value = value.as_py() or b""
            if held and size + len(value) > max_bytes:
                yield batch.slice(start, i - start), held
                start, size, held = i, 0, []
            held.append(value)
            size += len(value)
        if held:
            yield batch.slice(start), held
