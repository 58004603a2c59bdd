"""Sources and sinks: raw binary fields, fragments by level and plane, time steps, meshes, seeded values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_raw(spark: SparkSession, path: str, dtype: str = "<f8") -> DataFrame:
    """block_id, path, data: a block per raw file."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "data": [np.frombuffer(b, dtype).astype(float).tolist() for b in pdf["content"]]})

    rows = files.select("path", "content").mapInPandas(run, "path string, data array<double>")
    return rows.select(F.xxhash64("path").alias("block_id"), "path", "data")


def read_steps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several time steps as one table, the step's name in ``step``."""
    return spark.read.parquet(*paths).withColumn("step", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1))


def seeded(spark: SparkSession, n: int, seed: int = 7117) -> DataFrame:
    """i, value: whole numbers from 1 to 10."""
    return spark.range(n).select(F.col("id").alias("i"), (F.floor(F.rand(seed) * 10) + 1).cast("double").alias("value"))


def write_fragments(fragments: DataFrame, path: str) -> None:
    """A folder per level and bit plane, so that a request reads only what it needs."""
    fragments.repartition("level", "bitplane").write.mode("overwrite").partitionBy("level", "bitplane").parquet(path)


def read_fragments(spark: SparkSession, path: str, level: int | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """Fragments of planes start to stop - 1: a partition filter, other folders aren't opened."""
    df = spark.read.parquet(path)
    if level is not None:
        df = df.filter(F.col("level") <= level)
    df = df.filter(F.col("bitplane") >= start)
    return df if stop is None else df.filter(F.col("bitplane") < stop)


def read_block_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Blocks low to high - 1 of a block table; the filter reaches the scan."""
    return spark.read.parquet(path).filter((F.col("block_id") >= low) & (F.col("block_id") < high))


def read_gmsh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """node(id, x, y, z) and element(id, kind, nodes) of Gmsh 2.2 text files; a mesh file is one row."""
    kinds = {1: "line", 2: "tri", 4: "tet"}
    whole = spark.read.text(path, wholetext=True)
    section = lambda name: F.regexp_extract("value", rf"(?s)\${name}\s+\d+\s+(.*?)\s*\$End{name}", 1)
    lines = lambda name: whole.select(F.explode(F.split(section(name), r"\r?\n")).alias("l")).select(F.split("l", r"\s+").alias("p")).filter(F.size("p") >= 4)
    nodes = lines("Nodes").select(F.col("p")[0].cast("int").alias("id"), *[F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    kind = F.element_at(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))]), F.col("p")[1].cast("int"))
    tags = F.col("p")[2].cast("int")
    elements = lines("Elements").select(F.col("p")[0].cast("int").alias("id"), kind.alias("kind"), F.transform(F.slice("p", tags + 4, F.size("p")), lambda x: x.cast("int")).alias("nodes")).filter("kind is not null")
    return nodes, elements


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_levels(fragments: DataFrame, folder: str, parts: int = 1) -> DataFrame:
    """Fragments one after the other, in files of a level (``parts`` of them), planes in order; a row per fragment with its file, offset and size.

    A file bears its attempt's name, and only what the returned table names counts: write that table before reading.
    """

    def write(batches):
        (fs, base), now, out = _open(folder), None, None
        fs.create_dir(base, recursive=True)
        for batch in batches:
            names, offsets = [], []
            for level, part, payload in zip(batch["level"].to_pylist(), batch["part"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                if (level, part) != now:
                    if out is not None:
                        out.close()
                    now, name = (level, part), f"level-{level:02d}-{part:05d}-{TaskContext.get().taskAttemptId()}.bin"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                names.append(name)
                offsets.append(out.tell())
                out.write(payload)
            keep = [c for c in batch.schema.names if c not in ("payload", "part")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(names, pa.string()), pa.array(offsets, pa.int64())], names=[*keep, "file", "offset"])
        if out is not None:
            out.close()

    rows = fragments.withColumn("part", F.pmod(F.xxhash64("block_id"), F.lit(parts)).cast("int"))
    kept = [f"`{c}` {t}" for c, t in rows.dtypes if c not in ("payload", "part")]
    return rows.repartition("level", "part").sortWithinPartitions("level", "part", "bitplane", "block_id").mapInArrow(write, ", ".join([*kept, "file string", "offset long"]))


def read_ranges(index: DataFrame, folder: str) -> DataFrame:
    """The fragments of an index (or of what a request left of it), by byte ranges; payload instead of file and offset."""

    def read(batches):
        (fs, base), now, handle = _open(folder), None, None
        for batch in batches:
            payloads = []
            for name, offset, size in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["size"].to_pylist(), strict=True):
                if name != now:
                    if handle is not None:
                        handle.close()
                    now, handle = name, fs.open_input_file(f"{base}/{name}")
                handle.seek(offset)
                payloads.append(handle.read(size))
            keep = [c for c in batch.schema.names if c not in ("file", "offset")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(payloads, pa.binary())], names=[*keep, "payload"])
        if handle is not None:
            handle.close()

    kept = [f"`{c}` {t}" for c, t in index.dtypes if c not in ("file", "offset")]
    return index.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, ", ".join([*kept, "payload binary"]))


def write_raw(blocks: DataFrame, folder: str, dtype: str = "<f8") -> DataFrame:
    """A raw file per block (block_id, data); a row per file with its size. Written under the attempt's name, then renamed, so a repeated task leaves whole files."""

    def write(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            sizes = []
            for block, data in zip(pdf["block_id"], pdf["data"], strict=True):
                raw, own = np.asarray(data, float).astype(dtype).tobytes(), f"{base}/.{block}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(own, compression=None) as out:
                    out.write(raw)
                fs.move(own, f"{base}/{block}.bin")
                sizes.append(len(raw))
            yield pd.DataFrame({"block_id": pdf["block_id"], "bytes": sizes})

    return blocks.select("block_id", "data").mapInPandas(write, "block_id long, bytes long")
