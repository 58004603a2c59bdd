"""Lossless coding of integer blocks and the self-describing block header."""

from __future__ import annotations

import functools
import heapq
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

VERSION = (1, 0, 0)
HEADER = "struct<version:string,shape:array<int>,dtype:string,norm:string,s:double,mode:string,tolerance:double,norm_value:double,hierarchy:string,levels:int,quantization:string,codec:string>"


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code length of each symbol with a count; 0 for the others."""
    out = np.zeros(len(counts), np.int64)
    heap = [(int(c), int(i), (int(i),)) for i, c in enumerate(counts) if c]
    if len(heap) == 1:
        out[heap[0][1]] = 1
        return out
    heapq.heapify(heap)
    while len(heap) > 1:
        a, i, x = heapq.heappop(heap)
        b, j, y = heapq.heappop(heap)
        out[[*x, *y]] += 1
        heapq.heappush(heap, (a + b, min(i, j), x + y))
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for i in sorted(np.flatnonzero(lengths), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - before
        codes[i], before, code = code, int(lengths[i]), code + 1
    return codes


def huffman_encode(values: np.ndarray) -> bytes:
    """A self-contained block: symbols, code lengths, bits."""
    symbols, index = np.unique(values, return_inverse=True)
    lengths = code_lengths(np.bincount(index, minlength=len(symbols)))
    codes = canonical(lengths)
    own, size = codes[index], lengths[index]
    ends = np.cumsum(size)
    place = np.repeat(ends, size) - 1 - np.arange(int(ends[-1]) if len(ends) else 0)
    bits = (np.repeat(own, size) >> place.astype(np.uint64)) & np.uint64(1)
    return struct.pack("<qq", len(values), len(symbols)) + symbols.astype("<i8").tobytes() + lengths.astype("u1").tobytes() + np.packbits(bits.astype(np.uint8)).tobytes()


def huffman_decode(data: bytes) -> np.ndarray:
    n, k = struct.unpack_from("<qq", data)
    symbols = np.frombuffer(data, "<i8", k, 16)
    lengths = np.frombuffer(data, "u1", k, 16 + 8 * k).astype(np.int64)
    codes = canonical(lengths)
    raw = np.unpackbits(np.frombuffer(data, np.uint8, offset=16 + 9 * k))
    widest = int(lengths.max(initial=1))
    if widest > 20:
        return _decode_bits(raw, symbols, lengths, codes, n)
    # the next ``widest`` bits at every place say which symbol begins there
    window = np.zeros(len(raw), np.int64)
    for b in range(widest):
        window[: len(raw) - b] |= raw[b:].astype(np.int64) << (widest - 1 - b)
    order = np.argsort(codes << (widest - lengths).astype(np.uint64), kind="stable")
    which = order[np.searchsorted((codes << (widest - lengths).astype(np.uint64))[order], window.astype(np.uint64), "right") - 1] if k else window
    steps, out, at = lengths[which].tolist() if k else [], np.empty(n, np.int64), 0
    for i in range(n):
        out[i] = at
        at += steps[at]
    return symbols[which[out]] if n else out


def _decode_bits(raw: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Bit by bit, for codes too long for windows."""
    table = {(int(size), int(c)): i for i, (size, c) in enumerate(zip(lengths, codes, strict=True))}
    out, code, size, at = np.empty(n, np.int64), 0, 0, 0
    for bit in raw.tolist():
        if at == n:
            break
        code, size = code << 1 | bit, size + 1
        if (i := table.get((size, code))) is not None:
            out[at], at, code, size = symbols[i], at + 1, 0, 0
    return out


@functools.cache
def _zstd_context(level: int | None):
    """One context a process for each level, None to decompress: making one takes longer than coding a short block."""
    import zstandard

    return zstandard.ZstdDecompressor() if level is None else zstandard.ZstdCompressor(level=level)


def _zstd(data: bytes, level: int = 3) -> bytes:
    return _zstd_context(level).compress(data)


def _unzstd(data: bytes) -> bytes:
    return _zstd_context(None).decompress(data)


CODECS = {
    "raw": (lambda v: v.astype("<i8").tobytes(), lambda b: np.frombuffer(b, "<i8")),
    "zlib": (lambda v: zlib.compress(v.astype("<i8").tobytes(), 9), lambda b: np.frombuffer(zlib.decompress(b), "<i8")),
    "zstd": (lambda v: _zstd(v.astype("<i8").tobytes()), lambda b: np.frombuffer(_unzstd(b), "<i8")),
    "huffman": (huffman_encode, huffman_decode),
    "huffman+zstd": (lambda v: _zstd(huffman_encode(v)), lambda b: huffman_decode(_unzstd(b))),
}


def encode(values: np.ndarray, codec: str) -> tuple[str, bytes]:
    """The codec used and the payload; raw where coding doesn't make it smaller."""
    coded = CODECS[codec][0](values)
    return (codec, coded) if len(coded) < 8 * len(values) else ("raw", CODECS["raw"][0](values))


#: Entries of arrays, or bytes of payloads, that a Python worker takes apart at a time, and rows at most.
PIECE, PIECE_ROWS = 1 << 16, 1024


def pieces(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], Sequence[int]], most: int = PIECE, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose rows' sizes add up to ``most`` (a larger row comes alone, whole): what a worker makes of them is bounded, however many rows a batch has."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(sizes(batch)):
            if i > start and (held + size > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def entries(column: str) -> Callable[[pa.RecordBatch], list[int]]:
    """Sizes of the arrays in a column, for ``pieces``."""
    return lambda batch: pc.fill_null(pc.list_value_length(batch[column]), 0).to_pylist()


def payloads(batch: pa.RecordBatch) -> list[int]:
    return pc.fill_null(pc.binary_length(batch["payload"]), 0).to_pylist()


def arrays(column: pa.Array) -> list[np.ndarray]:
    """Each row of a column of arrays."""
    return column.to_pandas().tolist()


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as a column, without an object for each entry."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows), kind))


def encode_blocks(blocks: DataFrame, codec: str = "huffman+zstd") -> DataFrame:
    """``blocks`` (block_id, q array) as (block_id, codec, payload, raw_bytes); whole blocks, a bounded number of nodes at a time."""

    def run(batches):
        for piece in pieces(batches, entries("q")):
            rows = [np.asarray(q, np.int64) for q in arrays(piece["q"])]
            made = [encode(q, codec) for q in rows]
            yield pa.RecordBatch.from_arrays([piece["block_id"], pa.array([c for c, _ in made], pa.string()), pa.array([b for _, b in made], pa.binary()), pa.array([8 * len(q) for q in rows], pa.int64())], names=["block_id", "codec", "payload", "raw_bytes"])

    return blocks.select("block_id", "q").mapInArrow(run, "block_id long, codec string, payload binary, raw_bytes long")


def decode_blocks(coded: DataFrame) -> DataFrame:
    def made(ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, lists(rows, pa.int64())], names=["block_id", "q"])

    def run(batches):
        for piece in pieces(batches, payloads):
            start, rows, held = 0, [], 0
            for i, (c, b) in enumerate(zip(piece["codec"].to_pylist(), piece["payload"].to_pylist(), strict=True)):
                rows.append(CODECS[c][1](b))
                held += len(rows[-1])
                # a short payload may hold many values
                if held >= PIECE:
                    yield made(piece["block_id"].slice(start, len(rows)), rows)
                    start, rows, held = i + 1, [], 0
            if rows:
                yield made(piece["block_id"].slice(start), rows)

    return coded.select("block_id", "codec", "payload").mapInArrow(run, "block_id long, q array<long>")


def with_header(coded: DataFrame, **fields) -> DataFrame:
    """Adds the header and its checksum."""
    version = ".".join(map(str, VERSION))
    values = {"version": version, "mode": "absolute", "hierarchy": "dyadic", "quantization": "int64", "codec": F.col("codec")} | fields
    kinds = T._parse_datatype_string(HEADER)
    header = F.struct(*[(values[f.name] if not isinstance(values.get(f.name), (str, float, int, list, type(None))) else F.array(*map(F.lit, values[f.name])) if isinstance(values.get(f.name), list) else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in kinds.fields])
    return coded.withColumn("header", header).withColumn("header_crc", F.crc32(F.to_json("header").cast("binary")))


def checked(coded: DataFrame) -> DataFrame:
    """Raises where a header was changed or was written by a later major version."""
    major = F.split("header.version", r"\.")[0].cast("int")
    ok = (F.crc32(F.to_json("header").cast("binary")) == F.col("header_crc")) & (major <= VERSION[0])
    return coded.withColumn("header", F.when(ok, F.col("header")).otherwise(F.raise_error(F.lit("the header is damaged or too new"))))


def inferred(coded: DataFrame) -> DataFrame:
    """What a block is, from its header alone: payloads are neither read nor decoded."""
    h = F.col("header")
    nodes = F.aggregate(h["shape"], F.lit(1).cast("long"), lambda a, n: a * n)
    return checked(coded).select("block_id", h["version"].alias("version"), F.size(h["shape"]).alias("dims"), nodes.alias("nodes"), h["dtype"].alias("dtype"), h["levels"].alias("levels"), (h["mode"] == "relative").alias("relative"), h["tolerance"].alias("tolerance"), h["codec"].alias("codec"))
