"""Training-order materialisation: fixed-stride binary shards in a keyed pseudo-random order.

1. Documents become one stream of token ids per task, an end id after each,
   cut into sequences of ``seq_len`` ids; the table of sequences is staged, so
   that every sequence has one dense number, whatever is computed again.
2. A keyed Feistel network with cycle walking permutes the numbers: each
   sequence gets a global slot, and the number can be had back from the slot.
3. Slots are dealt by range: a partition holds consecutive shards, a shard
   ``shard_sequences`` consecutive slots, and the record of a slot lies at
   (slot mod shard_sequences) * stride. The number of partitions grows with the
   data, so none holds more than ``SHARDS_PER_TASK`` shards.
   A reader resumes at any slot with one seek. A shard is written under the
   attempt's own name and is known by the committed table only.

Ids take two bytes where the vocabulary allows, else four, little-endian; the
last sequence of a task is filled up with the end id. Null text is empty: just
an end id. Repeated rows are written as often as they come. An empty table
makes no shard. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import open_fs, scratch_path, shuffle_partitions, stage
from .tokens import WordIds, spread
from .words import word_chunks

SHARDS_PER_TASK = 32
SEQUENCES = "task long, place long, n_tokens int, doc_ids array<long>, ids binary"


class Feistel:
    """A keyed permutation of range(n): balanced rounds on 2k bits, walked until the value lies in the range."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        z = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(27))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> shift, x & mask
        for key in self.keys[::-1] if back else self.keys:
            left, right = (right ^ self._mix(left, key), left) if back else (right, left ^ self._mix(right, key))
        return left << shift | right

    def __call__(self, numbers: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(numbers.astype(np.uint64), back)
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)


def sequences(documents: DataFrame, tokenizer: str | None, seq_len: int, end_id: int) -> DataFrame:
    """All sequences, each with the ids of the documents that it holds parts of."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ids, task, place = WordIds(tokenizer), TaskContext.get().partitionId(), 0
        kind = np.dtype("<u2" if words_ids.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # what the last chunk left: ids, and where they are whose
        rest, docs, begins, ends = np.zeros(0, np.uint32), pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def batch_of(ids: np.ndarray, n_tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
            n, size = len(n_tokens), seq_len * kind.itemsize
            offsets = pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int64))
            packed = pa.Array.from_buffers(pa.large_binary(), n, [None, offsets, pa.py_buffer(ids.astype(kind).tobytes())]).cast(pa.binary())
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)), docs.take(pa.array(spread(lo, hi - lo))))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, task)), pa.array(place + np.arange(n)), pa.array(n_tokens.astype(np.int32)), held, packed], names=["task", "place", "n_tokens", "doc_ids", "ids"])

        for words in word_chunks(batches, "text"):
            ids, first = words_ids.documents(words, end_id)
            docs = pa.concat_arrays([docs, words.batch["doc_id"]])
            begins, ends = np.concatenate([begins, first[:-1] + len(rest)]), np.concatenate([ends, first[1:] + len(rest)])
            rest = np.concatenate([rest, ids])
            whole = len(rest) // seq_len
            if whole:
                at = seq_len * np.arange(whole)
                yield batch_of(rest[: whole * seq_len], np.full(whole, seq_len), np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + seq_len, "left"))
                place, gone = place + whole, whole * seq_len
                left = int(np.searchsorted(ends, gone, "right"))
                rest, docs, begins, ends = rest[gone:], docs[left:], np.maximum(0, begins[left:] - gone), ends[left:] - gone
        if len(rest):
            n = len(rest)
            yield batch_of(np.concatenate([rest, np.full(seq_len - n, end_id, np.uint32)]), np.asarray([n]), np.zeros(1, np.int64), np.asarray([len(docs)]))

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, SEQUENCES)


def placed(staged: DataFrame, key: int, shard_sequences: int) -> tuple[DataFrame, int]:
    """The staged sequences with number, slot and shard; ids compressed for the shuffle. And how many there are."""
    # a count per task that wrote: as many rows as the input has partitions
    counts = staged.groupBy("task").agg(F.count("*").alias("n")).orderBy("task").collect()
    n = sum(r["n"] for r in counts)
    tasks = np.asarray([r["task"] for r in counts], np.int64)
    before = np.cumsum([0, *(r["n"] for r in counts)])
    order = Feistel(max(1, n), key)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            own = before[np.searchsorted(tasks, batch["task"].to_numpy())] + batch["place"].to_numpy()
            slot = order(own)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(slot), pa.array(slot // shard_sequences), batch["n_tokens"], batch["doc_ids"], pa.array(map(pack, batch["ids"].to_pylist()), pa.binary())], names=["number", "slot", "shard", "n_tokens", "doc_ids", "packed"])

    return staged.mapInArrow(number, "number long, slot long, shard long, n_tokens int, doc_ids array<long>, packed binary"), n


def _by_range(rows: DataFrame, n_sequences: int, shard_sequences: int) -> DataFrame:
    """Rows (shard, slot) in order, consecutive shards together: as many partitions as the shards need."""
    shards = max(1, -(-n_sequences // shard_sequences))
    parts = min(shards, max(shuffle_partitions(rows.sparkSession), -(-shards // SHARDS_PER_TASK)))
    each = -(-shards // parts)
    return rows.repartitionById(parts, F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")


def write_shards(sequences: DataFrame, folder: str, shard_sequences: int, n_sequences: int) -> DataFrame:
    """A file per shard; a row per sequence with its file, byte offset and stride."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, (fs, base) = zstandard.ZstdDecompressor().decompress, open_fs(folder)
        fs.create_dir(base, recursive=True)
        task, now, out, name = TaskContext.get().taskAttemptId(), None, None, ""
        for batch in batches:
            offsets, names, strides, crcs = [], [], [], []
            for shard, slot, packed in zip(batch["shard"].to_pylist(), batch["slot"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                if shard != now:
                    if out is not None:
                        out.close()
                    now, name = shard, f"shard-{shard:08d}-{task}.bin"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                ids = unpack(packed)
                if out.tell() != slot % shard_sequences * len(ids):
                    raise ValueError(f"shard {shard} misses a slot before {slot}")
                offsets.append(out.tell())
                out.write(ids)
                names.append(name)
                strides.append(len(ids))
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([batch["number"], batch["slot"], batch["shard"], batch["n_tokens"], batch["doc_ids"], pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(strides, pa.int32()), pa.array(crcs, pa.int64())], names=["number", "slot", "shard", "n_tokens", "doc_ids", "file", "byte_offset", "stride", "ids_crc32"])
        if out is not None:
            out.close()

    return _by_range(sequences, n_sequences, shard_sequences).mapInArrow(write, "number long, slot long, shard long, n_tokens int, doc_ids array<long>, file string, byte_offset long, stride int, ids_crc32 long")


def read_slots(written: DataFrame, folder: str, first: int = 0) -> DataFrame:
    """The records from slot ``first`` on, read in order shard by shard and checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), now, handle = open_fs(folder), None, None
        for batch in batches:
            for file, offset, stride, crc in zip(batch["file"].to_pylist(), batch["byte_offset"].to_pylist(), batch["stride"].to_pylist(), batch["ids_crc32"].to_pylist(), strict=True):
                if file != now:
                    if handle is not None:
                        handle.close()
                    now, handle = file, fs.open_input_file(f"{base}/{file}")
                handle.seek(offset)
                if zlib.crc32(handle.read(stride)) != crc:
                    raise ValueError(f"{file} at {offset}: other ids than were written")
            yield batch
        if handle is not None:
            handle.close()

    # as staged, a file of the table is a partition's slots in order: only its order among them is to be had back
    shape = written.agg(F.count("*").alias("n"), F.max(F.when(F.col("shard") == 0, F.col("slot"))).alias("last")).first()
    return _by_range(written.filter(F.col("slot") >= first), shape["n"], (shape["last"] or 0) + 1).mapInArrow(read, written.schema)


def materialise(documents: DataFrame, folder: str | None = None, tokenizer: str | None = None, seq_len: int = 4096, end_id: int = 1, key: int = 1, shard_sequences: int = 512) -> tuple[DataFrame, str]:
    """Write ``documents`` (doc_id, text) in training order; the table of sequences and the shards' folder."""
    folder = folder or scratch_path(documents.sparkSession, "shards")
    staged = stage(sequences(documents, tokenizer, seq_len, end_id), "order-sequences")
    rows, n = placed(staged, key, shard_sequences)
    return stage(write_shards(rows, folder, shard_sequences, n), "order-written"), folder
