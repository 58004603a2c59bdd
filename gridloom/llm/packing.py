"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: best-two-fit. A bin is filled greedily, largest piece that fits first;
if a gap is left, its smallest piece is taken out when two unpacked pieces fit
the widened gap more tightly. Pieces are packed in random groups of bounded
size, in parallel; the loosely filled bins of all groups are then taken apart
and packed again, group by group, so that groups cost almost nothing.

Only lengths are shuffled; token ids never leave the task that made them.
Null text is empty (a document of just the end id). Repeated rows are packed
as often as they come. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .tokens import WordIds
from .words import word_chunks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = PIECES + ", sequence_id long, offset long, fill long"


def pieces(documents: DataFrame, tokenizer: str | None, max_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """A row for every piece of at most ``max_tokens`` ids of every document (doc_id, text).

    ``tokenizer``: path of a tokenizers file, the same on all executors;
    None: that of the public word BPE.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids, salt = WordIds(tokenizer), TaskContext.get().partitionId() << 40
        for words in word_chunks(batches, "text"):
            ids, first = word_ids.documents(words, end_id)
            sizes = np.diff(first)
            counts = -(-sizes // max_tokens)
            owner = np.repeat(np.arange(words.n), counts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * max_tokens
            length = np.minimum(max_tokens, sizes[owner] - start)
            raw, begin = memoryview(ids.astype("<u4").view(np.uint8)), 4 * (first[owner] + start)
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([words.batch["doc_id"].take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(salt + np.arange(len(owner)))], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
            salt += len(owner)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class _Pool:
    """Unpacked pieces by length, and the sorted lengths that are left."""

    def __init__(self, lengths: np.ndarray):
        self.left: dict[int, list[int]] = {}
        for i in np.argsort(lengths, kind="stable")[::-1].tolist():
            self.left.setdefault(int(lengths[i]), []).append(i)
        self.sizes = sorted(self.left)

    def fitting(self, gap: int) -> int:
        at = bisect_right(self.sizes, gap)
        return self.sizes[at - 1] if at else 0

    def take(self, size: int) -> int:
        items = self.left[size]
        i = items.pop()
        if not items:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))
        return i

    def give(self, size: int, i: int) -> None:
        if size not in self.left:
            self.left[size] = []
            insort(self.sizes, size)
        self.left[size].append(i)

    def best_pair(self, gap: int) -> tuple[int, int]:
        """Lengths of the two unpacked pieces with the largest sum within ``gap``."""
        sizes = np.asarray(self.sizes[: bisect_left(self.sizes, gap)])
        if not len(sizes):
            return 0, 0
        other = np.searchsorted(sizes, gap - sizes, "right") - 1
        # two of one length need two pieces of it; else the next smaller one is the partner
        same = other == np.arange(len(sizes))
        single = np.fromiter((len(self.left[s]) == 1 for s in sizes[same].tolist()), bool, int(same.sum()))
        other[np.flatnonzero(same)[single]] -= 1
        sums = np.where(other >= 0, sizes + sizes[np.maximum(other, 0)], 0)
        k = int(sums.argmax())
        return (int(sizes[k]), int(sizes[other[k]])) if sums[k] else (0, 0)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths`` (each 1 to ``capacity``)."""
    pool, bins = _Pool(lengths), []
    while pool.sizes:
        held, gap = [], capacity
        while size := pool.fitting(gap):
            held.append((size, pool.take(size)))
            gap -= size
        if gap and len(pool.sizes):
            smallest = min(held)
            a, b = pool.best_pair(gap + smallest[0])
            if a + b > smallest[0]:
                held.remove(smallest)
                held += [(a, pool.take(a)), (b, pool.take(b))]
                pool.give(*smallest)
        bins.append([i for _, i in held])
    return bins


def _pack_group(capacity: int, level: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "salt")])
        lengths = rows["length"].to_numpy()
        bins = best_two_fit(lengths, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(lengths))
        sizes = np.fromiter(map(len, bins), np.int64, len(bins))
        lengths, starts = lengths[order], np.cumsum(sizes) - sizes
        before, fill = np.cumsum(lengths) - lengths, np.add.reduceat(lengths, starts)
        sequence = (level << 60) + (key[0].as_py() << 24) + np.repeat(np.arange(len(bins)), sizes)
        # Arrow keeps ids whole beside nulls
        rows = rows.take(pa.array(order)).select(["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        for name, values in (("sequence_id", sequence), ("offset", before - np.repeat(before[starts], sizes)), ("fill", np.repeat(fill, sizes))):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    return pack


def pack(staged: DataFrame, max_tokens: int = 4096, group_rows: int = 4096, loose: float = 0.995) -> DataFrame:
    """Pack a staged table of pieces; groups of about ``group_rows`` pieces, then once more those of loose bins."""

    def groups(df: DataFrame, by: list[str], n: int, level: int) -> DataFrame:
        keyed = df.withColumn("grp", F.pmod(F.xxhash64(*by), F.lit(max(1, -(-n // group_rows)))))
        return keyed.groupBy("grp").applyInArrow(_pack_group(max_tokens, level), PACKED)

    once = stage(groups(staged, ["salt"], staged.count(), 0), "packed")
    full = F.col("fill") >= int(loose * max_tokens)
    rest = once.filter(~full)
    n = rest.count()
    if n == 0:
        return once
    return once.filter(full).unionByName(groups(rest.select("doc_id", "piece", "start", "length", "ids_crc32", "salt"), ["salt"], n, 1))


def pack_documents(documents: DataFrame, tokenizer: str | None = None, max_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise ``documents`` (doc_id, text) and pack them; a row per piece."""
    return pack(stage(pieces(documents, tokenizer, max_tokens, end_id), "pieces"), max_tokens)
