"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over all
   documents; words outside the benchmark can't add to a passage's product with
   an item and count in its length only.
   Weights depend on the share of documents that hold a word, never on how many
   documents there are: words outside the benchmark all weigh ``STRANGE``, and
   a word in fewer than about ``LEAST_SHARE`` of the documents gains no more.
2. Passages (overlapping runs of 48 words) are weighted by TF-IDF, and a
   randomised SVD of all of them and of the items, its products made by the
   cluster's tasks, gives the latent space.
3. Every passage of every document is compared with every item in that space.
   Projection and product are linear, so each word's part of each product is
   one number, and passages are sums of them; where the cosine with an item
   reaches ``cosine`` the passage is a candidate. What holds too few of the
   item's words for step 4 (counted, so nothing is lost) is dropped at once.
4. A candidate is a leak if enough of the item's words come in order in the
   passage's neighbourhood (longest common subsequence), either nearly all of
   them, or, for a paraphrase, fewer together with the answer: the words of
   the item's last sentence.

The benchmark is handled in blocks of bounded size, so however large it is,
what goes to the executors is bounded.

Words are lower case without punctuation at either end. Null texts and items
are empty and match nothing; items of fewer than ``least_words`` words are
compared whole, as one run of words. Repeated rows each get their own result.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, stage
from .tokens import spread
from .words import Numbers, Words, normal, normal_hashes, word_chunks

SEGMENT = 16
SPAN = 3
RANK = 224
OVERSAMPLE = 16
BLOCK_ITEMS = 200
LEAST_SHARE = 1e-4
STRANGE = 3.0
HITS = 20_000
RUNS = 512
PIECE = 1_024


def in_order(item: list[int], passage: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit rows."""
    rows: dict[int, int] = {}
    for i, w in enumerate(item):
        rows[w] = rows.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    state = full
    for w in passage.tolist():
        if hit := rows.get(w, 0) & state:
            state = ((state + hit) | (state - hit)) & full
    return len(item) - state.bit_count()


def places_of(items: list[list[int]], words: int) -> np.ndarray:
    """Bit sets of the places that each word has in each item of at most 64 words."""
    out = np.zeros((len(items), words), np.uint64)
    for i, own in enumerate(items):
        if len(own) <= 64:
            for j, w in enumerate(own):
                out[i, w] |= np.uint64(1 << j)
    return out


def in_order_all(places: np.ndarray, sizes: np.ndarray, item: np.ndarray, found: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """``in_order`` of many items (of at most 64 words) and passages ``found[lo:hi]`` at once."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - sizes[item]).astype(np.uint64)
    state = full.copy()
    for j in range(int((hi - lo).max(initial=0))):
        at = lo + j
        hit = places[item, np.where(at < hi, found[np.minimum(at, len(found) - 1)], 0)] & state
        state = ((state + hit) | (state - hit)) & full
    return sizes[item] - np.bitwise_count(state)


def _answer(text: str) -> list[bytes]:
    """The words of the item's last sentence or line."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.split()]
    return [normal(w) for w in parts[-1].encode().split()] if parts else []


def read_items(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes], list[bytes]]]]:
    """Blocks of at most ``BLOCK_ITEMS`` items: id, words, answer."""
    block = []
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator(prefetchPartitions=False):
        words = [normal(w) for w in (row[1] or "").encode().split()]
        if words:
            block.append((row[0], words, _answer(row[1])))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def document_frequencies(documents: DataFrame, words: list[bytes]) -> tuple[np.ndarray, int, int]:
    """In how many documents each word occurs, how many documents there are, and how many passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, n, parts = Numbers(words), np.zeros(len(words) + 1, np.int64), 0, 0
        for chunk in word_chunks(batches, "text"):
            found = numbers(*normal_hashes(chunk)).astype(np.int64)
            held += np.bincount(np.unique(chunk.owner() * len(held) + found) % len(held), minlength=len(held))
            n, parts = n + chunk.n, parts + int(np.maximum(1, -(-chunk.counts // SEGMENT) - SPAN + 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(words) + 1)), pa.array(np.concatenate([[n, parts], held]))], names=["word", "n"])

    # a row per benchmark word: the block of items bounds them
    sums = documents.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) + 3, np.int64)
    out[sums["word"].to_numpy() + 2] = sums["n"].to_numpy()
    return out[2:], int(out[0]), int(out[1])


def weights(counts: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, the same for the same shares of documents."""
    idf = np.log((1 + LEAST_SHARE) / (counts / max(1, n) + LEAST_SHARE)) + 0.1
    idf[0] = 0.0
    return idf


def passages(chunk: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of all passages: runs of ``SPAN`` segments, a segment apart, the last one cut by the text's end."""
    counts = np.maximum(1, -(-chunk.counts // SEGMENT) - SPAN + 1)
    owner = np.repeat(np.arange(chunk.n), counts)
    begin = chunk.first[owner] + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    return owner, begin, np.minimum(begin + SEGMENT * SPAN, chunk.first[owner + 1])


def _segments(chunk: Words, counts: np.ndarray) -> np.ndarray:
    """The segment of each word, for ``counts`` segments in each text."""
    place = np.arange(chunk.first[-1]) - np.repeat(chunk.first[:-1], chunk.counts)
    return np.repeat(np.cumsum(counts) - counts, chunk.counts) + place // SEGMENT


def run_sums(table: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``table[index]`` over runs that begin at ``starts`` (``np.add.reduceat``, but by whole rows)."""
    sizes = np.diff(starts, append=len(index))
    if sizes.max(initial=0) > SEGMENT:
        # long runs in parts, then the parts
        parts = -(-sizes // SEGMENT)
        cuts = np.cumsum(parts) - parts
        inner = run_sums(table, index, np.repeat(starts - SEGMENT * cuts, parts) + SEGMENT * np.arange(int(parts.sum())))
        return run_sums(inner, np.arange(len(inner)), cuts)
    out, order = np.empty((len(starts), table.shape[1]), table.dtype), np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), RUNS):
        own = order[lo : lo + RUNS]
        at, size = starts[own], sizes[own]
        total = table[index[at]]
        for j in range(1, int(size[0])):
            more = int(np.searchsorted(-size, -j))
            total[:more] += table[index[at[:more] + j]]
        out[own] = total
    return out


def _moved(documents: DataFrame, words: list[bytes], idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A Q) for the TF-IDF passages A of all documents, rows of length one, in one pass: every task sums its passages' part."""
    table, square = (q * idf[:, None]).astype(np.float32), idf**2

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of, out = Numbers(words), np.zeros(table.shape)
        for chunk in word_chunks(batches, "text", 1 << 18):
            found = number_of(*normal_hashes(chunk))
            hits = np.flatnonzero(found)
            if not len(hits):
                continue
            # short texts get empty segments: every passage has SPAN of them
            counts = np.maximum(SPAN, -(-chunk.counts // SEGMENT))
            word, segment, n = found[hits], _segments(chunk, counts)[hits], int(counts.sum())
            starts = np.flatnonzero(np.diff(segment, prepend=-1))
            sums = np.zeros((n, table.shape[1]), np.float32)
            sums[segment[starts]] = run_sums(table, word, starts)
            squares = np.bincount(segment, square[word], n)
            size = sum(squares[j : n - SPAN + 1 + j] for j in range(SPAN))
            inner = sum(sums[j : n - SPAN + 1 + j] for j in range(SPAN))
            # no passage begins in the last segments of a text
            ends = np.cumsum(counts)[:-1]
            for j in range(1, SPAN):
                size[ends - j] = 0
            inner *= np.divide(1, size, out=np.zeros_like(size), where=size > 0).astype(np.float32)[:, None]
            # a word adds to its row what all passages over its segment have
            sums[:] = 0
            for j in range(SPAN):
                sums[j : n - SPAN + 1 + j] += inner
            order = np.argsort(word.astype(np.uint16) if len(idf) <= 1 << 16 else word, kind="stable")
            starts = np.flatnonzero(np.diff(word[order], prepend=-1))
            out[word[order[starts]]] += run_sums(sums, segment[order], starts)
        yield from pieces(out[lo : lo + PIECE] for lo in range(0, len(out), PIECE))

    def pieces(sums: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, x in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["piece", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(table.shape)
        for batch in batches:
            for i, v in zip(batch["piece"].to_pylist(), batch["v"], strict=True):
                out[i * PIECE : (i + 1) * PIECE] += np.frombuffer(v.as_buffer(), np.float32).reshape(-1, out.shape[1])
        yield from pieces(out[lo : lo + PIECE] for lo in range(0, len(out), PIECE))

    parts = stage(documents.select(F.col("text").cast("string")).mapInArrow(part, "piece int, v binary"), "decon-parts")
    # the driver adds what at most four tasks have added, a piece at a time
    sums = stage(parts.coalesce(4).mapInArrow(add, "piece int, v binary"), "decon-sums")
    drop_staged(parts)
    y = np.zeros(q.shape)
    for i, v in sums.toLocalIterator(prefetchPartitions=False):
        y[i * PIECE : (i + 1) * PIECE] += np.frombuffer(v, np.float32).reshape(-1, y.shape[1])
    drop_staged(sums)
    return y * idf[:, None]


def latent_space(documents: DataFrame, words: list[bytes], idf: np.ndarray, items: list[list[int]], weight: float, rank: int = RANK, seed: int = 0) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF passages of all documents, by a randomised range finder.

    One pass gives Y = A'A Q for random Q; the singular vectors are those of
    Y (Q'Y)^-1 Y', which is A'A on the space that Y spans.
    The items stand below the passages as further rows, each with ``weight``, so
    that the space holds what tells them apart.
    """
    width = min(rank + OVERSAMPLE, len(idf))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(idf), width)))[0]
    y = _moved(documents, words, idf, q)
    for own in items:
        w = idf[own] / np.sqrt((idf[own] ** 2).sum())
        np.add.at(y, own, weight * w[:, None] * (w @ q[own]))
    inner = q.T @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    # directions that no row has are noise
    some = values > 1e-6 * values[-1]
    return np.linalg.svd(y @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)[0][:, :rank]


def _contiguous(item: list[int], passage: np.ndarray) -> bool:
    return any(passage[i : i + len(item)].tolist() == item for i in np.flatnonzero(passage == item[0]).tolist())


def _products(chunk: Words, found: np.ndarray, table: np.ndarray, square: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages' products with all items, and their lengths: sums over segments, and sums of these."""
    counts = -(-chunk.counts // SEGMENT)
    segment, n = _segments(chunk, counts), int(counts.sum())
    sums, squares = np.zeros((n + SPAN, table.shape[1]), np.float32), np.bincount(segment, square[found], n + SPAN)
    hits = np.flatnonzero(found)
    if len(hits):
        starts = np.flatnonzero(np.diff(segment[hits], prepend=-1))
        sums[segment[hits[starts]]] = run_sums(table, found[hits], starts)
    # texts without words have a passage of no segment
    at = np.where(end > begin, segment[np.minimum(begin, max(0, len(segment) - 1))] if len(segment) else 0, n)
    last = np.where(end > begin, -(-(end - begin) // SEGMENT), 1)
    total, size = sums[at], squares[at]
    for j in range(1, SPAN):
        more = np.flatnonzero(last > j)
        total[more] += sums[at[more] + j]
        size[more] += squares[at[more] + j]
    return total, np.sqrt(size)


def _match(documents: DataFrame, items: list, words: list[bytes], idf: np.ndarray, strange: float, space: np.ndarray, cosine: float, verbatim: float, paraphrase: float, answer: float, least_words: int) -> DataFrame:
    lookup = {w: i + 1 for i, w in enumerate(words)}
    numbers = [[lookup[w] for w in own] for _, own, _ in items]
    answers = [[lookup[w] for w in last] for _, _, last in items]
    vectors = np.stack([(idf[own, None] * space[own]).sum(0) / np.sqrt((np.bincount(own, idf[own]) ** 2).sum()) for own in numbers])
    table, square = ((space * idf[:, None]) @ vectors.T).astype(np.float32), idf**2
    square[0] = strange**2
    member, sizes = np.zeros((len(items), len(idf)), bool), np.asarray([len(own) for own in numbers])
    for i, own in enumerate(numbers):
        member[i, own] = True
    places = places_of(numbers, len(idf))
    # how many words of an item any leak of it holds
    needed = np.where(sizes < least_words, sizes, np.ceil(sizes * min(verbatim, paraphrase) - 1e-9))
    ids = [i for i, _, _ in items]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of = Numbers(words)
        for chunk in word_chunks(batches, "text", 1 << 20):
            found, (owner, begin, end) = number_of(*normal_hashes(chunk)), passages(chunk)
            product, length = _products(chunk, found, table, square, begin, end)
            which, item = np.nonzero(product >= np.maximum(cosine * length, 1e-12 if cosine > 0 else -np.inf)[:, None])
            lo = np.maximum(chunk.first[owner[which]], begin[which] - sizes[item])
            hi = np.minimum(chunk.first[owner[which] + 1], end[which] + sizes[item])
            likely = []
            for at in range(0, len(which), HITS):
                part = slice(at, at + HITS)
                size = hi[part] - lo[part]
                held = member[np.repeat(item[part], size), found[spread(lo[part], size)]]
                seen = np.concatenate([[0], np.cumsum(held)])
                ends = np.cumsum(size)
                likely.append(at + np.flatnonzero(seen[ends] - seen[ends - size] >= needed[item[part]]))
            best: dict[tuple[int, int], tuple[float, float]] = {}
            likely = np.concatenate(likely) if likely else np.zeros(0, np.int64)
            counted = np.full(len(which), -1)
            for at in range(0, len(likely), HITS):
                part = likely[at : at + HITS]
                part = part[(sizes[item[part]] >= least_words) & (sizes[item[part]] <= 64)]
                counted[part] = in_order_all(places, sizes, item[part], found, lo[part], hi[part])
            likely = likely[(counted[likely] < 0) | (counted[likely] >= needed[item[likely]])]
            for c in likely.tolist():
                d, i = int(owner[which[c]]), int(item[c])
                own, passage = numbers[i], found[lo[c] : hi[c]]
                if len(own) < least_words:
                    shared = said = float(_contiguous(own, passage))
                else:
                    shared = (int(counted[c]) if counted[c] >= 0 else in_order(own, passage)) / len(own)
                    said = in_order(answers[i], passage) / max(1, len(answers[i]))
                if shared >= verbatim or (shared >= paraphrase and said >= answer):
                    best[d, i] = max(best.get((d, i), (0.0, 0.0)), (shared, said))
            doc_ids = chunk.batch["doc_id"]
            rows = [(doc_ids[d].as_py(), ids[i], *x) for (d, i), x in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "shared", "answer"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, "doc_id long, item_id long, shared double, answer double")


def leaks(documents: DataFrame, benchmark: DataFrame, cosine: float = 0.15, verbatim: float = 0.8, paraphrase: float = 0.6, answer: float = 0.75, least_words: int = 8) -> DataFrame:
    """doc_id, item_id, shared (part of the item's words in order) and answer (the same of its last sentence) for every leak."""
    found = None
    for items in read_items(benchmark):
        words = sorted({w for _, own, _ in items for w in own})
        counts, n, parts = document_frequencies(documents, words)
        idf = weights(counts, n)
        own = {w: i + 1 for i, w in enumerate(words)}
        space = latent_space(documents, words, idf, [[own[w] for w in item] for _, item, _ in items], max(1.0, parts / len(items)))
        part = _match(documents, items, words, idf, STRANGE, space, cosine, verbatim, paraphrase, answer, least_words)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], "doc_id long, item_id long, shared double, answer double")
    return found


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a leak; rows without an id are kept unless a row without an id leaks."""
    bad = stage(leaks(documents, benchmark).select("doc_id").distinct(), "decon-leaks")
    return documents.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left_anti")
