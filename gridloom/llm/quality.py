"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its features: its words, the
character n-grams of its words (as they are, and as classes of characters),
and marks of size and repetition, such as words that come twice in a row. A softmax over two classes follows. Vectors lie in a hashed table
and are trained by stochastic gradient descent in numpy, on a bounded sample
of labelled rows (``max_rows``), never on held-out ones.

Averaging and the output layer are linear, so scoring needs one number per
distinct word: its features' share of the logit. Whole texts are scored, and
whole words give n-grams, in pieces of bounded size.

Only the text is an input of a score. Null text is empty; an empty text gets
the score of no features. Repeated rows each get their own result. Without
usable labels every score is 0.5. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, text_chunks

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (2, 3, 4)
SCORED = "doc_id long, held_out boolean, score double, predicted int"
PIECE = 1 << 16
BATCH = 1 << 20
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def _bucket(kind: bytes, value: bytes) -> int:
    return zlib.crc32(value, zlib.crc32(kind)) & (BUCKETS - 1)


def word_features(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words' features, and the word of each, a batch at a time: the word, its n-grams, and trigrams of its classes of characters."""
    pieces, owners, whole, size = [], [], [], 0
    for i, w in enumerate(words):
        whole.append(i)
        marked = b"<" + w + b">"
        for at in range(0, len(marked), PIECE):
            # n-grams that begin in this piece end in the next
            pieces.append(marked[at : at + PIECE + max(NGRAMS) - 1])
            owners.append(i)
            size += len(pieces[-1])
            if size >= BATCH:
                yield _piece_features(words, pieces, owners, whole)
                pieces, owners, whole, size = [], [], [], 0
    if pieces:
        yield _piece_features(words, pieces, owners, whole)


def _piece_features(words: list[bytes], pieces: list[bytes], owners_of: list[int], whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    owner = np.repeat(np.asarray(owners_of), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    begins = np.repeat(sizes, sizes) - left < PIECE
    buckets, owners = [np.fromiter((_bucket(b"w", words[i]) for i in whole), np.int64, len(whole))], [np.asarray(whole, np.int64)]
    for seed, n, letters in [*((n, n, data) for n in NGRAMS), (9, 3, _CLASS[data])]:
        code = np.full(max(0, len(data) - n + 1), seed, np.uint64)
        for j in range(n):
            code = code * np.uint64(257) + letters[j : len(letters) - n + 1 + j]
        inside = (left[: len(code)] >= n) & begins[: len(code)]
        code = (code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        buckets.append(code.astype(np.int64))
        owners.append(owner[: len(inside)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def document_marks(words: list[bytes]) -> list[tuple[int, float]]:
    """Marks of the whole document with their weights: repetition and bigrams of shapes, as shares of the words."""
    n = len(words)
    if not n:
        return [(_bucket(b"m", b"empty"), 1.0)]
    distinct = len(set(words))
    out = {_bucket(b"m", b"repeated %d" % min(9, 10 * (n - distinct) // n)): 1.0, _bucket(b"m", b"size %d" % min(12, n.bit_length())): 0.25}
    same = sum(map(bytes.__eq__, words, words[1:]))
    key = _bucket(b"m", b"twice %d" % min(9, 10 * same // n))
    out[key] = out.get(key, 0.0) + 1.0
    return list(out.items())


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a document: each word's features share the word's weight, and weights of words add up to 1."""
    words = text.split()
    marks = document_marks(words)
    buckets, weights = [np.fromiter((b for b, _ in marks), np.int64)], [np.fromiter((x for _, x in marks), np.float64)]
    if words:
        counts = Counter(words)
        held = [np.unique(owner * BUCKETS + own, return_counts=True) for own, owner in word_features(list(counts))]
        key, times = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
        owner = key // BUCKETS
        buckets.append(key % BUCKETS)
        weights.append((np.fromiter(counts.values(), np.float64) / np.bincount(owner, times) / len(words))[owner] * times)
    idx, back = np.unique(np.concatenate(buckets), return_inverse=True)
    return idx, np.bincount(back, np.concatenate(weights))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.1, seed: int = 0) -> np.ndarray:
    """The logit of class 1 that each bucket adds, after gradient descent on embeddings and softmax output."""
    rng = np.random.default_rng(seed)
    table, output, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((2, DIM)), np.zeros(2)
    output[1], output[0] = rng.normal(0, 0.5, (2, DIM))
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS + 1)
    # both classes weigh the same
    balance = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    steps, total = 0, epochs * len(labels)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            idx, w = examples[i]
            hidden = w @ table[idx]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = rate * (1 - steps / total) * balance[labels[i]] * p
            back = step @ output
            output -= np.outer(step, hidden)
            bias -= step
            table[idx] -= np.outer(w, back)
            steps += 1
    return np.append(table @ (output[1] - output[0]), bias[1] - bias[0])


def fit(documents: DataFrame, labels: DataFrame, label: str, max_rows: int = 4000) -> np.ndarray:
    """Train on at most about ``max_rows`` labelled rows that aren't held out, picked by a hash of their ids, half of each class where there are enough."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, min(1.0, max_rows / 2 / n)).otherwise(share)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("label", "text").toArrow()
    return train([features(t) for t in as_bytes(rows["text"].combine_chunks())], rows["label"].to_numpy())


def score(documents: DataFrame, logits: np.ndarray, held: int = 300_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(logits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit, known = shared.value, {}
        for batch, texts in text_chunks(batches, "text"):
            if len(known) > held:
                known.clear()
            split = [t.split() for t in texts]
            new = list(set().union(*split).difference(known))
            if new:
                total, times = np.zeros(len(new)), np.zeros(len(new))
                for own, owner in word_features(new):
                    total += np.bincount(owner, logit[own], len(new))
                    times += np.bincount(owner, minlength=len(new))
                known.update(zip(new, (total / times).tolist(), strict=True))
            out = np.empty(len(texts))
            for i, words in enumerate(split):
                out[i] = (sum(map(known.__getitem__, words)) / len(words) if words else 0.0) + sum(x * logit[b] for b, x in document_marks(words))
            p = 1 / (1 + np.exp(-np.clip(out + logit[-1], -700, 700)))
            doc_id = batch["doc_id"]
            held_out = [None if d is None else zlib.crc32(str(d).encode()) % 3 == 1 for d in doc_id.to_pylist()]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(held_out, pa.bool_()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)
