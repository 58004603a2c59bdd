"""Duplicate passages by a relative Lempel-Ziv parse against content-defined reference blocks.

Anchors: of each run of word 6-grams that a 20-word window holds, the leftmost
one with the smallest hash. Windows in a row with one anchor make a block (20
to 34 words), so equal windows lie in blocks of equal anchors, at equal places.

1. Every text is cut into blocks; blocks are indexed by their anchor's hash and
   their own (128 bits together) with the earliest place of each.
2. A text is factored greedily, block by block, against all indexed blocks: a
   factor goes on as long as the next block occurs earlier as a whole.
3. At factor boundaries (blocks with a known anchor but no equal block) the
   windows are looked up one by one, by 128-bit hashes; that extends a factor
   to the word where it ends. Only the first block of each kind is asked and
   only if its anchor has blocks of several kinds, so windows are few.
4. Factors have 20 words or more and are duplicate spans: their words are taken
   out.

Lookups are counted before they are joined. Keys with more than a thousandth
of all rows, of which there are fewer than a thousand, go to all tasks, and
their rows are never shuffled; the rest is joined by key.

Words are ``[^\\x20\\x09-\\x0D]+`` and stay unchanged. Null text has no words.
Rows that repeat a doc_id come in the order of their texts' hashes; equal rows
in any order, one of them first. A null doc_id comes before all others. An
empty table gives no rows. Extra columns are ignored. A text may have up to
2**28 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import hot_join, stage, temporaries
from .tokens import spread
from .words import Words, mixed, word_chunks

WINDOW = 20
GRAM = 6
POSITION_BITS = 28
_rng = np.random.default_rng(20)
#: Odd multipliers, one per place of a run and per hash.
_PLACES = _rng.integers(0, 1 << 63, (4, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolled(h: np.ndarray, n: int, which: int) -> np.ndarray:
    """Hashes of all runs of ``n`` values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * _PLACES[which, j]
    return mixed(out)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The leftmost place of the minimum of each run of ``n`` values, by doubling."""
    v, p, width = values, np.arange(len(values)), 1

    def better(step: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        right = v[step : step + m] < v[:m]
        return np.where(right, v[step : step + m], v[:m]), np.where(right, p[step : step + m], p[:m])

    while 2 * width <= n:
        v, p = better(width, len(v) - width)
        width *= 2
    return better(n - width, len(values) - n + 1)[1]


def blocks(words: Words, low: np.ndarray, high: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of each block: its first window, how many more it has, the anchor's hash and the block's."""
    n = len(low) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    owner, grams = words.owner(), rolled(low, GRAM, 0)
    at = np.flatnonzero(owner[window - 1 :] == owner[:n])
    anchor = _least(grams, window - GRAM + 1)[at]
    # an anchor belongs to one text, and windows with the same one are neighbours
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    start, more = at[new], np.diff(np.append(new, len(at))) - 1
    whole, size, live = np.zeros(len(new), np.uint64), more + window, np.arange(len(new))
    for j in range(2 * window - GRAM):
        live = live[size[live] > j]
        whole[live] += high[start[live] + j] * _PLACES[3, j]
    return start, more, grams[anchor[new]], mixed(whole + size.astype(np.uint64))


def window_hashes(low: np.ndarray, high: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window that starts at one of ``at``."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(window):
        one += low[at + j] * _PLACES[1, j]
        two += high[at + j] * _PLACES[2, j]
    return mixed(one), mixed(two)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def _digests(parts: Iterator[memoryview]) -> pa.Array:
    return pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())


def index_documents(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: the count and hash of its words, and its blocks."""
    schema = "rid long, doc_id long, th long, n_words long, kept_sha256 string, h array<long>, g array<long>, s array<int>, k array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 36
        for words in word_chunks(batches, "text"):
            low, high = words.hashes()
            start, more, h, g = blocks(words, low, high, window)
            first = np.searchsorted(start, words.first)
            s = start - np.repeat(words.first[:-1], np.diff(first))
            lists = [_lists(first, x) for x in (_signed(h), _signed(g), pa.array(s.astype(np.int32)), pa.array(more.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(n + np.arange(words.n)), words.batch["doc_id"], words.batch["th"], pa.array(words.counts), _digests(words.joined()), *lists], names=["rid", "doc_id", "th", "n_words", "kept_sha256", "h", "g", "s", "k"])
            n += words.n

    return _keyed(documents).mapInArrow(run, schema)


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``place``: dense numbers in the order of ``by``."""
    ordered = stage(rows.orderBy(*by).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "substr-order")
    # a row per partition of the sort
    counts = sorted(map(tuple, ordered.groupBy("_part").agg(F.count("*")).collect()))
    before = dict(zip((p for p, _ in counts), np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False))
    offsets = F.broadcast(rows.sparkSession.createDataFrame([(p, b) for p, b in before.items()], "_part int, _before long"))
    return ordered.join(offsets, "_part").withColumn("place", F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_before")


def _at(place: str, position: str):
    return F.shiftleft(place, POSITION_BITS) + F.col(position)


def _parsed(index: DataFrame) -> DataFrame:
    """place, rid, doc_id, th, n_words and held: the blocks that occur earlier (whole), and those whose windows must be looked up."""
    occurrences = index.filter(F.size("h") > 0).select("rid", F.inline(F.arrays_zip("h", "g", "s", "k")))
    anchors = stage(occurrences.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "substr-anchors")
    known = hot_join(occurrences, anchors, ["h"]).drop("n")
    places = stage(numbered(index.select("doc_id", "th", "rid"), ["doc_id", "th", "rid"]).select("rid", "place"), "substr-places")
    found = stage(known.join(places, "rid").select("place", "h", "g", "s", "k", _at("place", "s").alias("at")), "substr-blocks")
    firsts = stage(found.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("at").alias("first")), "substr-firsts")
    kinds = stage(firsts.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "substr-kinds")
    # the first block of a kind is a boundary where its anchor has blocks of other kinds; a later one is part of a factor
    edges = hot_join(firsts.select("h", "first"), kinds, ["h"], "kinds").select(F.col("first").alias("at"))
    edges = edges.select(F.shiftright("at", POSITION_BITS).alias("place"), F.col("at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int").alias("s"))
    whole = hot_join(found, firsts.filter("n > 1"), ["h", "g"]).filter("at > first").select("place", "s", "k")
    marks = whole.withColumn("whole", F.lit(True)).unionByName(found.select("place", "s", "k").join(edges, ["place", "s"]).withColumn("whole", F.lit(False)))
    held = marks.groupBy("place").agg(F.collect_list(F.struct("s", "k", "whole")).alias("held"), F.sum(F.when(F.col("whole"), F.col("k") + 1).otherwise(0)).alias("windows"))
    return index.select("rid", "doc_id", "th", "n_words").join(places, "rid").join(held, "place")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """Hashes and places of the windows at factor boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in word_chunks(batches, "text"):
            low, high = words.hashes()
            edges, held = words.batch["edges"], words.batch["edges"].flatten()
            owner = np.repeat(np.arange(words.n), edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            s, more = held.field("s").to_numpy(), held.field("k").to_numpy()
            at = spread(words.first[owner] + s, more + 1)
            owner = np.repeat(owner, more + 1)
            one, two = window_hashes(low, high, at, window)
            place = words.batch["place"].to_numpy()[owner] << POSITION_BITS
            yield pa.RecordBatch.from_arrays([_signed(one), _signed(two), pa.array(place + at - words.first[owner])], names=["w1", "w2", "at"])

    edges = F.filter("held", lambda b: ~b["whole"])
    return texts.select("place", "text", F.transform(edges, lambda b: F.struct(b["s"], b["k"])).alias("edges")).filter(F.size("edges") > 0).mapInArrow(run, "w1 long, w2 long, at long")


def _factors(texts: DataFrame, window: int) -> DataFrame:
    """rid, factors (start and end in words), gone, left_sha256: the words of all factors are taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in word_chunks(batches, "text"):
            steps = np.zeros(len(words.start) + 1, np.int64)
            spans = words.batch["spans"]
            flat = spans.flatten()
            begin = np.repeat(words.first[:-1], spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            s, more = flat.field("s").to_numpy(), flat.field("k").to_numpy()
            np.add.at(steps, begin + s, 1)
            np.add.at(steps, begin + s + more + window, -1)
            gone = np.cumsum(steps)[:-1] > 0
            # factors that touch the next text's end with their own
            edge = np.zeros(len(gone) + 1, bool)
            edge[words.first] = True
            starts = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]) | gone & edge[:-1])
            ends = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]]) | gone & edge[1:]) + 1
            first = np.searchsorted(starts, words.first)
            own = np.repeat(words.first[:-1], np.diff(first))
            factors = _lists(first, pa.StructArray.from_arrays([pa.array((starts - own).astype(np.int32)), pa.array((ends - own).astype(np.int32))], names=["start", "end"]))
            total = np.concatenate([[0], np.cumsum(gone)])[words.first]
            yield pa.RecordBatch.from_arrays([words.batch["rid"], factors, pa.array(np.diff(total)), _digests(words.joined(~gone))], names=["rid", "factors", "gone", "left_sha256"])

    return texts.mapInArrow(run, "rid long, factors array<struct<start:int,end:int>>, gone long, left_sha256 string")


def parse(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and factors (array of start and end, in words) for every row."""
    with temporaries() as keep:
        index = keep(stage(index_documents(documents, window), "substr-index"))
        rows = keep(stage(_parsed(index), "substr-held"))
        # texts that one factor covers need no second look
        covered = F.col("windows") == F.col("n_words") - (window - 1)
        wanted = rows.filter(~covered).select("rid", "place", "doc_id", "th", "held")
        texts = _keyed(documents)
        if not index.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
            # rows that repeat have one text
            texts = texts.dropDuplicates(["doc_id", "th"])
        texts = texts.alias("d").join(wanted.alias("w").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")))
        texts = stage(texts.select("w.rid", "w.place", "w.held", "d.text"), "substr-texts")
        windows = stage(_windows(texts, window), "substr-windows")
        earliest = stage(windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("at").alias("first")).filter("n > 1"), "substr-earliest")
        later = hot_join(windows, earliest, ["w1", "w2"]).filter("at > first")
        position = F.col("at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
        later = later.groupBy(F.shiftright("at", POSITION_BITS).alias("place")).agg(F.collect_list(F.struct(position.alias("s"), F.lit(0).alias("k"))).alias("more"))
        later = stage(later, "substr-later")
        none = F.expr("cast(array() as array<struct<s:int,k:int>>)")
        whole = F.transform(F.filter("held", lambda b: b["whole"]), lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k")))
        spans = texts.join(later, "place", "left").select("rid", "text", F.concat(whole, F.coalesce("more", none)).alias("spans")).filter(F.size("spans") > 0)
        factors = keep(stage(_factors(spans, window), "substr-factors"))
    all_gone = rows.filter(covered).select("rid", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("factors"), F.col("n_words").alias("gone"), F.lit(hashlib.sha256(b"").hexdigest()).alias("left_sha256"))
    out = index.select("rid", "doc_id", "n_words", "kept_sha256").join(factors.unionByName(all_gone), "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_sha256", "kept_sha256").alias("kept_sha256"), F.coalesce("factors", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("factors"))


def deduplicate(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    return parse(documents, window).drop("factors")
