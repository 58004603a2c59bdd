"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed word shingles. Equal sets form one class at once;
the join runs over the distinct sets:

1. every set gets a sketch: for each of some hash functions the shingle with
   the smallest hash, a token sampled so that two sets share it with their
   Jaccard similarity as probability;
2. each of ``runs`` runs sorts the sets into buckets by a sampled token and
   splits buckets that are too large by the next one, level by level. Every run
   has ``LEVELS`` tokens of its own, so runs are independent, and their number
   reaches the target recall at the threshold for buckets split to the end;
3. small buckets are brute-forced on ``COORDINATES`` tokens of their sketches; what is still large after
   the last level shares so many samples that all its sets are taken together.
   Both give links in number proportional to the bucket, never all pairs;
4. connected candidates form a family. Within a family every pair is compared
   exactly, on the shingles themselves, in blocks of bounded size: a pair that
   some run missed is still found there. In a family of several blocks all sets
   are compared with one of them first; two sets that both lie close enough to
   it are similar whatever else they hold, so these are counted, not paired,
   and their shingles aren't copied to each other's blocks;
5. the links that hold connect classes.

Result: a row per document with its class (the smallest doc_id in it) and its
number of links (documents of similarity ``threshold`` or more, copies
included). Texts with fewer words than a shingle have the set of their whole
word sequence; texts without words link to nothing. Null text is empty. Words
are split at white space and compared as they are. Repeated rows are copies of
each other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_partitions, stage, temporaries
from .components import components
from .words import Words, mixed, word_chunks

SHINGLE = 5
COORDINATES = 32
LEVELS = 5
BUCKET = 128
BLOCK_SHINGLES = 60_000
BLOCK_SETS = 1024
_rng = np.random.default_rng(5)
_PLACES = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word ``n``-grams, one text after the other, and where each text's begin (and the end); a shorter text's words as a whole."""
    low = words.hashes()[0]
    size = np.minimum(n, words.counts)
    counts = np.where(size > 0, words.counts - size + 1, 0)
    owner = np.repeat(np.arange(words.n), counts)
    at = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    h = size[owner].astype(np.uint64)
    for j in range(n):
        live = slice(None) if (size[size > 0] > j).all() else np.flatnonzero(size[owner] > j)
        h[live] += low[at[live] + j] * _PLACES[j]
    h = mixed(h)
    starts = np.concatenate([[0], np.cumsum(counts)])
    sets = [np.unique(h[a:b]) for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
    return np.concatenate(sets) if sets else h, np.concatenate([[0], np.cumsum(list(map(len, sets)))])


def runs_for(recall: float, threshold: float, levels: int) -> int:
    """Runs until a pair at the threshold meets in some bucket ``levels`` deep with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**levels))


def sketches(documents: DataFrame, runs: int) -> DataFrame:
    """rid, doc_id, th, the set's size and hash, and its sketch: ``LEVELS`` tokens for each run."""
    width = max(COORDINATES, runs * LEVELS)
    factors = np.random.default_rng(6).integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 36
        for words in word_chunks(batches, "text"):
            flat, first = shingle_sets(words)
            sizes = np.diff(first)
            some = np.flatnonzero(sizes)
            values = np.zeros((words.n, width), np.int32)
            whole = np.zeros((2, words.n), np.uint64)
            if len(some):
                starts = first[some]
                for c in range(width):
                    mine = np.minimum.reduceat(flat * factors[c], starts)
                    values[some, c] = (mine >> np.uint64(32)).astype(np.uint32).view(np.int32)
                whole[0, some], whole[1, some] = np.add.reduceat(flat, starts), np.add.reduceat(mixed(flat), starts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(words.n + 1, dtype=np.int32) * width), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(n + np.arange(words.n)), words.batch["doc_id"], words.batch["th"], pa.array(sizes), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), lists], names=["rid", "doc_id", "th", "size", "s1", "s2", "sketch"])
            n += words.n

    return _keyed(documents).mapInArrow(run, "rid long, doc_id long, th long, size long, s1 long, s2 long, sketch array<int>")


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))


def buckets(sets: DataFrame, runs: int, levels: int = LEVELS, limit: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Small buckets (key, rid), each set of members once, and large ones that no level could split."""
    # a run's tokens go with its rows: splits need no other table
    paths = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("sketch", r * LEVELS + 1, F.lit(LEVELS)))
    now = sets.select("rid", F.posexplode(paths).alias("run", "path"))
    now = now.select("rid", "run", "path", F.xxhash64("run", F.get("path", F.lit(0))).alias("key"))
    small = None
    for level in range(1, levels + 1):
        # two sums over members tell equal buckets of different runs apart from others
        counts = now.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid") % (1 << 40)).alias("m1"), F.sum(F.xxhash64("rid", F.lit(1)) % (1 << 40)).alias("m2")).filter("n > 1")
        counts = stage(counts, "jaccard-counts")
        once = counts.filter(F.col("n") <= limit).groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key")
        found = now.join(once, "key").select("key", "rid")
        small = found if small is None else small.unionByName(found)
        large = counts.filter(F.col("n") > limit).select("key")
        if large.isEmpty():
            return small, now.limit(0).select("key", "rid")
        rest = now.join(large, "key")
        if level == levels:
            return small, rest.select("key", "rid")
        now = stage(rest.select("rid", "run", "path", F.xxhash64("key", F.get("path", F.lit(level))).alias("key")), "jaccard-split")


def _bucket_links(least: int):
    """Brute force of whole buckets on their sketches; a spanning set of links."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list | None = None
        for batch in batches:
            keys, rids = batch["key"].to_numpy(), batch["rid"].to_numpy()
            values = batch["sketch"].flatten().to_numpy().reshape(-1, COORDINATES)
            if left is not None:
                keys, rids, values = (np.concatenate([a, b]) for a, b in zip(left, (keys, rids, values), strict=True))
            if not len(keys):
                continue
            # the last key may go on in the next batch
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            left = [keys[cut:], rids[cut:], values[cut:]]
            yield _solve_buckets(keys[:cut], rids[:cut], values[:cut], least)
        if left is not None:
            yield _solve_buckets(*left, least)

    return links


def _solve_buckets(keys: np.ndarray, rids: np.ndarray, values: np.ndarray, least: int) -> pa.RecordBatch:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes, a, b = np.diff(np.r_[starts, len(keys)]), [], []
    two = starts[sizes == 2]
    hit = (values[two] == values[two + 1]).sum(1) >= least
    a.append(rids[two[hit]])
    b.append(rids[two[hit] + 1])
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        v, free = values[s : s + n], np.arange(n)
        while len(free) > 1:
            # grow one group from its first member
            front, free = free[:1], free[1:]
            while len(front) and len(free):
                alike = (v[front][:, None, :] == v[free][None]).sum(2) >= least
                joined, by = alike.any(0), alike.argmax(0)
                a.append(rids[s + front[by[joined]]])
                b.append(rids[s + free[joined]])
                front, free = free[joined], free[~joined]
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def candidate_links(sets: DataFrame, runs: int, threshold: float) -> DataFrame:
    small, large = buckets(sets, runs)
    n = shuffle_partitions(sets.sparkSession)
    # at the threshold far fewer agreements than this have a chance below one in a million
    least = max(1, int(COORDINATES * threshold - 5 * math.sqrt(COORDINATES * threshold * (1 - threshold))))
    small = small.join(sets.select("rid", F.slice("sketch", 1, COORDINATES).alias("sketch")), "rid").select("key", "rid", "sketch").repartition(n, "key").sortWithinPartitions("key", "rid")
    found = small.mapInArrow(_bucket_links(least), "a long, b long")
    centres = large.groupBy("key").agg(F.min("rid").alias("a"))
    return stage(found.unionByName(large.join(centres, "key").filter("a != rid").select("a", F.col("rid").alias("b"))).distinct(), "jaccard-links")


def _pair_blocks(sizes: DataFrame) -> DataFrame:
    """root, rid, block, blocks: families cut so that a block holds about ``BLOCK_SHINGLES`` and ``BLOCK_SETS`` at most."""
    total = sizes.groupBy("root").agg(F.sum("size").alias("total"), F.count("*").alias("sets"))
    total = total.select("root", F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("sets") / BLOCK_SETS)).cast("int").alias("blocks"))
    return sizes.join(total, "root").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))


def _close(threshold: float):
    """Whether each set of a block lies so close to the family's pivot (the key's first row) that any two such sets are similar.

    With t shingles of pivot P missing and e others, two sets share |P| - t - t'
    or more and have |P| + e + e' at most together.
    """
    per_mille = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            rids, close = [], []
            for key, is_pivot, rid, raw in zip(batch["key"].to_pylist(), batch["pivot"].to_pylist(), batch["rid"].to_pylist(), batch["shingles"].to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if is_pivot:
                    now, pivot = key, own
                    continue
                if key != now:
                    raise ValueError(f"block {key} has no pivot")
                shared = len(np.intersect1d(pivot, own, assume_unique=True))
                far = 1000 * (len(pivot) - shared) + per_mille * (len(own) - shared)
                rids.append(rid)
                close.append(2 * far <= (1000 - per_mille) * len(pivot))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(close, pa.bool_())], names=["rid", "close"])

    return run


def _large_families(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of families with several blocks: rows with blocks anew and the blocks that each must meet, and the links of sets close to their pivot."""
    n, size = shuffle_partitions(rows.sparkSession), F.octet_length("shingles") / 8
    pivots = stage(rows.groupBy("root").agg(F.min_by("rid", F.xxhash64("rid")).alias("first"), F.max("blocks").alias("blocks")), "jaccard-pivots")
    copies = rows.join(pivots.select(F.col("first").alias("rid")), "rid").select("rid", "shingles", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("pivot"))
    both = copies.unionByName(rows.select("rid", "shingles", "root", "block", F.lit(False).alias("pivot"))).select(F.concat_ws(":", "root", "block").alias("key"), "pivot", "rid", "shingles")
    close = stage(both.repartition(n, "key").sortWithinPartitions("key", F.desc("pivot")).mapInArrow(_close(threshold), "rid long, close boolean"), "jaccard-close")
    sets = stage(rows.select("rid", "root", "copies", size.alias("size")).join(close, "rid"), "jaccard-large")
    parts = lambda keep: F.ceil(F.greatest(F.sum(F.when(keep, F.col("size"))) / BLOCK_SHINGLES, F.count_if(keep) / BLOCK_SETS))
    shape = sets.groupBy("root").agg(F.coalesce(parts(~F.col("close")), F.lit(0)).cast("int").alias("far_blocks"), F.coalesce(parts(F.col("close")), F.lit(0)).cast("int").alias("close_blocks"), F.coalesce(F.sum(F.when(F.col("close"), F.col("copies"))), F.lit(0)).alias("close_copies"))
    sets = stage(sets.join(shape, "root").join(pivots.select("root", "first"), "root"), "jaccard-large-sets")
    near = sets.filter("close")
    links = near.select(F.col("rid").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("close_copies") - F.col("copies")).alias("n")).filter("n > 0")
    links = links.unionByName(near.filter("rid != first").select(F.col("first").alias("a"), F.col("rid").alias("b"), F.lit(0).cast("long").alias("n")))
    place = lambda of: F.pmod(F.xxhash64("rid"), F.greatest(of, F.lit(1))).cast("int")
    block = F.when(F.col("close"), F.col("far_blocks") + place(F.col("close_blocks"))).otherwise(place(F.col("far_blocks")))
    meets = F.when(F.col("close"), F.col("far_blocks")).otherwise(F.col("far_blocks") + F.col("close_blocks"))
    placed = sets.select("rid", block.alias("block"), meets.alias("blocks")).filter("blocks > 0")
    return rows.drop("block", "blocks").join(placed, "rid"), links


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Entries of a boolean matrix that connect all rows and columns that its entries connect."""
    seen_rows, seen_cols, out = np.zeros(linked.shape[0], bool), np.zeros(linked.shape[1], bool), []
    for start in np.flatnonzero(linked.any(1)).tolist():
        if seen_rows[start]:
            continue
        seen_rows[start], front = True, np.asarray([start])
        while len(front):
            cols = np.flatnonzero(linked[front].any(0) & ~seen_cols)
            if not len(cols):
                break
            out += zip(front[linked[np.ix_(front, cols)].argmax(0)].tolist(), cols.tolist(), strict=True)
            seen_cols[cols] = True
            front = np.flatnonzero(linked[:, cols].any(1) & ~seen_rows)
            out += zip(front.tolist(), cols[linked[np.ix_(front, cols)].argmax(1)].tolist(), strict=True) if len(front) else ()
            seen_rows[front] = True
    return out


def _compare(threshold: float):
    """Exact links between the sets of two blocks: each set's number of linked documents, and a spanning set of links."""

    def links_of(side: np.ndarray, rids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], own: bool) -> tuple:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        tokens, token = np.unique(flat, return_inverse=True)
        counts = np.bincount(token)
        # shingles of a single set can't be shared; those of all are no news either, but count
        shared = counts[token] > 1
        column = np.cumsum(counts > 1) - 1
        owner, col, width = owner[shared], column[token[shared]], int((counts > 1).sum())
        rows_left = np.arange(len(sets)) if own else np.flatnonzero(side == 0)
        rows_right = np.arange(len(sets)) if own else np.flatnonzero(side == 1)
        links = np.zeros(len(sets), np.int64)
        common = np.zeros((len(rows_left), len(rows_right)), np.float32)
        left_at, right_at = np.full(len(sets), -1), np.full(len(sets), -1)
        left_at[rows_left], right_at[rows_right] = np.arange(len(rows_left)), np.arange(len(rows_right))
        step = max(1, 8_000_000 // max(1, len(sets)))
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        for at in range(0, width, step):
            lo, hi = np.searchsorted(col, [at, at + step])
            o, c = owner[lo:hi], col[lo:hi] - at
            wide = min(step, width - at)
            left = np.zeros((len(rows_left), wide), np.float32)
            ok = left_at[o] >= 0
            left[left_at[o[ok]], c[ok]] = 1
            if own:
                right = left
            else:
                right = np.zeros((len(rows_right), wide), np.float32)
                ok = right_at[o] >= 0
                right[right_at[o[ok]], c[ok]] = 1
            common += left @ right.T
        sl, sr = sizes[rows_left][:, None], sizes[rows_right][None]
        both = common.astype(np.int64)
        # in whole numbers: similarity = both / (sl + sr - both)
        linked = both * 1000 >= round(threshold * 1000) * (sl + sr - both)
        if own:
            np.fill_diagonal(linked, False)
        links[rows_left] += linked @ copies[rows_right]
        if not own:
            links[rows_right] += linked.T @ copies[rows_left]
        return links, [(rids[rows_left[i]], rids[rows_right[j]]) for i, j in spanning(linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            rids = np.asarray([r[1] for r in rows], np.int64)
            side = np.asarray([r[2] for r in rows], np.int64)
            copies = np.asarray([r[3] for r in rows], np.int64)
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            links, tree = links_of(side, rids, copies, sets, rows[0][5])
            some = np.flatnonzero(links)
            a = [*rids[some].tolist(), *(x for x, _ in tree)]
            b = [*([None] * len(some)), *(y for _, y in tree)]
            n = [*links[some].tolist(), *([0] * len(tree))]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        now, held = None, []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "rid", "side", "copies", "shingles", "own")), strict=True):
                if row[0] != now:
                    if len(held) > 1:
                        yield solve(held)
                    now, held = row[0], []
                held.append(row)
        if len(held) > 1:
            yield solve(held)

    return run


def _with_shingles(rows: DataFrame) -> DataFrame:
    """``rows`` (text and more) with shingles in place of text."""
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "text"], T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in word_chunks(batches, "text"):
            keep = [n for n in words.batch.schema.names if n != "text"]
            flat, first = shingle_sets(words)
            sets = [flat[a:b].tobytes() for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*(words.batch[n] for n in keep), pa.array(sets, pa.binary())], names=[*keep, "shingles"])

    return rows.mapInArrow(run, schema)


def join(documents: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, n_links for every row."""
    with temporaries() as keep:
        runs = runs_for(recall, threshold, LEVELS)
        all_rows = keep(stage(sketches(documents, runs), "jaccard-sketches"))
        same = ["size", "s1", "s2"]
        # copies: one set stands for all of them
        distinct = stage(all_rows.filter("size > 0").groupBy(*same).agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "jaccard-distinct")
        sets = all_rows.join(distinct.select("rid"), "rid", "left_semi").select("rid", "sketch")
        links = candidate_links(sets, runs, threshold)
        families = components(links).select(F.col("node").alias("rid"), "root")
        placed = _pair_blocks(distinct.select("rid", "size", "copies").join(families, "rid"))
        wanted = stage(placed.join(all_rows.select("rid", "doc_id", "th"), "rid"), "jaccard-families")
        # one plan at every size: texts are shuffled once, whatever Spark guesses of the other side
        texts = _keyed(documents).alias("d").join(wanted.alias("w").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")))
        rows = _with_shingles(texts.select("w.rid", "w.root", "w.block", "w.blocks", "w.copies", "d.text"))
        # equal rows have one text: once per set is enough
        rows = stage(rows, "jaccard-sets")
        if not all_rows.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
            rows = rows.dropDuplicates(["rid"])
        links = None
        if not rows.filter("blocks > 1").isEmpty():
            large, links = _large_families(rows.filter("blocks > 1"), threshold)
            rows = rows.filter("blocks = 1").unionByName(large.select(rows.columns))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        pairs = rows.select("*", other).select(F.concat_ws(":", "root", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "rid", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "copies", "shingles", (F.col("block") == F.col("other")).alias("own"))
        n = shuffle_partitions(documents.sparkSession)
        found = stage(pairs.repartition(n, "key").sortWithinPartitions("key", "rid").mapInArrow(_compare(threshold), "a long, b long, n long").unionByName(links if links is not None else documents.sparkSession.createDataFrame([], "a long, b long, n long")), "jaccard-found")
        counts = found.filter("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("linked"))
        joined = components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("rid"), "root")
        members = stage(distinct.join(joined, "rid", "left").join(counts, "rid", "left").withColumn("root", F.coalesce("root", "rid")), "jaccard-members")
        classes = members.groupBy("root").agg(F.min("least_id").alias("class_id"))
        members = keep(stage(members.join(classes, "root").select(*same, "class_id", F.col("root").alias("cls"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "jaccard-classes"))
    out = all_rows.drop("sketch").join(members, same, "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "rid", "th", F.coalesce("cls", "rid").alias("cls"), "size")


def representatives(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``documents`` with one row of each class, that of the smallest doc_id; texts without words all stay."""
    classes = stage(join(documents, threshold), "jaccard-kept")
    first = classes.groupBy("cls").agg(F.min(F.struct("doc_id", "th", "size")).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.th").alias("k_th"), F.col("k.size").alias("k_size"))
    kept = stage(first.distinct(), "jaccard-keys")
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), th.alias("th")).join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")))
    if not classes.filter("size > 0").groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        # rows that are equal in id and text are copies of each other
        out = out.filter("k_size = 0").unionByName(out.filter("k_size > 0").dropDuplicates(["id", "th"]))
    return out.select(*[F.col("row")[c].alias(c) for c in documents.columns])
