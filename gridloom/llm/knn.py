"""Exact top-k inner products by a Voronoi join.

Vectors are grouped by their nearest pivot. Summaries of the groups (counts,
radii, norms, smallest distances to the pivot) bound the score of every pair
of groups from both sides; a data group goes only to the query groups for
which its upper bound reaches what the k best are sure to have. Query groups
that lie close together are merged, so that data is copied few times, and
large groups on either side are cut into blocks of bounded size. Every block
pair is solved by one task, and the k best of each query are merged.

A component x becomes floor(256 * x), x as double. Vectors that are null or
hold null or non-finite components take no part. A shorter vector counts as
filled up with zeros. A candidate with the query's own id is the query
itself; rows that repeat an id and a vector count once. An empty table gives no
rows; with fewer candidates than k all are returned. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

LEAST_PIVOTS, MOST_PIVOTS = 48, 2048
GROUP_QUERIES = 512
BLOCK_ROWS = 4096
MOST = 2**63 - 1
ASSIGNED = "vec_id long, v binary, cell int, dist double, norm double, is_query boolean, salt long"


def quantised(rows: list) -> list[np.ndarray | None]:
    out = []
    for x in rows:
        a = None if x is None or any(y is None for y in x) else np.asarray(x, np.float64)
        out.append(np.floor(256 * a) if a is not None and np.isfinite(a).all() and np.isfinite(256 * a).all() else None)
    return out


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where these hold them exactly. What 64 bits can't hold is ``MOST``."""
    top = (np.abs(queries).max(initial=0) * np.abs(data).max(initial=0)) * queries.shape[1]
    if top < 2**53:
        return (queries @ data.T).astype(np.int64)
    if not queries.size or not data.size:
        return np.zeros((len(queries), len(data)), np.int64)
    exact = np.vectorize(int, otypes=[object])(queries).dot(np.vectorize(int, otypes=[object])(data).T)
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors that a hash of their ids picks: a bounded sample, for the grouping only."""
    rows = quantised([r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("embedding").collect()])
    kept = [v for v in rows if v is not None] or [np.zeros(1)]
    return np.unique(_matrix(kept, max(map(len, kept))), axis=0)


def assign(vectors: DataFrame, centres: np.ndarray, every: int) -> DataFrame:
    """Each usable vector with its nearest pivot."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centres**2).sum(1)
        for batch in batches:
            ids, ok, vecs = batch["vec_id"].to_pylist(), [], []
            for i, v in enumerate(quantised(batch["embedding"].to_pylist())):
                if v is not None and ids[i] is not None:
                    ok.append(i)
                    vecs.append(v)
            if not ok:
                continue
            width = max(centres.shape[1], max(map(len, vecs)))
            x, c = _matrix(vecs, width), np.pad(centres, ((0, 0), (0, width - centres.shape[1])))
            cell = (square - 2 * x @ c.T).argmin(1)
            dist, norm = np.sqrt(((x - c[cell]) ** 2).sum(1)), np.sqrt((x**2).sum(1))
            own = np.asarray([ids[i] for i in ok], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([v.tobytes() for v in vecs], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(norm), pa.array(own % every == 0), pa.array([zlib.crc32(int(i).to_bytes(8, "little", signed=True)) for i in own], pa.int64())], names=["vec_id", "v", "cell", "dist", "norm", "is_query", "salt"])

    return vectors.mapInArrow(near, ASSIGNED)


def _summaries(assigned: DataFrame, cells: int) -> dict[str, np.ndarray]:
    """Counts, radii and norms of the groups, and how many lie in each of 64 rings about the pivot: a few numbers per pivot."""
    near = F.floor(F.col("dist") / F.greatest(F.lit(1.0), F.col("top") / 64))
    tops = assigned.groupBy("cell").agg(F.max("dist").alias("top"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"), F.max(F.when(F.col("is_query"), F.col("dist"))).alias("qtop"), F.min(F.when(F.col("is_query"), F.col("norm"))).alias("qlow"), F.max(F.when(F.col("is_query"), F.col("norm"))).alias("qhigh"), F.count_if("is_query").alias("nq"))
    out = {c: np.zeros(cells) for c in ("top", "low", "high", "n", "qtop", "qlow", "qhigh", "nq")}
    rows = tops.collect()
    for r in rows:
        for c in out:
            out[c][r["cell"]] = r[c] or 0
    rings = assigned.join(F.broadcast(tops.select("cell", "top")), "cell").groupBy("cell", near.cast("int").alias("ring")).agg(F.count("*").alias("m"), F.max("dist").alias("edge")).collect()
    out["rings"] = np.asarray(sorted((r["cell"], r["edge"], r["m"]) for r in rings), float).reshape(-1, 3)
    return out


def plan(centres: np.ndarray, s: dict[str, np.ndarray], k: int, group_queries: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each query cell, and which data cells each group needs for its ``k`` best of all rows."""
    apart = np.sqrt(np.maximum(0, (centres**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * centres @ centres.T)) + 1e-6
    inner, size, slack = centres @ centres.T, np.sqrt((centres**2).sum(1)), 1e-6
    u, cell = s["qtop"][:, None] + slack, s["rings"][:, 0].astype(int)

    def bounds(j, r):
        """Least and greatest score of a query of cell i with a vector within r of pivot j."""
        spread = size[:, None] * r + u * size[j][None] + u * r
        d, far = apart[:, j], apart[:, j] + u + r
        close = np.maximum(0, d - 2e-6 - u - r)
        lower = np.maximum(inner[:, j] - spread, (s["qlow"][:, None] ** 2 + s["low"][j][None] ** 2 - far**2) / 2)
        upper = np.minimum(inner[:, j] + spread, (s["qhigh"][:, None] ** 2 + s["high"][j][None] ** 2 - close**2) / 2)
        return lower, upper

    rest = 1 + 1e-6 * (1 + np.abs(inner).max(initial=0))
    least = bounds(cell, s["rings"][:, 1][None] + slack)[0]
    order = np.argsort(-least, axis=1)
    held = np.cumsum(s["rings"][:, 2][order], axis=1)
    threshold = np.full(len(centres), -np.inf)
    if held.shape[1] and held[0, -1] >= k:
        at = np.argmax(held >= k, axis=1)[:, None]
        threshold = np.take_along_axis(np.take_along_axis(least, order, 1), at, 1)[:, 0]
    upper = bounds(np.arange(len(centres)), s["top"][None] + slack)[1]
    needed = (upper >= threshold[:, None] - rest) & (s["n"][None] > 0) & (s["nq"][:, None] > 0)
    # merge query cells with the most similar needs, in order of the data that they need
    group, filled, g = np.full(len(centres), -1), 0, 0
    for i in sorted(np.flatnonzero(s["nq"] > 0), key=lambda i: (-(needed[i] * s["n"]).sum(), needed[i].tobytes(), i)):
        if filled and filled + s["nq"][i] > group_queries:
            g, filled = g + 1, 0
        group[i], filled = g, filled + s["nq"][i]
    need = np.zeros((group.max(initial=-1) + 1, len(centres)), bool)
    for i in np.flatnonzero(group >= 0):
        need[group[i]] |= needed[i]
    return group, need


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, n_pivots: int | None = None, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` best candidates of every vector whose id is divisible by ``every``."""
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    # groups grow more slowly than the table: half its root
    n_pivots = n_pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, vectors.count() ** 0.5 / 2)))
    centres = pivots(vectors, n_pivots)
    assigned = stage(assign(vectors, centres, every).dropDuplicates(["vec_id", "v"]), "knn-cells")
    # rows that a query leaves out as its own: one, unless ids repeat with other vectors
    own = assigned.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    s = _summaries(assigned, len(centres))
    group, need = plan(centres, s, k + own, group_queries)
    spark = vectors.sparkSession
    query_blocks = np.ones(max(1, len(need)), int)
    for g in range(len(need)):
        query_blocks[g] = max(1, -(-int(s["nq"][group == g].sum()) // group_queries))
    data_blocks = np.maximum(1, -(-s["n"].astype(int) // block_rows))
    # the plan has at most as many rows as pairs of pivots
    pairs = [(int(j), int(g), int(query_blocks[g]), int(data_blocks[j])) for g, j in zip(*np.nonzero(need), strict=True)]
    routes = spark.createDataFrame(pairs, "cell int, grp int, qb int, db int")
    homes = spark.createDataFrame([(int(i), int(group[i])) for i in np.flatnonzero(group >= 0)], "cell int, grp int")
    key = F.concat_ws(":", "grp", "qblock", "cell", "dblock").alias("key")
    data = assigned.join(F.broadcast(routes), "cell").withColumn("dblock", F.col("salt") % F.col("db")).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select(key, "vec_id", "v")
    asked = assigned.filter("is_query").select("vec_id", "v", "cell", "salt").join(F.broadcast(homes), "cell").drop("cell")
    asked = asked.join(F.broadcast(routes), "grp").withColumn("qblock", F.col("salt") % F.col("qb")).withColumn("dblock", F.explode(F.sequence(F.lit(0), F.col("db") - 1))).select(key, F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def solve(data: pa.Table, asked: pa.Table) -> pa.Table:
        ids, vecs = data["vec_id"].to_numpy(), [np.frombuffer(b) for b in data["v"].to_pylist()]
        qids, qvecs = asked["query_id"].to_numpy(), [np.frombuffer(b) for b in asked["q"].to_pylist()]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(qids):
            width = max(map(len, [*vecs, *qvecs]))
            x, q = _matrix(vecs, width), _matrix(qvecs, width)
            for at in range(0, len(q), 256):
                part = scores(q[at : at + 256], x)
                for row, qid in zip(part, qids[at : at + 256], strict=True):
                    # all that tie with the last may win by a smaller id; the query itself may be one
                    cut = np.partition(row, -(k + own))[-(k + own)] if len(row) > k + own else None
                    hit = np.flatnonzero((row >= cut if cut is not None else np.ones(len(row), bool)) & (ids != qid))
                    best = hit[np.lexsort((ids[hit], -row[hit]))]
                    # rows that repeat an id and a score count once
                    keep = np.ones(len(best), bool)
                    keep[1:] = (ids[best][1:] != ids[best][:-1]) | (row[best][1:] != row[best][:-1])
                    best = best[keep][:k]
                    if len(best) and max(row[best].max(), -row[best].min()) >= MOST:
                        raise OverflowError("a score doesn't fit into 64 bits")
                    out.append((np.full(len(best), qid), ids[best], row[best]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    found = data.groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(solve, "query_id long, vec_id long, score long")
    # a vector's repeats can lie in several blocks
    merged = found.dropDuplicates(["query_id", "vec_id", "score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
