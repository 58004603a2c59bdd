"""Reduction of block fields: decompose, quantize, code; and refactor, request, refine by fragments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.operators import blocks as B, quantities
from gridloom.operators.bitplanes import greedy
from gridloom.operators.coding import CODECS, PIECE, _unzstd, _zstd, arrays, encode, encode_blocks, entries, lists, pieces
from gridloom.plans.grid import hierarchy


def to_blocks(df: DataFrame, block: str, order: list[str], value: str, size: int | None = None) -> DataFrame:
    """block_id, data (values in order); with ``size`` only full blocks of that many nodes."""
    rows = df.groupBy(F.col(block).cast("long").alias("block_id")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("r"))
    out = rows.select("block_id", F.transform("r", lambda r: r["_v"].cast("double")).alias("data"))
    return out if size is None else out.filter(F.size("data") == size)


def number_in_blocks(df: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """Adds pos and block: blocks of ``size`` rows inside each key, never over all rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w) - 1).withColumn("block", F.floor(F.col("pos") / size))


def map_blocks(blocks: DataFrame, f, columns: str = "block_id long, data array<double>") -> DataFrame:
    """``f`` of each block's values, a bounded number of nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, entries("data")):
            made = [np.asarray(f(np.asarray(d, float)), float).ravel() for d in arrays(piece["data"])]
            yield pa.RecordBatch.from_arrays([piece["block_id"], lists(made, pa.float64())], names=["block_id", "data"])

    return blocks.select("block_id", "data").mapInArrow(run, columns)


def linear_blocks(df: DataFrame, f, column: str = "data", most: int = 64) -> DataFrame:
    """``df`` with ``f``, a linear transform, of each row's array; arrays of one node stay. Short arrays of one length go through its matrix together."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch[column]
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
            first, out = np.cumsum(sizes) - sizes, np.empty(len(flat))
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = first[sizes == n][:, None] + np.arange(n)
                if n == 1:
                    out[at] = flat[at]
                elif n > most:
                    out[at] = np.stack([f(u) for u in flat[at]])
                else:
                    if n not in matrices:
                        matrices[n] = np.stack([f(e) for e in np.eye(n)])
                    out[at] = flat[at] @ matrices[n]
            done = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([done if c == column else batch[c] for c in names], names=names)

    return df.mapInArrow(run, df.schema)


def _of_one_shape(shapes: list[tuple[int, ...]], most: int = PIECE) -> Iterator[tuple[tuple[int, ...], list[int]]]:
    """Each shape with the blocks that have it, as many at a time as ``most`` nodes."""
    held: dict[tuple[int, ...], list[int]] = {}
    for i, own in enumerate(shapes):
        held.setdefault(own, []).append(i)
    for own, at in held.items():
        step = max(1, most // math.prod(own))
        for k in range(0, len(at), step):
            yield own, at[k : k + step]


def compress(blocks: DataFrame, shape: tuple[int, ...] | None, tolerance: float, s: float = math.inf, codec: str = "huffman+zstd", relative: bool = False) -> DataFrame:
    """block_id, shape, tolerance, codec, payload: blocks whose decoded values stay within the tolerance of their own norm."""

    def run(batches):
        for piece in pieces(batches, entries("data")):
            data = [np.asarray(d, float) for d in arrays(piece["data"])]
            made: list[tuple] = [()] * len(data)
            for own, at in _of_one_shape([shape or (len(d),) for d in data]):
                u = np.stack([data[i].reshape(own) for i in at], -1)
                tau = np.asarray([tolerance * max(B.s_norm(u[..., k], s), np.finfo(float).eps) for k in range(len(at))]) if relative else np.full(len(at), tolerance)
                # quanta are proportional to the tolerance
                q = B.quantize(B.decompose(u, batch=1), B.quanta(own, 1.0, s)[..., None] * tau)
                # levels together: neighbours in the stream are alike
                order = np.argsort(hierarchy(own).birth_grid().ravel(), kind="stable")
                q = q.reshape(-1, len(at))[order]
                for k, i in enumerate(at):
                    made[i] = (list(own), tau[k], *encode(np.ascontiguousarray(q[:, k]), codec))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.list_(pa.int32()), pa.float64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([piece["block_id"], *columns, pa.array([8 * len(d) for d in data], pa.int64())], names=["block_id", "shape", "tau", "codec", "payload", "raw_bytes"])

    return blocks.select("block_id", "data").mapInArrow(run, "block_id long, shape array<int>, tau double, codec string, payload binary, raw_bytes long")


def decompress(coded: DataFrame, s: float = math.inf, stop: int | None = None) -> DataFrame:
    """block_id, data; ``stop``: the level to decode to."""

    def run(batches):
        for piece in pieces(batches, lambda batch: [math.prod(x) for x in batch["shape"].to_pylist()]):
            codecs, coded, tau = piece["codec"].to_pylist(), piece["payload"].to_pylist(), piece["tau"].to_numpy()
            out: list = [[]] * len(coded)
            for own, at in _of_one_shape([tuple(x) for x in piece["shape"].to_pylist()]):
                order = np.argsort(hierarchy(own).birth_grid().ravel(), kind="stable")
                q = np.empty((math.prod(own), len(at)))
                for k, i in enumerate(at):
                    q[order, k] = CODECS[codecs[i]][1](coded[i])
                c = q.reshape(*own, len(at)) * (B.quanta(own, 1.0, s)[..., None] * tau[at])
                u = B.recompose(c, stop=stop, batch=1).reshape(-1, len(at))
                for k, i in enumerate(at):
                    out[i] = u[:, k]
            yield pa.RecordBatch.from_arrays([piece["block_id"], lists(out, pa.float64())], names=["block_id", "data"])

    return coded.select("block_id", "shape", "tau", "codec", "payload").mapInArrow(run, "block_id long, data array<double>")


def _adaptive(words: list[bytes], least: float = 1.05, resume: int = 26) -> list[tuple[str, bytes]]:
    """Planes of a level coded until one hardly shrinks; after it they are stored as they are, up to plane ``resume``."""
    out, on = [], True
    for plane, word in enumerate(words):
        on = on or plane >= resume
        coded = _zstd(word, 1) if on else word
        on = on and len(word) >= least * len(coded)
        out.append(("zstd", coded) if len(coded) < len(word) else ("raw", word))
    return out


#: How the planes of a level are stored.
LEVEL_CODECS = {"raw": lambda words: [("raw", w) for w in words], "zstd": lambda words: [("zstd", _zstd(w, 1)) for w in words], "adaptive": _adaptive}


def refactor(blocks: DataFrame, planes: int = 32, level_codec: str = "zstd") -> DataFrame:
    """A row per fragment (block, level, bit plane): payload and the squared error left without this plane and those after it."""
    store = LEVEL_CODECS[level_codec]
    kinds = {"block_id": pa.int64(), "n": pa.int32(), "level": pa.int32(), "bitplane": pa.int32(), "exp": pa.int32(), "elements": pa.int32(), "sq_before": pa.float64(), "sq_after": pa.float64(), "size": pa.int64(), "codec": pa.string(), "payload": pa.binary()}

    def one_level(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[str, bytes]]]:
        """A row of coefficients for each block: exponents, squared errors by planes kept, and the planes as stored."""
        a = np.abs(v)
        top = a.max(1, initial=0)
        exp = np.where(top != 0, np.frexp(top)[1], 0)[:, None]
        fp = np.minimum(np.floor(np.ldexp(a, planes - exp)), 2.0**planes - 1).astype(np.int64)
        words = [np.packbits((fp >> (planes - 1 - plane)) & 1, axis=1) for plane in range(planes)]
        words[0] = np.c_[np.packbits(v < 0, axis=1), words[0]]
        left = np.stack([((a - np.ldexp((fp >> (planes - k) << (planes - k)).astype(float), exp - planes)) ** 2).sum(1) for k in range(planes + 1)], 1)
        return exp.ravel(), left, [x for i in range(len(v)) for x in store([w[i].tobytes() for w in words])]

    def made(ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        """All fragments of blocks of one size."""
        h, c = hierarchy(data.shape[:1]), B.decompose(data, batch=1)
        born, parts = h.birth_grid(), []
        for level in range(h.levels + 1):
            v = np.ascontiguousarray(c[born == level].T)
            exp, left, stored = one_level(v)
            each = lambda x: np.repeat(x, planes)
            all_of = lambda x: np.full(len(stored), x)
            payload = [p for _, p in stored]
            parts.append([each(ids), all_of(len(data)), all_of(level), np.tile(np.arange(planes), len(ids)), each(exp), all_of(v.shape[1]), left[:, :-1].ravel(), left[:, 1:].ravel(), list(map(len, payload)), [x for x, _ in stored], payload])
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(p[k], kind) for p in parts]) for k, kind in enumerate(kinds.values())], names=list(kinds))

    def run(batches):
        for piece in pieces(batches, entries("data")):
            ids, data = piece["block_id"].to_numpy(zero_copy_only=False), [np.asarray(d, float) for d in arrays(piece["data"])]
            # a block has planes times levels fragments: fewer nodes at a time than where it stays a row
            for _, at in _of_one_shape([d.shape for d in data], PIECE // 4):
                yield made(ids[at], np.stack([data[i] for i in at], -1))

    return blocks.select("block_id", "data").mapInArrow(run, "block_id long, n int, level int, bitplane int, exp int, elements int, sq_before double, sq_after double, size long, codec string, payload binary")


def request(fragments: DataFrame, tolerance: float, s: float | None = None, dims: int = 1, plan_by=greedy) -> DataFrame:
    """block_id, level, planes that a tolerance needs, by the most error saved per byte; reads metadata columns only.

    Without ``s`` squared errors of coefficients add up; with it each level's weigh as in the s-norm's estimate.
    """

    def plan(rows: pa.Table) -> pa.Table:
        level, plane, before, after, size = (rows[c].to_numpy() for c in ("level", "bitplane", "sq_before", "sq_after", "size"))
        levels, order = len(np.unique(level)), np.lexsort((plane, level))
        before, after, size = (x[order].reshape(levels, -1) for x in (before, after, size))
        weight = 1.0 if s is None else np.exp2(2 * s * np.arange(levels) + dims * (levels - 1 - np.arange(levels)))[:, None]
        used = plan_by(weight * np.c_[before, after[:, -1:]], size, tolerance**2)
        return pa.table({"block_id": pa.array([rows["block_id"][0].as_py()] * levels, pa.int64()), "level": pa.array(range(levels), pa.int32()), "planes": pa.array(used, pa.int32())})

    return fragments.select("block_id", "level", "bitplane", "sq_before", "sq_after", "size").groupBy("block_id").applyInArrow(plan, "block_id long, level int, planes int")


def refine(fragments: DataFrame, plan: DataFrame, loaded: DataFrame | None = None, planes: int = 32) -> DataFrame:
    """Values that the newly requested planes add: block_id, data. Add it to what was had before (all steps are linear)."""
    wanted = plan.select("block_id", "level", F.col("planes").alias("to"))
    if loaded is not None:
        wanted = wanted.join(loaded.select("block_id", "level", F.col("planes").alias("from")), ["block_id", "level"], "left")
    else:
        wanted = wanted.withColumn("from", F.lit(0))
    # the first plane carries the signs
    chosen = fragments.join(wanted, ["block_id", "level"]).filter((F.col("bitplane") < F.col("to")) & ((F.col("bitplane") >= F.coalesce("from", F.lit(0))) | (F.col("bitplane") == 0)))

    def one(rows: pa.Table) -> pa.Table:
        n = rows["n"][0].as_py()
        born, c, levels = hierarchy((n,)).birth_grid(), np.zeros(n), {}
        for level, plane, codec, payload, k, exp, start in zip(*(rows[x].to_pylist() for x in ("level", "bitplane", "codec", "payload", "elements", "exp", "from")), strict=True):
            fp, sign, _ = levels.setdefault(level, [np.zeros(k, np.int64), np.ones(k), exp])
            raw = np.frombuffer(_unzstd(payload) if codec == "zstd" else payload, np.uint8)
            if plane == 0:
                width = -(-k // 8)
                sign[:], raw = 1.0 - 2 * np.unpackbits(raw[:width], count=k), raw[width:]
            if plane >= (start or 0):
                fp |= np.unpackbits(raw, count=k).astype(np.int64) << (planes - 1 - plane)
        for level, (fp, sign, exp) in levels.items():
            c[born == level] = sign * np.ldexp(fp.astype(float), exp - planes)
        return pa.table({"block_id": rows["block_id"].slice(0, 1), "data": lists([B.recompose(c)], pa.float64())})

    needed = chosen.select("block_id", "n", "level", "bitplane", "exp", "elements", "codec", "payload", "from")
    return needed.groupBy("block_id").applyInArrow(one, "block_id long, data array<double>")


def added(before: DataFrame, delta: DataFrame) -> DataFrame:
    both = before.join(delta.withColumnRenamed("data", "_d"), "block_id", "left")
    return both.select("block_id", F.when(F.col("_d").isNull(), F.col("data")).otherwise(F.zip_with("data", "_d", lambda a, b: a + b)).alias("data"))


def compress_regions(nodes: DataFrame, key: str, width: int, fractions: list[float], ratio: int, radius: int, quantum: float, scale: int, codec: str = "huffman+zstd") -> DataFrame:
    """block_id, codec, payload, raw_bytes: series (key, n, i, lvl, coef) quantized finely in their most active regions and around them, coarsely elsewhere, and coded. All values are multiples of the fine quantum, so a decoder needs no map."""
    kept = quantities.nested_regions(nodes, [key], width, fractions, ratio)
    finest = -(-width // ratio ** (len(fractions) - 1))
    zoned = quantities.level_zones(nodes, kept, key, finest, radius)
    q = zoned.withColumn("_q", quantities.roi_quantized(F.col("coef"), F.lit(quantum), F.col("zone"), scale))
    blocks = q.groupBy(F.col(key).cast("long").alias("block_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "_q"))), lambda r: r["_q"]).alias("q"))
    return encode_blocks(blocks, codec)
