"""Nodes as rows: flat places, domain decomposition, blocks taken out and put back, and the orders that levels are gathered in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def flat_index(indices: list[Column], sizes: list[Column | int]) -> Column:
    """Row-major place of a multi-index."""
    out = indices[0]
    for i, n in zip(indices[1:], sizes[1:], strict=True):
        out = out * n + i
    return out


def multi_index(place: Column, sizes: list[int]) -> list[Column]:
    """The multi-index of a row-major place."""
    out = []
    for d in range(len(sizes)):
        rest = math.prod(sizes[d + 1 :])
        out.append(F.floor(place / rest) % sizes[d])
    return out


def cartesian(df: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """Each row with all combinations of the arrays' elements, which the caller bounds."""
    for name, values in arrays.items():
        df = df.withColumn(name, F.explode(values))
    return df


def in_blocks(df: DataFrame, sizes: dict[str, int], counts: list[Column | int]) -> DataFrame:
    """Adds block_id: index columns cut into blocks of the given sizes, blocks numbered in row-major order (``counts`` per dimension)."""
    return df.withColumn("block_id", flat_index([F.floor(F.col(c) / n) for c, n in sizes.items()], counts).cast("long"))


def in_variable_blocks(df: DataFrame, index: str, sizes: list[int]) -> DataFrame:
    """Adds block_id and offset: blocks of the caller's sizes along one dimension; what is beyond the last goes to one more block."""
    starts = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    block = sum((F.when(F.col(index) >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0))
    return df.withColumn("block_id", block.cast("int")).withColumn("offset", F.col(index) - F.element_at(F.array(*map(F.lit, starts)), F.col("block_id") + 1))


def box(bounds: dict[str, tuple[int, int]]) -> Column:
    """Whether a node lies in the box (ends excluded)."""
    out = F.lit(True)
    for c, (lo, hi) in bounds.items():
        out = out & (F.col(c) >= lo) & (F.col(c) < hi)
    return out


def take_box(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """The nodes of a box, with their indices inside it."""
    return df.filter(box(bounds)).select(*[(F.col(c) - bounds[c][0]).alias(c) if c in bounds else F.col(c) for c in df.columns])


def put_box(df: DataFrame, inner: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """``df`` with the nodes of a box replaced by those of ``inner``; no join."""
    back = inner.select(*[(F.col(c) + bounds[c][0]).alias(c) if c in bounds else F.col(c) for c in df.columns])
    return df.filter(~box(bounds)).unionByName(back)


def sub_block(indices: list[Column], half: int) -> Column:
    """Which of the eight (or four, or two) parts of a level a node is in: 0 is the coarse part."""
    return flat_index([F.when(i >= half, 1).otherwise(0) for i in indices], [2] * len(indices))


def curve_key(indices: list[Column], bits: int) -> Column:
    """Place on the bit-interleaving curve."""
    out = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in indices:
            out = out * 2 + F.call_function("shiftright", i.cast("long"), F.lit(b)).bitwiseAND(F.lit(1).cast("long"))
    return out


def block_key(indices: list[Column], size: int, side: int) -> Column:
    """Place when a cube of ``side`` is gathered block by block of ``size``, row-major in both."""
    blocks = -(-side // size)
    outer = flat_index([F.floor(i / size) for i in indices], [blocks] * len(indices))
    return outer * size ** len(indices) + flat_index([i % size for i in indices], [size] * len(indices))
