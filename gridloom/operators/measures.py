"""Norms, tolerances, error measures, histograms and quanta: plain aggregates, combined map-side."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window, functions as F


def linf(x: str) -> Column:
    return F.max(F.abs(x))


def rms(x: str) -> Column:
    """Root mean square; the smallest positive step for a zero field."""
    r = F.sqrt(F.sum(F.col(x) * F.col(x)) / F.count(x))
    return F.when(r == 0, sys.float_info.epsilon).otherwise(r)


def combined(blocks: DataFrame, norm: str, s: float) -> DataFrame:
    """A global norm from those of blocks."""
    return blocks.agg((F.max(norm) if math.isinf(s) else F.sqrt(F.sum(F.col(norm) * F.col(norm)))).alias(norm))


def local_tolerance(tolerance: Column, blocks: Column, s: float) -> Column:
    return tolerance if math.isinf(s) else F.sqrt(tolerance * tolerance / blocks)


def errors(df: DataFrame, key: list[str], original: str, decoded: str) -> DataFrame:
    """linf_err, mse, psnr, nrmse by ``key``."""
    d = F.col(original) - F.col(decoded)
    span = F.col("hi") - F.col("lo")
    out = df.groupBy(*key).agg(F.max(F.abs(d)).alias("linf_err"), F.avg(d * d).alias("mse"), F.min(original).alias("lo"), F.max(original).alias("hi"))
    return out.select(*key, "linf_err", "mse", F.when(F.col("mse") > 0, 20 * F.log10(span / F.sqrt("mse"))).alias("psnr"), (F.sqrt("mse") / span).alias("nrmse"))


def histogram(df: DataFrame, key: list[str], symbol: str) -> DataFrame:
    return df.groupBy(*key, symbol).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """Bits per symbol, from counts; no window over ungrouped rows: two sums are enough."""
    # -sum p log p = log N - (sum n log n) / N
    return counts.groupBy(*key).agg((F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n)).alias("bits"), F.sum(n).alias("total"), F.count("*").alias("symbols"))


def supremum_quantum(tolerance: float, levels: Column, dims: int) -> Column:
    return F.lit(2 * tolerance) / ((levels + 1) * (1 + 3**dims))


def halved_quantum(tolerance: float, depth: int, dims: int, by_dimension: bool = False) -> float:
    """Maximum-norm quantum of the halving hierarchy, which counts all dimensions."""
    return 2 * tolerance / ((depth + 1) * (dims * 4 if by_dimension else 1 + 3**dims))


def level_quantum(tolerance: float, s: float, level: Column, nodes: Column) -> Column:
    """Smoothness-weighted quantum per level, to be divided by the root of the node's volume."""
    return F.lit(2 * tolerance) / (F.pow(F.lit(2.0), F.lit(s) * level) * F.sqrt(nodes))


def split_outliers(df: DataFrame, q: str, size: int) -> DataFrame:
    """Adds symbol (shifted to 0..size-1, 0 for outliers) and outlier (the value where it lies outside, else null)."""
    shifted = F.col(q) + size // 2
    inside = (shifted >= 0) & (shifted < size)
    return df.withColumn("symbol", F.when(inside, shifted).otherwise(0)).withColumn("outlier", F.when(~inside, F.col(q)))


def restored(symbol: Column, outlier: Column, size: int) -> Column:
    return F.coalesce(outlier, symbol - size // 2)


def plan_planes(planes: DataFrame, order: list[str], key: list[str], tolerance: float) -> DataFrame:
    """Fragments in order until the error left is below the tolerance: a running sum in each field's few metadata rows.

    ``planes``: key, level, bitplane, size, gain (drop of the error by this plane), total (error with no plane).
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("gain").over(w), F.lit(0.0))
    return planes.withColumn("err_before", left).filter(F.col("err_before") >= tolerance)
