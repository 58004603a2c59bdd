"""Bit planes: fixed point, words per plane, errors of truncation, and which fragments a tolerance needs."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.scalar import exponent, from_negabinary, to_negabinary


def level_exponents(coefs: DataFrame, key: list[str], value: str = "coef") -> DataFrame:
    return coefs.groupBy(*key).agg(exponent(F.max(F.abs(value))).alias("exp"))


def fixed_point(value: Column, exp: Column, planes: int) -> Column:
    """Magnitude with ``planes`` bits, cut toward zero."""
    return F.least(F.floor(F.abs(value) * F.pow(F.lit(2.0), planes - exp)), F.lit(2**planes - 1)).cast("long")


def words(df: DataFrame, key: list[str], group: Column, place: Column, planes: int, fp: str = "fp") -> DataFrame:
    """A word per (key, block, plane): bit ``place`` is that node's bit; plane 0 is the highest."""
    # all planes in one aggregate: a row of words per block, taken apart after the shuffle
    bits = [F.sum(F.call_function("shiftleft", F.call_function("shiftright", F.col("_fp"), F.lit(k)).bitwiseAND(F.lit(1).cast("long")), F.col("place"))) for k in range(planes - 1, -1, -1)]
    rows = df.select(*key, group.alias("block"), place.alias("place"), F.col(fp).alias("_fp"))
    return rows.groupBy(*key, "block").agg(F.array(*bits).alias("w")).select(*key, "block", F.posexplode("w").alias("bitplane", "word"))


def negabinary_words(df: DataFrame, key: list[str], group: Column, place: Column, planes: int, q: str = "q") -> DataFrame:
    """Words of base -2 digits: they carry the sign, so no plane of signs is needed."""
    return words(df.withColumn("_nb", to_negabinary(F.col(q))), key, group, place, planes, "_nb")


def negabinary_errors(df: DataFrame, key: list[str], planes: int, q: str = "q") -> DataFrame:
    """Squared and largest error for each number of base -2 planes kept, in units of the last place."""
    nb, rest = to_negabinary(F.col(q)), []
    for kept in range(planes + 1):
        low = nb.bitwiseAND(F.lit((1 << planes - kept) - 1).cast("long"))
        rest.append(F.abs(from_negabinary(low)).cast("double"))
    return _by_kept(df.select(*key, *[d.alias(f"_d{k}") for k, d in enumerate(rest)]), key, planes)


def truncation_errors(df: DataFrame, key: list[str], planes: int, exp: str = "exp", value: str = "coef", fp: str = "fp") -> DataFrame:
    """Squared and largest error by level for each number of planes kept."""
    cut = lambda kept: F.floor(F.col(fp) / 2.0 ** (planes - kept)) * F.pow(F.lit(2.0), F.col(exp) - kept)
    return _by_kept(df.select(*key, *[(F.abs(value) - cut(k)).alias(f"_d{k}") for k in range(planes + 1)]), key, planes)


def _by_kept(rows: DataFrame, key: list[str], planes: int) -> DataFrame:
    both = [F.struct(F.sum(F.col(f"_d{k}") * F.col(f"_d{k}")).alias("sq_err"), F.max(f"_d{k}").alias("max_err")) for k in range(planes + 1)]
    out = rows.groupBy(*key).agg(F.array(*both).alias("e")).select(*key, F.posexplode("e").alias("kept", "e"))
    return out.select(*key, "kept", "e.sq_err", "e.max_err")


def greedy(errors: np.ndarray, sizes: np.ndarray, tolerance: float) -> list[int]:
    """Planes per level: always the plane with the most error saved per byte, until the sum of errors is below the tolerance.

    ``errors``: levels x (planes + 1); ``sizes``: levels x planes. A few hundred numbers: the driver's work.
    """
    used, left = [0] * len(errors), float(errors[:, 0].sum())

    ends = np.c_[np.zeros(len(sizes), np.int64), np.cumsum(sizes, 1)]

    def offer(level: int) -> tuple[float, int, int]:
        # a plane that saves nothing is taken together with those after it
        k = used[level]
        rates = (errors[level, k] - errors[level, k + 1 :]) / np.maximum(1, ends[level, k + 1 :] - ends[level, k])
        rates = np.where(rates > 0, rates, 0.0)
        best = int(rates.argmax())
        return -float(rates[best]), level, k + 1 + best

    heap = [offer(level) for level in range(len(errors)) if errors.shape[1] > 1]
    heapq.heapify(heap)
    while heap and left >= tolerance:
        _, level, to = heapq.heappop(heap)
        left += float(errors[level, to] - errors[level, used[level]])
        used[level] = to
        if to < errors.shape[1] - 1:
            heapq.heappush(heap, offer(level))
    return used


def _by_rate(errors: np.ndarray, used: list[int], open_levels: list[int], tolerance: float, offer) -> list[int]:
    """Take the offered run of planes with the best rate until the sum of errors is below the tolerance; ``offer(level, from)`` gives rate and end."""
    left = sum(float(errors[level, k]) for level, k in enumerate(used))
    last = errors.shape[1] - 1
    heap = [(-offer(level, used[level])[0], level) for level in open_levels if used[level] < last]
    heapq.heapify(heap)
    while heap and left >= tolerance:
        level = heapq.heappop(heap)[1]
        to = offer(level, used[level])[1]
        left += float(errors[level, to] - errors[level, used[level]])
        used[level] = to
        if to < last:
            heapq.heappush(heap, (-offer(level, to)[0], level))
    return used


def greedy_after_first(errors: np.ndarray, sizes: np.ndarray, tolerance: float) -> list[int]:
    """Planes per level where the first plane carries the signs: levels join from the coarsest, each with its first plane, until those that joined could reach the tolerance; then single planes by rate."""
    used, reachable, joined = [0] * len(errors), float(errors[:, 0].sum()), []
    for level in range(len(errors)):
        used[level] = min(1, errors.shape[1] - 1)
        joined.append(level)
        reachable += float(errors[level, -1] - errors[level, 0])
        if reachable < tolerance:
            break
    return _by_rate(errors, used, joined, tolerance, lambda level, k: ((errors[level, k] - errors[level, k + 1]) / max(1, sizes[level, k]), k + 1))


def greedy_runs(errors: np.ndarray, sizes: np.ndarray, tolerance: float) -> list[int]:
    """Planes per level for base -2 digits, where a plane alone may make the error larger: runs of planes, as long as the rate doesn't fall."""

    def offer(level: int, k: int) -> tuple[float, int]:
        rate = lambda to: (errors[level, k] - errors[level, to]) / max(1, sizes[level, k:to].sum())
        to = k + 1
        while to + 1 < errors.shape[1] - 1 and not rate(to) > max(0.0, rate(to + 1)):
            to += 1
        return rate(to), to

    return _by_rate(errors, [0] * len(errors), list(range(len(errors))), tolerance, offer)


def max_error_factor(dims: int, hierarchical: bool = False, negabinary: bool = False) -> float:
    """What multiplies the sum of levels' largest errors to bound the error in the maximum norm."""
    c = {1: 1 + math.sqrt(3) / 2, 2: 13 / 4, 3: 1 + 21 * math.sqrt(3) / 8}[dims]
    return 1.0 if hierarchical else (4 if negabinary else 1) * c


def squared_error_weight(s: float, level: Column, levels: Column, dims: int) -> Column:
    return F.pow(F.lit(2.0), 2 * s * level + dims * (levels - level))
