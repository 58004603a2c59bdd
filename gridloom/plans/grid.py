"""Grid hierarchies, worked out on the driver: shapes of levels, index sets, birth levels, block plans."""

from __future__ import annotations

import math

import numpy as np


def parse_shape(text: str) -> tuple[int, ...]:
    """'AxBxC' as sizes."""
    return check_shape(tuple(int(p) for p in text.lower().split("x")))


def check_shape(shape: tuple[int, ...]) -> tuple[int, ...]:
    if not shape or any(n < 1 for n in shape) or all(n == 1 for n in shape):
        raise ValueError(f"a grid needs positive sizes, one of them over 1: {shape}")
    return shape


class Hierarchy:
    """Dyadic hierarchy: level sizes are 2^k + 1 up to the last level, which has the given shape."""

    def __init__(self, shape: tuple[int, ...]):
        self.shape = check_shape(tuple(shape))
        self.powers = [(n - 1).bit_length() - 1 if n > 1 else None for n in shape]
        self.dyadic = min(p for p in self.powers if p is not None)
        self.exact = all(p is None or n == 2**p + 1 for n, p in zip(shape, self.powers, strict=True))
        self.levels = self.dyadic + (not self.exact)

    def level_shape(self, level: int) -> tuple[int, ...]:
        if level == self.levels:
            return self.shape
        return tuple(1 if p is None else 2 ** (p - self.dyadic + level) + 1 for p in self.powers)

    def indices(self, level: int, dim: int) -> np.ndarray:
        n, m = self.shape[dim], self.level_shape(level)[dim]
        return np.zeros(1, np.int64) if m == 1 else np.arange(m) * (n - 1) // (m - 1)

    def births(self, dim: int) -> np.ndarray:
        """Smallest level that holds each index of a dimension."""
        out = np.full(self.shape[dim], self.levels)
        for level in range(self.levels, -1, -1):
            out[self.indices(level, dim)] = level
        return out

    def birth_grid(self) -> np.ndarray:
        out = np.zeros(self.shape, np.int64)
        for d in range(len(self.shape)):
            out = np.maximum(out, self.births(d).reshape([-1 if k == d else 1 for k in range(len(self.shape))]))
        return out


class Halving(Hierarchy):
    """Every other node goes at each step, the last one always stays: sizes n to n // 2 + 1, down to 2 along the shortest side."""

    def __init__(self, shape: tuple[int, ...], most: int | None = None):
        self.shape = check_shape(tuple(shape))
        self.levels = halved_depth(shape, most)
        self.sets = []
        for n in shape:
            sets = [np.arange(n)]
            for _ in range(self.levels):
                fine = sets[0]
                coarse = fine[::2] if len(fine) % 2 else np.append(fine[::2], fine[-1])
                sets.insert(0, fine if n == 1 else coarse)
            self.sets.append(sets)

    def level_shape(self, level: int) -> tuple[int, ...]:
        return tuple(len(sets[level]) for sets in self.sets)

    def indices(self, level: int, dim: int) -> np.ndarray:
        return self.sets[dim][level]


_known: dict[tuple, Hierarchy] = {}


def hierarchy(shape: tuple[int, ...], kind: type[Hierarchy] = Hierarchy) -> Hierarchy:
    """The hierarchy of a shape, held for the next block of that shape."""
    if (kind, shape) not in _known:
        if len(_known) > 256:
            _known.clear()
        _known[kind, shape] = kind(shape)
    return _known[kind, shape]


def halved_levels(n: int) -> list[int]:
    """Sizes of the halving hierarchy: n to n // 2 + 1 until 2."""
    out = [n]
    while out[-1] > 2:
        out.append(out[-1] // 2 + 1)
    return out


def halved_depth(shape: tuple[int, ...], most: int | None = None) -> int:
    depth = min(len(halved_levels(n)) for n in shape if n > 1) - 1
    return depth if most is None else min(depth, most)


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def balanced_shape(shape: tuple[int, ...]) -> tuple[int, ...]:
    """The longest side's prime factors dealt, largest first, to whichever side is shortest."""
    sizes = list(shape)
    longest = max(range(len(sizes)), key=lambda d: sizes[d])
    factors, sizes[longest] = prime_factors(sizes[longest]), 1
    for f in reversed(factors):
        sizes[min(range(len(sizes)), key=lambda d: sizes[d])] *= f
    return tuple(sizes)


def split_longest(shape: tuple[int, ...], most_nodes: int) -> tuple[int, int]:
    """The dimension to cut and the block size along it, halved until a block fits."""
    dim = max(range(len(shape)), key=lambda d: shape[d])
    size, rest = shape[dim], math.prod(shape) // shape[dim]
    while size > 1 and size * rest > most_nodes:
        size = -(-size // 2)
    return dim, size


def cubic_blocks(shape: tuple[int, ...], size: int, most_nodes: int) -> tuple[int, ...]:
    while size > 1 and math.prod(min(size, n) for n in shape) > most_nodes:
        size = -(-size // 2)
    return tuple(min(size, n) for n in shape)
