"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEGABINARY = 0x2AAAAAAAAAAAAAAA


def quantized(x: Column, quantum: Column) -> Column:
    """Nearest multiple of the quantum as an integer, halves away from zero; raises where that isn't defined."""
    n = F.signum(x) * F.floor(F.abs(x / quantum) + 0.5)
    bad = F.isnan(x) | (F.abs(n) >= 9.2e18) | (quantum <= 0)
    return F.when(bad, F.raise_error(F.lit("value can't be quantized"))).otherwise(n.cast("long"))


def narrowed(n: Column, bits: int) -> Column:
    """A quantized value as an integer of ``bits`` bits, with a range check."""
    kind = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits]
    if bits == 64:
        return n
    return F.when((n < -(1 << bits - 1)) | (n >= 1 << bits - 1), F.raise_error(F.lit(f"outside of {bits} bits"))).otherwise(n).cast(kind)


def ldexp(x: Column, k: Column) -> Column:
    return x * F.pow(F.lit(2.0), k)


def exponent(x: Column) -> Column:
    """The e with 2^(e-1) <= abs(x) < 2^e; 0 for 0. Exact at powers of two, where the logarithm may be off by a little."""
    guess = F.floor(F.log2(F.abs(x))) + 1
    low = F.when(F.pow(F.lit(2.0), guess - 1) > F.abs(x), guess - 1).when(F.pow(F.lit(2.0), guess) <= F.abs(x), guess + 1).otherwise(guess)
    return F.when(x == 0, 0).otherwise(low).cast("int")


def copysign(size: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(size)).otherwise(F.abs(size))


def to_negabinary(n: Column) -> Column:
    mask = F.lit(NEGABINARY).cast("long")
    return (n + mask).bitwiseXOR(mask)


def from_negabinary(n: Column) -> Column:
    mask = F.lit(NEGABINARY).cast("long")
    return n.bitwiseXOR(mask) - mask


def bit(n: Column, k: int) -> Column:
    return F.shiftright(n, k).bitwiseAND(F.lit(1).cast("long"))
