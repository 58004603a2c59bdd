"""Command line: compress and decompress raw files, refactor and reconstruct by tolerance."""

from __future__ import annotations

import argparse
import math

import numpy as np
from pyspark.sql import SparkSession

from gridloom.operators import fields
from gridloom.plans.grid import parse_shape
from gridloom.sources.files import read_fragments, read_raw, write_fragments


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridloom")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress", "refactor", "reconstruct"):
        p = sub.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--datatype", choices=["float", "double"], default="double")
        p.add_argument("--shape", type=parse_shape)
        p.add_argument("--smoothness", type=float, default=math.inf)
        p.add_argument("--tolerance", type=float, nargs="+", default=[1e-3])
        p.add_argument("--relative", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    dtype = "<f4" if args.datatype == "float" else "<f8"
    if args.command == "compress":
        fields.compress(read_raw(spark, args.input, dtype), args.shape, args.tolerance[0], args.smoothness, relative=args.relative).write.mode("overwrite").parquet(args.output)
    elif args.command == "decompress":
        fields.decompress(spark.read.parquet(args.input), args.smoothness).write.mode("overwrite").parquet(args.output)
    elif args.command == "refactor":
        write_fragments(fields.refactor(read_raw(spark, args.input, dtype)), args.output)
    else:
        had, loaded = None, None
        for tolerance in sorted(args.tolerance, reverse=True):
            fragments = read_fragments(spark, args.input)
            plan = fields.request(fragments, tolerance)
            delta = fields.refine(fragments, plan, loaded)
            had, loaded = (delta if had is None else fields.added(had, delta)), plan
            had.write.mode("overwrite").parquet(f"{args.output}/tolerance={tolerance:g}")


def random_field(shape: tuple[int, ...], seed: int = 343873) -> np.ndarray:
    """A smooth random field: cosines whose size falls with their frequency."""
    rng = np.random.default_rng(seed)
    u, axes = np.zeros(shape), np.meshgrid(*[np.linspace(0, 1, n) for n in shape], indexing="ij")
    for _ in range(40):
        k = rng.integers(0, 8, len(shape))
        u += rng.normal() / (1 + (k**2).sum()) * np.cos(np.pi * sum(a * b for a, b in zip(k, axes, strict=True)))
    return u


