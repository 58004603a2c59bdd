"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and the engine's throughput on a larger field; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions import scalar
from gridloom.operators import bitplanes, blocks, fields, measures
from gridloom.plans import catalogue

HEADLINE = ["hier_quantize_entropy", "hier_coefficients", "linear_quantize", "quantize_error", "histogram", "entropy", "bitplane_words", "bitplane_errors", "orthogonal_decompose", "compress_bound", "block_topk_roi", "moments", "iso_edge_cases", "mesh_mass", "scans"]
SIDE = 65
BLOCKS = 64


def seconds(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def throughput(spark: SparkSession, cpus: int) -> dict[str, float]:
    """GB/s of doubles that go in, over blocks of 65 x 65 x 65 of a smooth field; the compression ratio and the worst error beside them."""
    n = SIDE**3
    at = lambda k: (F.floor(F.col("i") / SIDE**k) % SIDE / (SIDE - 1)).cast("double")
    value = F.sin(2 * at(0) - at(1) + F.col("block_id") / 7) + F.sin(3 * at(2) - at(1)) + F.sin(4 * at(0) * at(1) * at(2))
    nodes = spark.range(BLOCKS, numPartitions=cpus).withColumnRenamed("id", "block_id").select("block_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("block_id", "i", value.alias("v"))
    data = spark.range(BLOCKS, numPartitions=cpus).withColumnRenamed("id", "block_id").select("block_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(i / 5000.0) + F.sin(i / 70.0 + F.col("block_id"))).alias("data")).cache()
    nodes = nodes.cache()
    nodes.count(), data.count()
    gb, tolerance = 8 * n * BLOCKS / 1e9, 1e-3
    coded = fields.compress(data, (SIDE,) * 3, tolerance, codec="zstd").cache()
    took = {
        "compress": seconds(coded),
        "decompress": seconds(fields.decompress(coded)),
        "decompose": seconds(fields.map_blocks(data, lambda u: blocks.decompose(u.reshape((SIDE,) * 3)).ravel())),
        "quantize": seconds(nodes.select(scalar.quantized(F.col("v"), F.lit(tolerance)).alias("q"))),
        "histogram": seconds(measures.histogram(nodes.withColumn("q", scalar.quantized(F.col("v"), F.lit(0.01))), [], "q")),
        "bitplanes": seconds(bitplanes.words(nodes.withColumn("fp", bitplanes.fixed_point(F.col("v"), F.lit(2), 32)), ["block_id"], F.floor(F.col("i") / 32), (F.col("i") % 32).cast("int"), 32)),
    }
    both = data.join(fields.decompress(coded).withColumnRenamed("data", "back"), "block_id").select(F.array_max(F.zip_with("data", "back", lambda a, b: F.abs(a - b))).alias("e")).agg(F.max("e")).first()[0]
    ratio = coded.agg(F.sum("raw_bytes") / F.sum(F.octet_length("payload"))).first()[0]
    return {k: round(gb / t, 4) for k, t in took.items()} | {"gb": round(gb, 3), "ratio": round(ratio, 2), "worst_error": both, "tolerance": tolerance}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {name: round(seconds(catalogue.QUERIES[name](spark, sf_dir)), 3) for name in HEADLINE}
    speed = throughput(spark, int(cpus))
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "gb_per_s": speed, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
