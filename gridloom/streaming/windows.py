"""Streams: error-bounded reduction of windows as they close, and running per-key state."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import fields


def window_stats(events: DataFrame, ts: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Norms and counts of event-time windows; late rows beyond the watermark are left out, as they must be."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.max(F.abs(value)).alias("linf"), F.sum(F.col(value) * F.col(value)).alias("sq")).select(F.col("w.start").alias("start"), "n", "linf", "sq")


def reduce_batches(events: DataFrame, block: str, order: list[str], value: str, tolerance: float, path: str, checkpoint: str, s: float = math.inf) -> StreamingQuery:
    """Each micro-batch's series are compressed and appended under ``path``, once per batch id."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        series = fields.to_blocks(batch, block, order, value).filter(F.size("data") >= 2)
        fields.compress(series, None, tolerance, s).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
