"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, stage


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the smallest node that a path leads to.

    Each round every node takes the smallest label about it (combined before
    the shuffle), then its label's own label; the labels are staged, so a
    round costs the same at any depth and survives lost executors.
    """
    both = stage(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))).distinct(), "cc-edges")
    labels = stage(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("root")), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("near"), F.col("root").alias("near_root")), "near").groupBy("node").agg(F.min("near_root").alias("near_root"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near_root").alias("lower"))
        # a root hears of lower labels from its members, and members jump to their root's label
        hooks = lower.groupBy("root").agg(F.min("lower").alias("hook"))
        next_labels = stage(lower.join(hooks, "root").select("node", F.col("root").alias("was"), F.least("lower", "hook").alias("root")), "cc-labels")
        jump = next_labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = stage(next_labels.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")), "cc-labels")
        changed = not jumped.filter("root != was").isEmpty()
        drop_staged(labels)
        drop_staged(next_labels)
        labels = jumped
        if not changed:
            return labels.select("node", "root")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
