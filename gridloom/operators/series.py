"""One-dimensional fields: a row per series with its values in order, and per node where levels are needed.

A node's birth level follows from its index alone (level l of n nodes holds
floor(j (n-1) / 2^l)), so levels and neighbours need no join: one shuffle makes
the series, and all else is array expressions in that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def to_series(df: DataFrame, key: str, order: list[str], value: str, least: int = 3) -> DataFrame:
    """key, n, values (in order): series of ``least`` nodes or more."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_rows"))
    return rows.select(key, F.size("_rows").alias("n"), F.transform("_rows", lambda r: r["_v"]).alias("values")).filter(F.col("n") >= least)


def dyadic(n: Column) -> Column:
    return F.length(F.bin(n - 1)) - 1


def last_level(n: Column) -> Column:
    return dyadic(n) + F.when(F.pow(F.lit(2.0), dyadic(n)) + 1 == n, 0).otherwise(1)


def _coarse_right(i: Column, n: Column, level: Column) -> Column:
    """j of the first node at or after i in the level's index set."""
    m = F.pow(F.lit(2.0), level).cast("long")
    return F.floor((i * m + n - 2) / (n - 1)).cast("long")


def node_of(j: Column, n: Column, level: Column) -> Column:
    m = F.pow(F.lit(2.0), level).cast("long")
    return F.floor(j * (n - 1) / m).cast("long")


def nodes(series: DataFrame, key: str) -> DataFrame:
    """key, n, i, v, lvl and the coarse neighbours of nodes that level lvl brings: il, ir, vl, vr (null at level 0)."""
    rows = series.select(key, F.col("n").cast("long").alias("n"), "values", F.posexplode("values").alias("pos", "v")).withColumn("i", F.col("pos").cast("long"))
    levels = F.filter(F.sequence(F.lit(0), dyadic(F.col("n"))), lambda l: node_of(_coarse_right(F.col("i"), F.col("n"), l), F.col("n"), l) == F.col("i"))
    rows = rows.withColumn("lvl", F.coalesce(F.array_min(levels), last_level(F.col("n"))).cast("int"))
    j = _coarse_right(F.col("i"), F.col("n"), F.col("lvl") - 1)
    new = F.col("lvl") > 0
    rows = rows.withColumn("il", F.when(new, node_of(j - 1, F.col("n"), F.col("lvl") - 1))).withColumn("ir", F.when(new, node_of(j, F.col("n"), F.col("lvl") - 1)))
    return rows.select(key, "n", "i", "v", "lvl", "il", "ir", F.get("values", F.col("il").cast("int")).alias("vl"), F.get("values", F.col("ir").cast("int")).alias("vr"))


def hierarchical(node_rows: DataFrame) -> DataFrame:
    """Adds interp and coef of the hierarchical basis: the value minus the interpolant of the next coarser level."""
    w = (F.col("i") - F.col("il")) / (F.col("ir") - F.col("il"))
    interp = F.col("vl") + w * (F.col("vr") - F.col("vl"))
    return node_rows.withColumn("interp", F.when(F.col("lvl") > 0, interp).otherwise(0.0)).withColumn("coef", F.col("v") - F.col("interp"))


def rebuild(coefs: DataFrame, key: str, value: str = "decoded") -> DataFrame:
    """Nodal values from hierarchical coefficients (``value``), level by level inside each series' row."""
    rows = coefs.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("i", "lvl", "il", "ir", F.col(value).alias("c")))).alias("r"))
    top = F.array_max(F.transform("r", lambda x: x["lvl"]))

    def level(values: Column, l: Column) -> Column:
        def node(x: Column) -> Column:
            vl, vr = F.get(values, x["il"].cast("int")), F.get(values, x["ir"].cast("int"))
            w = (x["i"] - x["il"]) / (x["ir"] - x["il"])
            return F.when(x["lvl"] == l, vl + w * (vr - vl) + x["c"]).otherwise(F.get(values, x["i"].cast("int")))

        return F.transform("r", node)

    first = F.transform("r", lambda x: x["c"])
    # each level's values need those of the level below: as many steps as there are levels
    return rows.select(key, "n", F.aggregate(F.sequence(F.lit(1), top), first, level).alias("values")).select(key, "n", F.posexplode("values").alias("i", "v"))


def mass_stencil(df: DataFrame, key: str, i: str, v: str, h: Column) -> DataFrame:
    """Adds mv: the mass matrix of uniform spacing ``h`` along each series."""
    w = Window.partitionBy(key).orderBy(i)
    left, right = F.lag(v).over(w), F.lead(v).over(w)
    sides = F.when(left.isNull(), 0).otherwise(1) + F.when(right.isNull(), 0).otherwise(1)
    return df.withColumn("mv", h / 6 * F.coalesce(left, F.lit(0.0)) + sides * h / 3 * F.col(v) + h / 6 * F.coalesce(right, F.lit(0.0)))


def restricted(df: DataFrame, key: str, i: str, v: str, new: Column) -> DataFrame:
    """Coarse nodes with a half of each new neighbour added (uniform spacing, new nodes between coarse ones)."""
    w = Window.partitionBy(key).orderBy(i)
    share = F.when(new, F.col(v) / 2).otherwise(0.0)
    return df.withColumn("rv", F.col(v) + F.coalesce(F.lag(share).over(w), F.lit(0.0)) + F.coalesce(F.lead(share).over(w), F.lit(0.0))).filter(~new)


def halving(series: DataFrame, key: str) -> DataFrame:
    """key, i, v, lvl, coef on the halving hierarchy: a node's lowest bit is its step, and the last node is on every level."""
    rows = series.select(key, F.col("n").cast("long").alias("n"), "values", F.posexplode("values").alias("pos", "v")).withColumn("i", F.col("pos").cast("long"))
    step = F.col("i").bitwiseAND(-F.col("i"))
    old = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    il, ir = F.col("i") - step, F.least(F.col("i") + step, F.col("n") - 1)
    value = lambda j: F.get("values", j.cast("int"))
    interp = value(il) + step / (ir - il) * (value(ir) - value(il))
    lvl = F.when(old, 0).otherwise(F.length(F.bin(F.col("n") - 2)) - (F.length(F.bin(step)) - 1))
    return rows.select(key, "i", "v", lvl.cast("int").alias("lvl"), F.when(old, F.col("v")).otherwise(F.col("v") - interp).alias("coef"))


def from_level(series: DataFrame, key: str, level: int) -> DataFrame:
    """key, i, v: what the nodes of a level say of all, with zero coefficients beyond it."""
    n, l = F.col("n").cast("long"), F.lit(level)
    rows = series.select(key, n.alias("n"), "values", F.posexplode("values").alias("pos", "v")).select(key, "n", "values", F.col("pos").cast("long").alias("i"))
    j = _coarse_right(F.col("i"), F.col("n"), l)
    il, ir = node_of(F.greatest(j - 1, F.lit(0)), F.col("n"), l), node_of(j, F.col("n"), l)
    value = lambda k: F.get("values", k.cast("int"))
    between = value(il) + (F.col("i") - il) / (ir - il) * (value(ir) - value(il))
    return rows.select(key, "i", F.when(F.col("i") == ir, value(ir)).otherwise(between).alias("v"))
