"""Quantities of interest: regions, moments, corrections, contours and small meshes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Regions: 0 is of interest, 125 a buffer, 255 the background.
INTEREST, BUFFER, BACKGROUND = 0, 125, 255


def block_activity(nodes: DataFrame, key: list[str], block: Column, level: str, coef: str) -> DataFrame:
    """Mean absolute coefficient of the levels above 0 in each block."""
    return nodes.groupBy(*key, block.alias("block")).agg((F.sum(F.when(F.col(level) > 0, F.abs(coef)).otherwise(0.0)) / F.count("*")).alias("activity"))


def top_fraction(blocks: DataFrame, key: list[str], fraction: float) -> DataFrame:
    """The most active part of each key's blocks, ties to the smaller block."""
    total = blocks.groupBy(*key).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("activity"), "block"))
    return blocks.withColumn("_rank", rank).join(total, key).filter(F.col("_rank") <= F.ceil(F.lit(fraction) * F.col("_n"))).drop("_rank", "_n")


def zones(nodes: DataFrame, kept: DataFrame, key: list[str], width: int, radius: int) -> DataFrame:
    """Adds zone to nodes (i): in a kept block, within ``radius`` of one, or background. An equi-join on blocks in reach, no range join."""
    reach = -(-radius // width)
    near = kept.select(*key, "block", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("_at"))
    near = near.select(*key, F.col("block").alias("_kept"), "_at")
    lo, hi = F.col("_kept") * width, F.col("_kept") * width + width - 1
    distance = F.greatest(lo - F.col("i"), F.col("i") - hi, F.lit(0))
    found = nodes.withColumn("_at", F.floor(F.col("i") / width)).join(near, [*key, "_at"], "left")
    zone = F.min(F.when(F.col("_kept").isNull(), BACKGROUND).when(distance == 0, INTEREST).when(distance <= radius, BUFFER).otherwise(BACKGROUND))
    own = [c for c in nodes.columns]
    return found.groupBy(*own).agg(F.coalesce(zone, F.lit(BACKGROUND)).cast("int").alias("zone"))


def level_zones(nodes: DataFrame, kept: DataFrame, key: str, width: int, radius: int) -> DataFrame:
    """Adds zone to nodes (i, lvl): a node that a level brings reaches as many of its level's steps around kept blocks as ``radius`` says. A series' kept blocks go to its nodes as one array."""
    blocks = kept.groupBy(key).agg(F.collect_list("block").alias("_kept"))
    top = nodes.groupBy(key).agg(F.max("lvl").alias("_top"))
    gap = F.array_min(F.transform("_kept", lambda b: F.greatest(b * width - F.col("i"), F.col("i") - b * width - (width - 1), F.lit(0))))
    rows = nodes.join(blocks, key, "left").join(top, key).withColumn("_gap", gap)
    zone = F.when(F.col("_gap") == 0, INTEREST).when(F.col("_gap") <= radius * F.pow(F.lit(2.0), F.col("_top") - F.col("lvl")), BUFFER).otherwise(BACKGROUND)
    return rows.withColumn("zone", zone).drop("_kept", "_top", "_gap")


def roi_quantized(coef: Column, quantum: Column, zone: Column, scale: int) -> Column:
    """Coarser in the background, yet in multiples of the fine quantum: a decoder needs no map."""
    fine, coarse = (F.signum(coef) * F.floor(F.abs(coef / q) + 0.5) for q in (quantum, quantum * scale))
    return F.when(zone == BACKGROUND, scale * coarse).otherwise(fine).cast("long")


def moments(df: DataFrame, key: list[str], f: Column, volume: Column, velocity: Column) -> DataFrame:
    """density, mean velocity and temperature per key; the second moment about the mean without a second pass over rows."""
    w = f * volume
    out = df.groupBy(*key).agg(F.sum(w).alias("density"), F.sum(w * velocity).alias("m1"), F.sum(w * velocity * velocity).alias("m2"))
    mean = F.col("m1") / F.col("density")
    return out.select(*key, "density", mean.alias("mean_velocity"), (F.col("m2") / F.col("density") - mean * mean).alias("temperature"))


def nested_regions(nodes: DataFrame, key: list[str], width: int, fractions: list[float], ratio: int) -> DataFrame:
    """key, block: blocks of ``width`` nodes, the most active fraction kept, cut into ``ratio`` parts, and so on for every fraction."""
    kept = None
    for k, fraction in enumerate(fractions):
        rows = nodes
        if k:
            rows = rows.withColumn("_outer", F.floor(F.col("i") / width)).join(kept.withColumnRenamed("block", "_outer"), [*key, "_outer"]).drop("_outer")
            width = -(-width // ratio)
        activity = block_activity(rows, key, F.floor(F.col("i") / width), "lvl", "coef")
        kept = top_fraction(activity.withColumn("activity", F.round("activity", 9)), key, fraction).select(*key, "block")
    return kept


def plasma_moments(df: DataFrame, key: list[str], f: Column, volume: Column, mu: Column, vp: Column, vth: Column, mass: float, charge: float) -> DataFrame:
    """density, flow along the field, temperatures across and along it, and their mean. Sums about zero give those about the flow: one pass, one shuffle."""
    w = f * volume
    sums = {"density": w, "s1": w * vp * vth, "s2": w * vp * vp * vth * vth, "sm": w * mu * vth * vth / 2}
    out = df.groupBy(*key).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).filter("density != 0")
    n, flow = F.col("density"), F.col("s1") / F.col("density")
    across, along = mass * F.col("sm") / n / charge, mass * (F.col("s2") / n - flow * flow) / charge
    return out.select(*key, "density", flow.alias("flow"), across.alias("t_across"), along.alias("t_along"), ((2 * across + along) / 3).alias("t_mean"))


def third_moments(df: DataFrame, key: list[str], f: Column, volume: Column, factor: Column, along: Column, across: Column) -> DataFrame:
    """Sums of v^3 f and of v w^2 f with their volumes, v along the field and w across it."""
    w = f * volume * factor
    return df.groupBy(*key).agg(F.sum(w * along * along * along).alias("v3"), F.sum(w * along * across * across).alias("vw2"))


def edge_factor(place: Column, last: int | Column, first: int | Column = 0) -> Column:
    """Weights of a trapezoid rule: a half at both ends."""
    return F.when((place == first) | (place == last), 0.5).otherwise(1.0)


def drift(df: DataFrame, mass: float, charge: float) -> DataFrame:
    """Drift in both directions of the plane from the field's strength and gradient, its curl, and the electric field, by columns b, gr, gz, cr, cz, er, ez, mu, vp."""
    size = F.col("b")
    along = mass * F.col("vp") * F.col("vp") / (charge * size)
    push_r, push_z = (F.col("mu") * F.col(g) - charge * F.col(e) for g, e in (("gr", "er"), ("gz", "ez")))
    return df.withColumn("dr", along * F.col("cr") - push_z / (charge * size)).withColumn("dz", along * F.col("cz") + push_r / (charge * size))


def core_region(r: Column, z: Column, psi: Column, x1: tuple[float, float, float, float], x2: tuple[float, float, float, float], slack: float) -> Column:
    """Whether a point is on the closed or outer side: lines of given slopes through two X points (r, z, psi, slope) divide the plane, by flux."""
    side = lambda x: (z - x[1]) - (r - x[0]) * x[3]
    below1, below2 = psi <= x1[2] - slack, psi <= x2[2] - slack
    return (below1 & (side(x1) > 0) & (side(x2) < 0)) | (~below1 & below2 & (side(x2) < 0)) | ~below2


def sparse_times(matrix: DataFrame, vector: DataFrame, row: str, col: str, weight: str, value: str) -> DataFrame:
    """Sparse matrix times vector, both as tables."""
    return matrix.join(vector, col).groupBy(row).agg(F.sum(F.col(weight) * F.col(value)).alias(value))


def newton_multipliers(f: np.ndarray, basis: np.ndarray, targets: np.ndarray, most: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """Multipliers so that f exp(-lambda basis) has the target moments; zeros where it doesn't converge."""
    lam = np.zeros(len(basis))
    for _ in range(most):
        g = f * np.exp(-lam @ basis)
        miss = basis @ g - targets
        if np.abs(miss).max() <= tolerance * max(1.0, np.abs(targets).max()):
            return lam
        hessian = (basis * g) @ basis.T
        try:
            lam = lam + np.linalg.solve(hessian, miss)
        except np.linalg.LinAlgError:
            break
        if not np.isfinite(lam).all():
            break
    return np.zeros(len(basis))


def corrected(groups: DataFrame, key: str, degree: int = 3) -> DataFrame:
    """Per key: decoded values (approx) corrected to keep the moments of the originals (exact) up to a degree."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = np.linspace(-1, 1, len(pdf))
        basis = np.stack([x**d for d in range(degree + 1)])
        exact, approx = pdf["exact"].to_numpy(), pdf["approx"].to_numpy()
        lam = newton_multipliers(approx, basis, basis @ exact)
        after = approx * np.exp(-lam @ basis)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "before": [float(np.abs(basis @ (approx - exact)).max())], "after": [float(np.abs(basis @ (after - exact)).max())], "lam": [lam.tolist()]})

    return groups.select(key, "i", "exact", "approx").groupBy(key).applyInPandas(one, f"{key} long, before double, after double, lam array<double>")


def nearest(values: DataFrame, value: str, centres: list[float]) -> DataFrame:
    """Adds centre: the nearest of a few, ties to the smaller."""
    ordered = sorted(centres)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(value) - c).alias("d"), F.lit(float(c)).alias("c")) for c in ordered]))
    return values.withColumn("centre", best["c"])


def lloyd(values: DataFrame, value: str, k: int, most: int = 1000, threshold: float = 1e-4) -> list[float]:
    """One-dimensional k-means; each round is one aggregate with k rows."""
    low, high = values.agg(F.min(value), F.max(value)).first()
    if low is None:
        return []
    centres = list(np.linspace(low, high, k))
    for _ in range(most):
        means = {r["centre"]: r["m"] for r in nearest(values, value, centres).groupBy("centre").agg(F.avg(value).alias("m")).collect()}
        moved = [means.get(float(c), c) for c in sorted(centres)]
        if max(abs(a - b) for a, b in zip(moved, sorted(centres), strict=True)) < threshold:
            return moved
        centres = moved
    return centres


def square_cases(grid: DataFrame, iso: float, row: str = "r", col: str = "c", value: str = "v") -> DataFrame:
    """Case number (4 bits) of every cell of a 2-D grid: which corners reach the level. Corners are joined by key, row by row."""
    above = (F.col(value) >= iso).cast("int")
    w = Window.partitionBy(row).orderBy(col)
    edges = grid.select(row, col, (above + 2 * F.lead(above).over(w)).alias("e"), value)
    below = edges.select((F.col(row) - 1).alias(row), col, F.col("e").alias("e2"))
    return edges.filter("e is not null").join(below.filter("e2 is not null"), [row, col]).select(row, col, (F.col("e") + 4 * F.col("e2")).cast("int").alias("case_id"))


def edges_of(elements: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Distinct edges (a < b) of elements."""
    n = F.size(nodes)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(F.least(F.get(nodes, i), F.get(nodes, j)).alias("a"), F.greatest(F.get(nodes, i), F.get(nodes, j)).alias("b")))))
    return elements.select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct()


def triangle_area(p: Column, q: Column, r: Column) -> Column:
    return F.abs((q["x"] - p["x"]) * (r["y"] - p["y"]) - (r["x"] - p["x"]) * (q["y"] - p["y"])) / 2


def mesh_mass(elements: DataFrame, values: DataFrame, dims: int = 2) -> DataFrame:
    """Mass matrix of simplices times nodal values: element, measure, nodes; node, v -> node, mv."""
    flat = elements.select("element", "measure", F.explode("nodes").alias("node")).join(values, "node")
    sums = flat.groupBy("element").agg(F.sum("v").alias("total"))
    return flat.join(sums, "element").groupBy("node").agg(F.sum(F.col("measure") / ((dims + 1) * (dims + 2)) * (F.col("total") + F.col("v"))).alias("mv"))


def conjugate_gradient(apply, b: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-10, most: int = 1000) -> np.ndarray:
    """Preconditioned conjugate gradients for meshes small enough for one task."""
    x = np.zeros_like(b)
    r = b.copy()
    z = r / diagonal
    p, rz = z.copy(), float(r @ z)
    stop = tolerance * max(1e-300, float(np.linalg.norm(b)))
    for k in range(1, most + 1):
        if np.linalg.norm(r) <= stop:
            break
        q = apply(p)
        a = rz / float(p @ q)
        x = x + a * p
        # the recurrence drifts: now and then the residual itself
        r = b - apply(x) if k % 32 == 0 else r - a * q
        z = r / diagonal
        rz, old = float(r @ z), rz
        p = z + rz / old * p
    return x


def refined_triangles(elements: DataFrame) -> DataFrame:
    """Each triangle's four children, midpoints named by their edge ('a-b')."""
    n = [F.get("nodes", F.lit(i)).cast("string") for i in range(3)]
    mid = lambda i, j: F.concat_ws("-", F.least(n[i], n[j]), F.greatest(n[i], n[j]))
    children = F.array(F.array(n[0], mid(0, 1), mid(0, 2)), F.array(n[1], mid(0, 1), mid(1, 2)), F.array(n[2], mid(0, 2), mid(1, 2)), F.array(mid(0, 1), mid(0, 2), mid(1, 2)))
    return elements.select("element", F.posexplode(children).alias("child", "nodes"))


def edge_length(p: Column, q: Column) -> Column:
    return F.sqrt(sum((F.pow(q[c] - p[c], F.lit(2.0)) for c in ("x", "y", "z")), F.lit(0.0)))


def tetrahedron_volume(p: Column, q: Column, r: Column, s: Column, signed: bool = False) -> Column:
    """A sixth of the determinant of three edges; its sign is the orientation."""
    a, b, c = ([v[k] - p[k] for k in ("x", "y", "z")] for v in (q, r, s))
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return det / 6 if signed else F.abs(det) / 6


def midpoint_details(edges: DataFrame, values: DataFrame, middles: DataFrame) -> DataFrame:
    """a, b, detail: the value at each edge's middle less the mean of its ends (the hierarchical coefficient of a new node)."""
    ends = edges.join(values.toDF("a", "va"), "a").join(values.toDF("b", "vb"), "b").join(middles, ["a", "b"])
    return ends.select("a", "b", (F.col("vm") - (F.col("va") + F.col("vb")) / 2).alias("detail"))


def mesh_restriction(values: DataFrame, middles: DataFrame) -> DataFrame:
    """Old nodes keep their entries, and each gets a half of every middle beside it."""
    halves = middles.select(F.explode(F.array("a", "b")).alias("node"), (F.col("vm") / 2).alias("v"))
    return values.select("node", "v").unionByName(halves).groupBy("node").agg(F.sum("v").alias("v")).join(values.select("node"), "node")
