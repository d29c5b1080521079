"""Moment-change fingerprints: the directions of all single-edge changes as a circular density."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deltas import delete_deltas, prepare
from .graph import Graph

STEP, BANDWIDTH = 0.5, 3.0


def scales(deltas: DataFrame, mode: str, moments: dict[int, float]) -> dict[int, float]:
    if mode == "graph_relative":
        found = {k: abs(moments[k]) for k in (2, 3)}
    elif mode == "std":
        row = deltas.agg(F.stddev_pop("delta_m2").alias("a"), F.stddev_pop("delta_m3").alias("b")).first()
        found = {2: row["a"] or 0.0, 3: row["b"] or 0.0}
    else:
        raise ValueError("the scale is graph_relative or std")
    return {k: s if s > 1e-15 else 1.0 for k, s in found.items()}


def profile(graph: Graph, mode: str = "graph_relative") -> DataFrame:
    """u, v, delta_m2, delta_m3, scaled_m2, scaled_m3, length, angle_deg (null where the length vanishes)."""
    state = prepare(graph)
    deltas = delete_deltas(graph, state=state)
    by = scales(deltas, mode, state.moments)
    rows = deltas.withColumn("scaled_m2", F.col("delta_m2") / by[2]).withColumn("scaled_m3", F.col("delta_m3") / by[3])
    rows = rows.withColumn("length", F.hypot("scaled_m2", "scaled_m3"))
    angle = F.degrees(F.atan2("scaled_m3", "scaled_m2")) + 360.0
    return rows.withColumn("angle_deg", F.when(F.col("length") > 1e-15, F.pmod(angle, F.lit(360.0))))


def density(profiles: DataFrame, step: float = STEP, bandwidth: float = BANDWIDTH, by: tuple[str, ...] = ()) -> DataFrame:
    """bin, deg, prob: a wrapped Gaussian kernel sum over the angles on a fixed grid, normalised per group.

    Each angle reaches the grid by an explode of the grid's 360 / step points, summed map-side, so
    the shuffle holds one row a point and task. Without angles all densities are 0.
    """
    count = int(math.ceil(360.0 / step))
    spark = profiles.sparkSession
    points = profiles.select(*by, "angle_deg", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bin"))
    gap = F.col("bin") * step - F.col("angle_deg")
    wrapped = F.abs(gap - 360.0 * F.floor((gap + 180.0) / 360.0))
    weight = F.coalesce(F.exp(-0.5 * (wrapped / bandwidth) * (wrapped / bandwidth)), F.lit(0.0))
    sums = points.groupBy(*by, "bin").agg(F.sum(weight).alias("s"))
    if by:
        total = sums.groupBy(*by).agg(F.greatest(F.sum("s"), F.lit(1e-15)).alias("t"))
        rows = sums.join(total, list(by))
    else:
        grid = spark.range(count).select(F.col("id").cast("int").alias("bin"))
        sums = grid.join(sums, "bin", "left").select("bin", F.coalesce("s", F.lit(0.0)).alias("s"))
        rows = sums.join(F.broadcast(sums.agg(F.greatest(F.sum("s"), F.lit(1e-15)).alias("t"))))
    return rows.select(*by, "bin", (F.col("bin") * step).alias("deg"), (F.col("s") / F.col("t")).alias("prob"))


def area_radius(grid: DataFrame, step: float = STEP) -> DataFrame:
    """Adds radius = sqrt(2 prob / width), so that drawn areas are probabilities."""
    return grid.withColumn("radius", F.sqrt(2.0 * F.col("prob") / math.radians(step)))


def band(grids: DataFrame) -> DataFrame:
    """bin, mean, low, high: mean and exact interpolated quartiles over many graphs."""
    return grids.groupBy("bin").agg(F.avg("prob").alias("mean"), F.percentile("prob", F.lit(0.25)).alias("low"), F.percentile("prob", F.lit(0.75)).alias("high"))


def save_svg(graph: Graph, path: str, mode: str = "graph_relative", step: float = STEP, bandwidth: float = BANDWIDTH, size: int = 480) -> str:
    """Draws the fingerprint as a polar area chart; overwrites, and makes parent folders."""
    if not path.endswith(".svg"):
        raise ValueError("fingerprints are written as .svg")
    if step <= 0 or bandwidth <= 0 or size <= 0:
        raise ValueError("step, bandwidth and size must be positive")
    rows = area_radius(density(profile(graph, mode), step, bandwidth), step).orderBy("bin").collect()  # 360 / step points
    top = max((r["radius"] for r in rows), default=0.0) or 1.0
    half = size / 2
    spots = [(half + 0.9 * half * r["radius"] / top * math.cos(math.radians(r["deg"])), half - 0.9 * half * r["radius"] / top * math.sin(math.radians(r["deg"]))) for r in rows]
    shape = " ".join(f"{x:.2f},{y:.2f}" for x, y in spots)
    svg = (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}"><circle cx="{half}" cy="{half}" r="{0.9 * half}" fill="none" stroke="#bbb"/>'
        f'<path d="M0 {half}H{size}M{half} 0V{size}" stroke="#ddd"/><polygon points="{shape}" fill="#4477aa" fill-opacity="0.5" stroke="#4477aa"/></svg>'
    )
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(svg)
    return path
