"""Moments m_k = Tr(P^k) / n of the random walk, and properties built on the same statistics.

The symmetric matrix S = D^-1/2 A D^-1/2 has the same traces. Orders 2 and 3 are sums over edges and
triangles; any order k is the sum of products of the entries of S^ceil(k/2) and S^floor(k/2), so
order 4 needs the wedge table only; up to order 8 the sums are taken block by block (walks.walk_sums).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import drawn
from . import stats
from .graph import Graph
from .lineage import cut

Matrix = DataFrame  # i, j, w


def orders_of(orders, least: int = 1) -> tuple[int, ...]:
    found = list(orders)
    if not found or any(isinstance(k, bool) or not isinstance(k, int) or k < least for k in found):
        raise ValueError(f"orders must be integers of at least {least}")
    return tuple(sorted(set(found)))


def symmetric(graph: Graph, deg: DataFrame | None = None) -> Matrix:
    """i, j, w of S, both triangles."""
    deg = stats.degrees(graph) if deg is None else deg
    rows = graph.arcs().join(deg.select(F.col("id").alias("src"), F.col("d").alias("di")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("dj")), "dst")
    return rows.select(F.col("src").alias("i"), F.col("dst").alias("j"), (1.0 / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def product(a: Matrix, b: Matrix) -> Matrix:
    """Matrix product by join on the inner index and a grouped sum, combined map-side."""
    left = a.select("i", F.col("j").alias("k"), F.col("w").alias("wa"))
    right = b.select(F.col("i").alias("k"), "j", F.col("w").alias("wb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def powers(graph: Graph, top: int) -> dict[int, Matrix]:
    """S^1..S^top; S^0 is the identity and left out. Each is written once, as later powers read it again."""
    out = {1: symmetric(graph)}
    for k in range(2, top + 1):
        if k == 2:
            out[1] = cut(out[1])
        out[k] = cut(product(out[k // 2], out[k - k // 2]))
    return out


def trace_of_product(a: Matrix, b: Matrix) -> DataFrame:
    """One row t: the sum of a_ij b_ij."""
    return a.select("i", "j", F.col("w").alias("wa")).join(b.select("i", "j", F.col("w").alias("wb")), ["i", "j"]).agg(F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0.0)).alias("t"))


def moment_rows(graph: Graph, orders=(2, 3)) -> DataFrame:
    """k, m for each order. With several orders the edges are written once, as each order reads them again."""
    n, wanted = float(graph.n), orders_of(orders)
    if len([k for k in wanted if k > 1]) > 1 or wanted[-1] > 3:
        graph = Graph(cut(graph.edges), graph.n)
    deg = stats.degrees(graph)
    high = max((k for k in wanted if k > 3), default=0)
    from .walks import walk_sums

    sums = walk_sums(graph, high, across=False) if high else None
    if sums is not None:
        total = cut(sums.agg(*[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"w{k}") for k in range(1, high + 1)]))
    walk = powers(graph, -(-high // 2)) if high and sums is None else {}
    out = None
    for k in wanted:
        if k == 1:
            row = graph.spark.range(1).select(F.lit(0.0).alias("t"))
        elif k == 2:
            ends = graph.edges.join(deg.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
            row = ends.agg(F.coalesce(F.sum(2.0 / (F.col("du") * F.col("dv"))), F.lit(0.0)).alias("t"))
        elif k == 3:
            row = stats.triangles(graph, deg).agg(F.coalesce(F.sum(6.0 / (F.col("da") * F.col("db") * F.col("dc"))), F.lit(0.0)).alias("t"))
        elif sums is not None:
            row = total.select(F.col(f"w{k}").alias("t"))
        else:
            row = trace_of_product(walk[k - k // 2], walk[k // 2])
        row = row.select(F.lit(k).alias("k"), (F.col("t") / n).alias("m"))
        out = row if out is None else out.unionByName(row)
    return out


def compute_moments(graph: Graph, orders=(2, 3)) -> dict[int, float]:
    """{order: moment}; runs one job."""
    return {r["k"]: r["m"] for r in moment_rows(graph, orders).collect()}


def average_neighbour_inverse_degree(graph: Graph) -> DataFrame:
    """One row: the mean over all nodes of the mean of 1/d over their neighbours; isolated nodes count 0."""
    rows = stats.neighbour_mass(graph).agg(F.coalesce(F.sum(F.col("W") / F.col("d")), F.lit(0.0)).alias("t"))
    return rows.select((F.col("t") / float(graph.n)).alias("value"))


def weighted_clustering(graph: Graph) -> DataFrame:
    """id, c of every node: the sum over its triangles of 1/sqrt(d d) of the other corners, per pair of neighbours."""
    deg = stats.all_degrees(graph)
    tri = stats.corners(stats.triangles(graph)).groupBy("id").agg(F.sum(1.0 / F.sqrt(F.col("dx") * F.col("dy"))).alias("s"))
    d = F.col("d").cast("double")
    return deg.join(tri, "id", "left").select("id", F.when(d >= 2, F.coalesce("s", F.lit(0.0)) / (d * (d - 1) / 2)).otherwise(F.lit(0.0)).alias("c"))


def absolute_mean_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: |mean(a) - mean(b)| of a column; empty tables count 0."""
    left = a.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("x"))
    right = b.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("y"))
    return left.join(right).select(F.abs(F.col("x") - F.col("y")).alias("value"))


def isolated(graph: Graph) -> DataFrame:
    return graph.nodes().join(graph.arcs().select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def monte_carlo(graph: Graph, walks: int, steps: int, seed: int) -> DataFrame:
    """k, m: the share of seeded walks from uniform starts that are back after k steps, k up to ``steps``.

    Each step picks a neighbour by a hash of (seed, walk, step), joined on (node, place), so walks
    spread over all tasks; a walk without neighbours ends.
    """
    from pyspark.sql import Window

    place = graph.arcs().withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    deg = stats.degrees(graph)
    uniform = F.pmod(drawn(seed, F.col("walk"), F.lit(0)), F.lit(graph.n)).cast("long")
    state = graph.spark.range(walks).withColumnRenamed("id", "walk").select("walk", uniform.alias("start"), uniform.alias("now"))
    out = None
    for k in range(1, steps + 1):
        pick = F.pmod(drawn(seed, F.col("walk"), F.lit(k)), F.col("d")).cast("int")
        chosen = state.join(deg.withColumnRenamed("id", "now"), "now").withColumn("at", pick)
        state = cut(chosen.join(place.withColumnRenamed("src", "now"), ["now", "at"]).select("walk", "start", F.col("dst").alias("now")))
        row = state.agg((F.count_if(F.col("start") == F.col("now")) / float(walks)).alias("m")).select(F.lit(k).alias("k"), "m")
        out = row if out is None else out.unionByName(row)
    return out
