"""Node and pair statistics from which moments and their changes follow.

d degree; W sum of 1/d over neighbours; triangles, each once, by degree-ordered orientation, which
bounds the wedges a hub can open; H sum of 1/(d d) over a node's triangles; M sum of 1/d over the
common neighbours of a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .graph import Graph, arcs, run_pairs
from .lineage import written


def degrees(graph: Graph) -> DataFrame:
    """id, d of the nodes that have neighbours."""
    return graph.arcs().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))


def all_degrees(graph: Graph) -> DataFrame:
    """id, d of every node, 0 for isolated ones."""
    return graph.nodes().join(degrees(graph), "id", "left").select("id", F.coalesce("d", F.lit(0).cast("long")).alias("d"))


def neighbour_mass(graph: Graph, deg: DataFrame | None = None) -> DataFrame:
    """id, d, W of the nodes that have neighbours."""
    deg = degrees(graph) if deg is None else deg
    weighted = graph.arcs().join(deg.select(F.col("id").alias("dst"), F.col("d").alias("__d")), "dst")
    return weighted.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"), F.sum(1.0 / F.col("__d")).alias("W"))


def triangles(graph: Graph, deg: DataFrame | None = None) -> DataFrame:
    """a, b, c, da, db, dc of every triangle, once; a is first by (degree, id), then b, c.

    A node and its degree go as one number, degree * 2^32 + id, in whose order every edge is directed. Each node's list
    of later neighbours goes to each of these, cut behind it, and meets the neighbour's own list there: what is shuffled
    is a number for each wedge.
    """
    deg = degrees(graph) if deg is None else deg
    code = F.shiftleft(F.col("d"), 32) + F.col("id")
    one = deg.select(F.col("id").alias("u"), code.alias("x"))
    two = deg.select(F.col("id").alias("v"), code.alias("y"))
    directed = graph.edges.join(one, "u").join(two, "v").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    near = directed.groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("near"))
    # only to those that open an edge of their own: none does between two sides
    ways = directed.join(directed.select(F.col("x").alias("y")).distinct(), "y", "left_semi").groupBy("x").agg(F.collect_list("y").alias("ways"))
    sent = ways.join(near.filter(F.size("near") > 1), "x").select("x", "near", F.explode("ways").alias("y"))
    behind = F.array_position("near", F.col("y")).cast("int") + 1
    sent = sent.select("x", "y", F.slice("near", behind, F.size("near")).alias("rest")).filter(F.size("rest") > 0)
    met = sent.join(near.withColumnRenamed("x", "y"), "y")
    found = met.select("x", "y", F.explode(F.array_intersect("rest", "near")).alias("z"))
    names = (("x", "a"), ("y", "b"), ("z", "c"))
    ids = [F.col(k).bitwiseAND(F.lit((1 << 32) - 1)).alias(e) for k, e in names]
    return found.select(*ids, *[F.shiftright(k, 32).alias(f"d{e}") for k, e in names])


def corners(tri: DataFrame) -> DataFrame:
    """id, x, y, dx, dy: each triangle seen from its three corners."""
    turns = [("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b")]
    seen = F.explode(F.array(*[F.struct(F.col(i).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(f"d{i}").alias("d"), F.col(f"d{x}").alias("dx"), F.col(f"d{y}").alias("dy")) for i, x, y in turns]))
    return tri.select(seen.alias("t")).select("t.*")


def triangle_mass(tri: DataFrame) -> DataFrame:
    """id, H of the nodes in triangles."""
    return corners(tri).groupBy("id").agg(F.sum(1.0 / (F.col("dx") * F.col("dy"))).alias("H"))


def edge_mass(tri: DataFrame) -> DataFrame:
    """u, v, m of the edges in triangles: the sum of 1/d over the third corners."""
    rows = corners(tri).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), (1.0 / F.col("d")).alias("w"))
    return rows.groupBy("u", "v").agg(F.sum("w").alias("m"))


def pair_mass(graph: Graph, pairs: DataFrame, deg: DataFrame | None = None, few: bool = False) -> DataFrame:
    """u, v, m of any pairs (u, v) with common neighbours.

    Only the neighbours of each pair's end of lower degree are opened, and looked up at the other end:
    no wedge is made that no pair asks for, and a hub opens none of its own. ``few`` pairs are sent to the arcs, so
    that only arcs at their ends are shuffled.
    """
    deg = degrees(graph) if deg is None else deg
    ends = pairs.select("u", "v").distinct()
    for e in "uv":
        ends = (F.broadcast(ends) if few else ends).join(deg.select(F.col("id").alias(e), F.col("d").alias(f"d{e}")), e)
    low = F.col("du") <= F.col("dv")
    ends = ends.select("u", "v", F.when(low, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("y"))
    opened, closing = graph.arcs(), graph.arcs().select(F.col("src").alias("y"), F.col("dst").alias("w"))
    if few:
        opened = opened.join(F.broadcast(ends.select(F.col("x").alias("src")).distinct()), "src", "left_semi")
        closing = closing.join(F.broadcast(ends.select("y").distinct()), "y", "left_semi")
    near = opened.join(deg.select(F.col("id").alias("dst"), "d"), "dst").select(F.col("src").alias("x"), F.col("dst").alias("w"), "d")
    return ends.join(near, "x").join(closing, ["y", "w"]).groupBy("u", "v").agg(F.sum(1.0 / F.col("d")).alias("m"))


def apart_mass(graph: Graph) -> DataFrame:
    """u, v, m of every pair that is no edge and has common neighbours.

    A node's two steps are walked in place (blocks.non_edge_masses), so no wedge is shuffled; graphs of more than
    blocks.ARCS arcs sum their wedges by joins.
    """
    edges = written(graph.edges.select("u", "v"), "mass-edges")
    if graph.n < 1 << 31 and 2 * edges.count() <= blocks.ARCS:
        return blocks.non_edge_masses(written(blocks.near_lists(arcs(edges)), "mass-lists"), graph.n)
    arc, deg = arcs(edges), degrees(Graph(edges, graph.n))
    middle = arc.join(deg.select(F.col("id").alias("src"), (1.0 / F.col("d")).alias("w")), "src")
    wedges = middle.select("src", F.col("dst").alias("u"), "w").join(arc.select("src", F.col("dst").alias("v")), "src").filter("u < v")
    return wedges.groupBy("u", "v").agg(F.sum("w").alias("m")).join(edges, ["u", "v"], "left_anti")


def non_edge_mass(graph: Graph, deg: DataFrame | None = None) -> DataFrame:
    """u, v, m of every pair that is no edge, m = 0 without common neighbours.

    Pairs with common neighbours come from wedges; all others are gaps beside these and the edges, and made in place.
    """
    deg = degrees(graph) if deg is None else deg
    arc = graph.arcs()
    middle = arc.join(deg.select(F.col("id").alias("src"), (1.0 / F.col("d")).alias("w")), "src")
    wedges = middle.select("src", F.col("dst").alias("u"), "w").join(arc.select("src", F.col("dst").alias("v")), "src").filter("u < v")
    held = graph.edges.select("u", "v", F.lit(None).cast("double").alias("w"), F.lit(True).alias("edge"))
    last = graph.nodes().select(F.col("id").alias("u"), F.lit(graph.n).cast("long").alias("v"), F.lit(None).cast("double").alias("w"), F.lit(True).alias("edge"))
    marks = wedges.select("u", "v", "w", F.lit(False).alias("edge")).unionByName(held).unionByName(last)
    marks = marks.groupBy("u", "v").agg(F.sum("w").alias("m"), F.max("edge").alias("edge"))
    before = F.lag("v").over(Window.partitionBy("u").orderBy("v"))
    marks = marks.withColumn("low", F.coalesce(before, "u") + 1)
    none = F.struct("low", (F.col("v") - 1).alias("high"), F.lit(0.0).alias("m"))
    own = F.struct(F.col("v").alias("low"), F.when(F.col("edge"), F.col("v") - 1).otherwise(F.col("v")).alias("high"), "m")
    runs = marks.select("u", F.explode(F.array(none, own)).alias("r")).select("u", "r.*").filter("low <= high")
    return run_pairs(runs, graph.n, "m")


def node_stats(graph: Graph, tri: DataFrame | None = None, deg: DataFrame | None = None) -> DataFrame:
    """id, d, W, H of every node of the graph."""
    deg = degrees(graph) if deg is None else deg
    tri = triangles(graph, deg) if tri is None else tri
    zero = F.lit(0.0)
    rows = graph.nodes().join(neighbour_mass(graph, deg), "id", "left").join(triangle_mass(tri), "id", "left")
    return rows.select("id", F.coalesce("d", F.lit(0).cast("long")).alias("d"), F.coalesce("W", zero).alias("W"), F.coalesce("H", zero).alias("H"))


__all__ = ["all_degrees", "arcs", "corners", "degrees", "edge_mass", "neighbour_mass", "node_stats", "non_edge_mass", "pair_mass", "triangle_mass", "triangles"]
