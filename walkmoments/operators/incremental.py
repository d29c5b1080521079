"""A graph's statistics kept up to date under edits: what orders 2 and 3 need of every edge, in one table.

A row of an edge (u, v) holds d, W and H of both ends and M of the pair (see stats). An edit of (a, b) changes d
of a and b only, W and H of these and their neighbours only, and M only of pairs that lie wholly among these
nodes. So a batch of edits reads the edges at those nodes, renews them by joins among themselves, and puts the
renewed rows over the old table; nothing else is computed anew. The table is a base with a layer of renewed rows
and of the keys that they replace; a layer of more than SHARE of the base is merged into a new base.

Tables are written and never changed, so a copy of the object is a snapshot of its state. Changes of moments of
all single deletions, and the moments, are expressions and sums over the table, without a join of statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from . import stats
from .graph import Graph, require_members
from .lineage import written

#: A layer above this part of the base is merged; tables of at most so many rows are broadcast.
SHARE, SMALL = 0.25, 100_000
COLUMNS = ("u", "v", "du", "dv", "wu", "wv", "hu", "hv", "m")


def _hinted(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= SMALL else rows


@dataclass(frozen=True)
class MaintainedGraph:
    """Edges 0..n-1 with their statistics; :meth:`of` makes the first one, :meth:`apply` the next."""

    n: int
    base: DataFrame
    size: int
    gone: DataFrame | None = None  # u, v: keys of the base that the layer replaces
    fresh: DataFrame | None = None  # renewed rows
    layer: int = 0

    @classmethod
    def of(cls, graph: Graph) -> MaintainedGraph:
        tri = stats.triangles(graph)
        nodes = stats.node_stats(graph, tri)
        rows = graph.edges.join(stats.edge_mass(tri), ["u", "v"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
        for e in "uv":
            rows = rows.join(nodes.select(F.col("id").alias(e), F.col("d").cast("double").alias(f"d{e}"), F.col("W").alias(f"w{e}"), F.col("H").alias(f"h{e}")), e)
        base = written(rows.select(*COLUMNS), "maintained-base")
        return cls(graph.n, base, base.count())

    def rows(self) -> DataFrame:
        """Every edge with its statistics."""
        if self.fresh is None:
            return self.base
        return self.base.join(_hinted(self.gone, self.layer), ["u", "v"], "left_anti").unionByName(self.fresh)

    def graph(self) -> Graph:
        return Graph(self.rows().select("u", "v"), self.n)

    def moments(self) -> dict[int, float]:
        inverse = 1.0 / (F.col("du") * F.col("dv"))
        row = self.rows().agg(F.coalesce(F.sum(inverse), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.col("m") * inverse), F.lit(0.0)).alias("b")).first()
        return {2: 2 * row["a"] / self.n, 3: 2 * row["b"] / self.n}

    def deletion_deltas(self) -> DataFrame:
        """u, v, delta_m2, delta_m3 of every edge."""
        c = F.col
        two = fn.delete_m2(c("du"), c("dv"), c("wu"), c("wv"), float(self.n))
        three = fn.delete_m3(c("du"), c("dv"), c("hu"), c("hv"), c("m"), float(self.n))
        return self.rows().select("u", "v", two.alias("delta_m2"), three.alias("delta_m3"))

    def near(self, nodes: DataFrame, count: int) -> DataFrame:
        """The edges with an end in ``nodes`` (id), and which: at_u, at_v."""
        rows = self.rows()
        for e in "uv":
            rows = rows.join(_hinted(nodes.select(F.col("id").alias(e), F.lit(True).alias(f"at_{e}")), count), e, "left")
        return rows.withColumn("at_u", F.coalesce("at_u", F.lit(False))).withColumn("at_v", F.coalesce("at_v", F.lit(False))).filter("at_u or at_v")

    def apply(self, additions: DataFrame | None = None, deletions: DataFrame | None = None, checked: bool = False) -> MaintainedGraph:
        """The state after a batch; raises where it adds an edge, deletes a non-edge or repeats, unless ``checked`` before."""
        spark = self.base.sparkSession
        none = spark.createDataFrame([], "u long, v long")
        edges = self.rows().select("u", "v")
        come = none if additions is None else additions.select("u", "v") if checked else require_members(additions, edges, False)
        drop = none if deletions is None else deletions.select("u", "v") if checked else require_members(deletions, edges, True)
        edits = written(come.withColumn("add", F.lit(True)).unionByName(drop.withColumn("add", F.lit(False))), "maintained-edits")
        ends = edits.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        touched = self.near(ends, 2 * edits.count()).select(F.explode(F.array("u", "v")).alias("id"))
        nodes = written(touched.unionByName(ends).distinct(), "maintained-nodes")
        count = nodes.count()
        old = written(self.near(nodes, count), "maintained-old")
        added = edits.filter("add").select("u", "v", *[F.lit(None).cast("double").alias(c) for c in COLUMNS[2:]], F.lit(True).alias("at_u"), F.lit(True).alias("at_v"))
        left = old.join(edits.filter("not add").select("u", "v"), ["u", "v"], "left_anti").unionByName(added)

        def arc(x: str, y: str) -> Column:
            return F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(f"d{y}").alias("dy"), F.col(f"at_{x}").alias("own"), (F.col("at_u") & F.col("at_v")).alias("inside"), F.col("m").alias("m"))

        arcs = left.select(F.explode(F.array(arc("u", "v"), arc("v", "u"))).alias("a")).select("a.*").filter("own")
        deg = arcs.groupBy(F.col("x").alias("y")).agg(F.count("*").cast("double").alias("d"))
        arcs = written(arcs.join(deg, "y", "left").select("x", "y", F.coalesce("d", "dy").alias("dy"), "inside", "m"), "maintained-arcs")
        sizes = arcs.groupBy("x").agg(F.count("*").cast("double").alias("d"), F.sum(1.0 / F.col("dy")).alias("W"))
        # pairs among the touched nodes: the neighbours of the end of lower degree, looked up at the other
        pairs = arcs.filter("inside and x < y").join(sizes.select("x", F.col("d").alias("dx")), "x").select(F.col("x").alias("u"), F.col("y").alias("v"), (F.col("dx") <= F.col("dy")).alias("first"))
        pairs = pairs.select("u", "v", F.when(F.col("first"), F.col("u")).otherwise(F.col("v")).alias("x"), F.when(F.col("first"), F.col("v")).otherwise(F.col("u")).alias("z"))
        opened = pairs.join(arcs.select("x", F.col("y").alias("w"), "dy"), "x").join(arcs.select(F.col("x").alias("z"), F.col("y").alias("w")), ["z", "w"])
        mass = written(opened.groupBy("u", "v").agg(F.sum(1.0 / F.col("dy")).alias("new_m")), "maintained-mass")
        keyed = arcs.select("x", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "dy", "inside", "m").join(mass, ["u", "v"], "left")
        m = F.when(F.col("inside"), F.coalesce("new_m", F.lit(0.0))).otherwise(F.col("m"))
        heights = keyed.groupBy("x").agg((F.sum(m / F.col("dy")) / 2).alias("H"))
        now = written(sizes.join(heights, "x"), "maintained-stats")
        renewed = left.join(mass, ["u", "v"], "left")
        for e in "uv":
            renewed = renewed.join(now.select(F.col("x").alias(e), F.col("d").alias(f"new_d{e}"), F.col("W").alias(f"new_w{e}"), F.col("H").alias(f"new_h{e}")), e, "left")
        values = [F.coalesce(f"new_{c}", c).alias(c) for c in COLUMNS[2:8]]
        values.append(F.when(F.col("at_u") & F.col("at_v"), F.coalesce("new_m", F.lit(0.0))).otherwise(F.col("m")).alias("m"))
        renewed = renewed.select("u", "v", *values)
        keys = old.select("u", "v").unionByName(edits.filter("add").select("u", "v"))
        gone = keys if self.gone is None else keys.unionByName(self.gone).distinct()
        fresh = renewed if self.fresh is None else self.fresh.join(keys, ["u", "v"], "left_anti").unionByName(renewed)
        gone, fresh = written(gone, "maintained-gone"), written(fresh, "maintained-fresh")
        after = replace(self, gone=gone, fresh=fresh, layer=gone.count())
        if after.layer > SHARE * self.size:
            base = written(after.rows(), "maintained-base")
            after = MaintainedGraph(self.n, base, base.count())
        return after
