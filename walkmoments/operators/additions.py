"""The best addition of an edge without listing the pairs that are no edges (orders 2 and 3).

With a = 1 / (d + 1), p = W / (d (d + 1)), q = H / (d (d + 1)) of a node (p = q = 0 without neighbours), adding u, v
changes n m2 / 2 by a_u a_v - p_u - p_v and n m3 / 6 by M a_u a_v - q_u - q_v, M the sum of 1 / d over common neighbours.

Pairs without common neighbours (M = 0) depend on their ends' (a, p, q) only. A dual traversal from one cell of all
nodes to ever finer grids over (a, p, q), and last to classes of nodes that agree in all three, keeps the pairs of
cells whose least possible score (by interval arithmetic on the cells' boxes) does not exceed the best score known of
a real addition; pairs of cells never come from all cells, but from their parents' pairs by joins on the parent.
In a class pair all pairs score alike, so the least (u, v) is looked for among the first ids of both classes, more of
them where none of these is free. Pairs with common neighbours come from wedges; as order 2 does not depend on M, a
wedge is only summed where its order 2 alone could win, and only nodes that some other node lets win so open any.

Rows made: nodes for each level, surviving cell pairs, and the wedges between nodes left (at worst as for order 4); n^2
pairs never. Where a node's edges and wedges reach a whole class, as in a complete graph, ids of the class are paired
as often as that. Few pairs are looked up by sending them to the edges, so that a level shuffles no edge.

Defined results: no addition where every pair is an edge or left out, or with fewer than two nodes (no row); ties by
u, v after rounding the root of the score to 12 digits, as everywhere; isolated nodes take part; repeated rows of
``skip`` count once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import functions as fn
from . import stats
from .graph import Graph
from .lineage import cut, discard, written

#: Cells a side of the grids, as powers of two; children of a cell are at most 64.
LEVELS = (2, 4, 6, 8, 10)
#: So few classes are paired without grids between.
DIRECT = 1024
#: Pairs of cells whose first ids are tried for a better known score, each level.
TRIED = 256
#: So many pairs, or nodes, are sent to all tasks.
FEW = 1 << 15
#: So many cells are tested against each other to leave nodes out.
CELLS = 2048
#: First ids of a class that are paired, and by how much more each further round.
FIRST, MORE = 8, 8
#: Roots of scores are compared after rounding to 12 digits; bounds keep a little more.
SLACK = 1e-11
BOX = ("a", "p", "q")


def features(graph: Graph) -> DataFrame:
    """id, d, W, H, a, p, q of every node, written once."""
    deg = written(stats.degrees(graph), "addition-degrees")
    out = written(_features(graph, deg), "addition-features")
    discard(deg)
    return out


def _features(graph: Graph, deg: DataFrame) -> DataFrame:
    c = F.col
    wide = F.col("d") * (F.col("d") + 1.0)
    rows = stats.node_stats(graph, deg=deg)
    return rows.select(
        "id", "d", "W", "H", (1.0 / (c("d") + 1.0)).alias("a"), *[F.when(c("d") > 0, c(s) / wide).otherwise(F.lit(0.0)).alias(t) for s, t in (("W", "p"), ("H", "q"))]
    )


def moments_of(rows: DataFrame, n: int) -> dict[int, float]:
    """Moments 2 and 3 from the features of all nodes."""
    total = [F.coalesce(F.sum(F.when(F.col("d") > 0, F.col(c) / F.col("d"))), F.lit(0.0)) for c in "WH"]
    row = rows.agg(*total).first()
    return {2: row[0] / n, 3: 2 * row[1] / n}


def _cells(nodes: DataFrame, key: str, parent: Column) -> DataFrame:
    """key, parent, size, first and the box of each cell."""
    ends = [f(c).alias(f"{c}_{name}") for c in BOX for f, name in ((F.min, "low"), (F.max, "high"))]
    return nodes.groupBy(F.col(key).alias("key"), parent.alias("parent")).agg(F.count("*").alias("size"), F.min("id").alias("first"), *ends)


def _gap(low: Column, high: Column) -> Column:
    """The distance of 0 from an interval."""
    return F.greatest(low, -high, F.lit(0.0))


class _Search:
    def __init__(self, graph: Graph, now: dict[int, float], target: dict[int, float], scale: dict[int, float], skip: DataFrame | None, direct: int, rows: DataFrame | None):
        self.graph, self.now, self.target, self.scale = graph, now, target, scale
        self.taken = graph.edges.select("u", "v") if skip is None else graph.edges.select("u", "v").unionByName(skip.select("u", "v"))
        self.nodes = self._coded(features(graph) if rows is None else rows)
        self.levels = () if self.nodes.select("class").distinct().limit(direct + 1).count() <= direct else LEVELS
        self.known = math.inf  # root of the best score of an addition that exists

    def _coded(self, rows: DataFrame) -> DataFrame:
        top = rows.agg(*[F.max(c).alias(c) for c in BOX]).first()

        def code(level: int) -> Column:
            side = 1 << level
            at = [F.least(F.floor(F.col(c) * (side / top[c])), F.lit(side - 1)) if top[c] else F.lit(0) for c in BOX]
            return (at[0] * (side * side) + at[1] * side + at[2]).cast("string")

        alike = F.concat_ws(":", code(LEVELS[-1]), F.col("d").cast("string"), *[F.round(c, 12).cast("string") for c in ("W", "H")])
        out = written(rows.withColumns({f"c{level}": code(level) for level in LEVELS} | {"c0": F.lit("0"), "class": alike}), "addition-nodes")
        discard(rows)
        return out

    def root(self, rows: DataFrame) -> DataFrame:
        """Adds root, 12 digits, from delta_m2 (and delta_m3)."""
        moments = {k: F.lit(self.now[k]) + F.col(f"delta_m{k}") for k in self.target}
        return rows.withColumn("root", F.round(F.sqrt(fn.target_distance(moments, self.target, self.scale)), 12))

    def changes(self, pairs: DataFrame, few: bool) -> DataFrame:
        """u, v, delta_m2, delta_m3, root of pairs (u, v, m)."""
        c, n = F.col, float(self.graph.n)
        rows = pairs
        for e in "uv":
            rows = (F.broadcast(rows) if few else rows).join(self.nodes.select(F.col("id").alias(e), F.col("d").cast("double").alias(f"d{e}"), F.col("W").alias(f"w{e}"), F.col("H").alias(f"h{e}")), e)
        two, three = fn.add_m2(c("du"), c("dv"), c("wu"), c("wv"), n), fn.add_m3(c("du"), c("dv"), c("hu"), c("hv"), c("m"), n)
        return self.root(rows.select("u", "v", two.alias("delta_m2"), three.alias("delta_m3")))

    def free(self, pairs: DataFrame, few: bool) -> DataFrame:
        """Those of the pairs that may be added."""
        taken = self.taken.join(F.broadcast(pairs.select("u", "v")), ["u", "v"], "left_semi") if few else self.taken
        return pairs.join(taken, ["u", "v"], "left_anti")

    def mass(self, pairs: DataFrame, few: bool) -> DataFrame:
        return stats.pair_mass(self.graph, pairs.select("u", "v"), self.nodes.select("id", "d"), few)

    def of(self, pairs: DataFrame, column: str) -> DataFrame:
        """The nodes whose cell or class is in x or y of pairs."""
        return self.nodes.join(pairs.select(F.explode(F.array("x", "y")).alias(column)).distinct(), column, "left_semi")

    def bounded(self, pairs: DataFrame, orders=(2, 3)) -> DataFrame:
        """Adds bound: the least root of a score that two boxes allow without common neighbours (order 2 alone: with any)."""
        c, n = F.col, float(self.graph.n)
        low = {2: c("a_low") * c("other.a_low") - c("p_high") - c("other.p_high"), 3: -c("q_high") - c("other.q_high")}
        high = {2: c("a_high") * c("other.a_high") - c("p_low") - c("other.p_low"), 3: -c("q_low") - c("other.q_low")}
        total = F.lit(0.0)
        for k, each in ((2, 2.0 / n), (3, 6.0 / n)):
            if k in self.target and k in orders:
                gap = _gap((low[k] * each + (self.now[k] - self.target[k])) / self.scale[k], (high[k] * each + (self.now[k] - self.target[k])) / self.scale[k])
                total = total + gap * gap
        return pairs.withColumn("bound", F.sqrt(total))

    def within(self, column: str) -> Column:
        return F.col(column) <= F.lit(self.known + SLACK)

    def class_pairs(self) -> DataFrame:
        """x, y, sizes of the pairs of classes that may hold the best pair without common neighbours."""
        pairs = self.graph.spark.createDataFrame([("0", "0")], "x string, y string")
        names = [f"c{level}" for level in (0, *self.levels)] + ["class"]
        for above, name in zip(names, names[1:]):
            cells = _cells(self.of(pairs, above), name, F.col(above))
            one = cells.withColumnRenamed("parent", "x")
            two = cells.select(F.col("parent").alias("y"), F.struct(*[c for c in cells.columns if c != "parent"]).alias("other"))
            met = pairs.select("x", "y").join(one, "x").join(two, "y").filter((F.col("x") != F.col("y")) | (F.col("key") <= F.col("other.key")))
            met = met.filter((F.col("key") != F.col("other.key")) | (F.col("size") > 1))
            met = self.bounded(met).filter(self.within("bound"))
            kept = written(met.select(F.col("key").alias("x"), F.col("other.key").alias("y"), F.col("size").alias("sx"), F.col("other.size").alias("sy"), "first", F.col("other.first").alias("second"), "bound"), "addition-cells")
            tried = kept.filter("first <> second").orderBy("bound", "x", "y").limit(TRIED).select(F.least("first", "second").alias("u"), F.greatest("first", "second").alias("v")).distinct()
            tried = cut(self.free(cut(tried), True))
            tried = tried.join(self.mass(tried, True), ["u", "v"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
            found = self.changes(tried, True).agg(F.min("root").alias("root")).first()["root"]
            if found is not None:
                self.known = min(self.known, found)
            if name != "class":  # pairs of classes are read again below
                discard(getattr(pairs, "_source", None))
            source, pairs = kept, kept.filter(self.within("bound"))
            pairs._source = source
        return pairs

    def apart(self) -> Row | None:
        """The best free pair without common neighbours: its row of changes, or None."""
        left, count, best = self.class_pairs().select("x", "y", "sx", "sy"), FIRST, None
        while True:
            rank = F.row_number().over(_by_class())
            # only the first ids of each class are kept: a bounded rank in every class
            first = self.of(left, "class").select("id", "class", rank.alias("place")).filter(F.col("place") <= count).select("id", "class")
            met = left.join(first.select(F.col("class").alias("x"), F.col("id").alias("i")), "x").join(first.select(F.col("class").alias("y"), F.col("id").alias("j")), "y")
            met = met.filter((F.col("i") < F.col("j")) | ((F.col("x") != F.col("y")) & (F.col("i") != F.col("j"))))
            met = written(met.select("x", "y", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")), "addition-pairs")
            few = met.limit(FEW + 1).count() <= FEW
            lone = self.free(met, few).join(self.mass(met, few).select("u", "v"), ["u", "v"], "left_anti")
            lone = lone.groupBy("x", "y").agg(F.min(F.struct("u", "v")).alias("pair"))
            least = met.groupBy("x", "y").agg(F.min("u").alias("least"))
            found = written(left.join(least, ["x", "y"], "left").join(lone, ["x", "y"], "left"), "addition-found")
            some = self.changes(found.filter("pair is not null").select("pair.u", "pair.v", F.lit(0.0).alias("m")), few)
            row = some.orderBy("root", "u", "v").first()
            if row is not None and (best is None or (row["root"], row["u"], row["v"]) < (best["root"], best["u"], best["v"])):
                best = row
            # whole classes were paired, or the least id of both has a partner: then no other pair comes before
            whole = (F.col("sx") <= count) & (F.col("sy") <= count)
            open_pairs = written(found.filter(~whole & (F.col("pair").isNull() | (F.col("pair.u") != F.col("least")))).select("x", "y", "sx", "sy"), "addition-open")
            discard(met)
            discard(found)
            if not open_pairs.take(1):
                discard(open_pairs)
                return best
            left, count = open_pairs, count * MORE

    def alive(self) -> DataFrame:
        """id, d, a, p of the nodes that some other node may join as far as order 2 goes: its box is near enough to one of theirs.

        Cells of the nodes left are tested against each other, and finer ones again, while they are few.
        """
        left = self.nodes.select("id", "d", "a", "p", "q", *[f"c{level}" for level in LEVELS])
        if 2 in self.target and math.isfinite(self.known):
            for level in LEVELS:
                cells = cut(_cells(left, f"c{level}", F.lit("0")))
                if cells.count() > CELLS:
                    break
                other = cells.select(F.struct(*[c for c in cells.columns if c != "parent"]).alias("other"))
                met = cells.crossJoin(F.broadcast(other)).filter((F.col("key") != F.col("other.key")) | (F.col("size") > 1))
                kept = cut(self.bounded(met, (2,)).filter(self.within("bound")).select(F.col("key").alias(f"c{level}")).distinct())
                left = left.join(F.broadcast(kept), f"c{level}", "left_semi")
        return written(left.select("id", "d", "a", "p"), "addition-alive")

    def near(self) -> Row | None:
        """The best of the free pairs with common neighbours that may beat the known score: its row of changes, or None."""
        c, n = F.col, float(self.graph.n)
        side = self.alive()
        ends = side.limit(FEW + 1).count()
        if ends < 2:
            discard(side)
            return None
        start = side.withColumnRenamed("id", "src")
        arcs = self.graph.arcs().join(F.broadcast(start) if ends <= FEW else start, "src")
        one = arcs.select("dst", F.col("src").alias("u"), F.col("a").alias("au"), F.col("p").alias("pu"))
        two = arcs.select("dst", F.col("src").alias("v"), F.col("a").alias("av"), F.col("p").alias("pv"))
        wedges = one.join(two, "dst").filter("u < v")
        if 2 in self.target and math.isfinite(self.known):
            change = (2.0 / n) * (c("au") * c("av") - c("pu") - c("pv"))
            wedges = wedges.filter(F.abs((change + (self.now[2] - self.target[2])) / self.scale[2]) <= F.lit(self.known + SLACK))
        middle = self.nodes.select(F.col("id").alias("dst"), F.col("d").alias("dm"))
        mass = written(wedges.join(middle, "dst").groupBy("u", "v").agg(F.sum(1.0 / F.col("dm")).alias("m")), "addition-near")
        few = mass.limit(FEW + 1).count() <= FEW
        row = self.changes(self.free(mass, few), few).orderBy("root", "u", "v").first()
        discard(mass)
        discard(side)
        return row


def _by_class():
    from pyspark.sql import Window

    return Window.partitionBy("class").orderBy("id")


def best_addition(graph: Graph, now: dict[int, float], target: dict[int, float], scale: dict[int, float], skip: DataFrame | None = None, direct: int = DIRECT, rows: DataFrame | None = None) -> DataFrame:
    """u, v, delta_m2, delta_m3 of the free pair whose addition comes nearest to ``target``; no row if there is none.

    ``now``, ``target`` and ``scale`` are by order, 2 or 3 or both; ``skip`` (u, v) holds pairs that must not be added.
    Up to ``direct`` classes of nodes are paired at once, more by grids that get finer; the result is the same.
    ``rows``: the nodes' features, where they are written already; they are dropped.
    """
    if not target or not set(target) <= {2, 3}:
        raise ValueError("orders are 2 and 3")
    spark, schema = graph.spark, "u long, v long, delta_m2 double, delta_m3 double, root double"
    if graph.n < 2:
        return spark.createDataFrame([], schema).drop("root")
    search = _Search(graph, now, target, scale, skip, direct, rows)
    apart = search.apart()
    if apart is not None:
        search.known = min(search.known, apart["root"])
    row = search.near()
    found = [r for r in (apart, row) if r is not None]
    best = min(found, key=lambda r: (r["root"], r["u"], r["v"]), default=None)
    discard(search.nodes)
    return spark.createDataFrame([tuple(best[c] for c in ("u", "v", "delta_m2", "delta_m3", "root"))] if best else [], schema).drop("root")
