"""Exact moment changes of edge edits: one edge at a time for all candidates at once, or a batch jointly.

Orders 2 and 3 are closed forms over node statistics. Any order follows from walk return
probabilities between a candidate's endpoints, s_t(a, b) = (P^t)_ab, by a 2 x 2 determinant
recurrence (functions.determinant_deltas); they are read from powers of the symmetric matrix up to
half the order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from . import blocks, stats
from .graph import Graph, canonical, complement, pair, require_members
from .lineage import cut
from .moments import compute_moments, orders_of, product, symmetric
from .walks import WHOLE, walk_sums


@dataclass
class State:
    """Triangles, node statistics and moments 2 and 3 of one graph, computed once for several queries."""

    triangles: DataFrame
    nodes: DataFrame
    moments: dict[int, float]


def prepare(graph: Graph) -> State:
    """Persists triangles and node statistics; the moments are sums over the nodes."""
    tri = stats.triangles(graph).persist()
    nodes = stats.node_stats(graph, tri).persist()
    zero, inv = F.lit(0.0), fn.inverse(F.col("d"))
    row = nodes.agg(F.coalesce(F.sum(F.col("W") * inv), zero).alias("a"), F.coalesce(F.sum(F.col("H") * inv), zero).alias("b")).first()
    return State(tri, nodes, {2: row["a"] / graph.n, 3: 2 * row["b"] / graph.n})


def delete_deltas(graph: Graph, candidates: DataFrame | None = None, state: State | None = None) -> DataFrame:
    """u, v, delta_m2, delta_m3 of deleting each candidate edge (default: every edge)."""
    tri = stats.triangles(graph) if state is None else state.triangles
    ends = stats.node_stats(graph, tri) if state is None else state.nodes
    rows = (graph.edges if candidates is None else candidates).join(stats.edge_mass(tri), ["u", "v"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    for e in "uv":
        rows = rows.join(ends.select(F.col("id").alias(e), F.col("d").cast("double").alias(f"d{e}"), F.col("W").alias(f"w{e}"), F.col("H").alias(f"h{e}")), e)
    c, n = F.col, float(graph.n)
    return rows.select(
        "u",
        "v",
        fn.delete_m2(c("du"), c("dv"), c("wu"), c("wv"), n).alias("delta_m2"),
        fn.delete_m3(c("du"), c("dv"), c("hu"), c("hv"), c("m"), n).alias("delta_m3"),
    )


def add_deltas(graph: Graph, candidates: DataFrame | None = None) -> DataFrame:
    """u, v, delta_m2, delta_m3 of adding each candidate pair (default: every non-edge).

    All non-edges are about n^2 / 2: they meet the statistics of the n nodes by a broadcast and are shuffled nowhere.
    """
    ends = stats.node_stats(graph)
    if candidates is None:
        rows, ends = stats.non_edge_mass(graph), F.broadcast(ends)
    else:
        rows = candidates.join(stats.pair_mass(graph, candidates), ["u", "v"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    for e in "uv":
        rows = rows.join(ends.select(F.col("id").alias(e), F.col("d").cast("double").alias(f"d{e}"), F.col("W").alias(f"w{e}"), F.col("H").alias(f"h{e}")), e)
    c, n = F.col, float(graph.n)
    return rows.select(
        "u",
        "v",
        fn.add_m2(c("du"), c("dv"), c("wu"), c("wv"), n).alias("delta_m2"),
        fn.add_m3(c("du"), c("dv"), c("hu"), c("hv"), c("m"), n).alias("delta_m3"),
    )


def frontiers(graph: Graph, sources: DataFrame, top: int) -> dict[int, DataFrame]:
    """i, j, w: the rows i of S^1..S^top that start in ``sources`` (i), each step from the nodes reached before."""
    step = symmetric(graph)
    step = cut(step) if top > 1 else step
    out = {1: cut(step.join(sources, "i", "left_semi"))}
    for t in range(2, top + 1):
        out[t] = cut(product(out[t - 1], step))
    return out


def _powers_at(graph: Graph, asked: DataFrame, sources: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """i, w1..w<top> of the diagonal and u, v, w1..w<top> of the pairs, from rows of S^t that start at their ends."""
    half = max(1, -(-top // 2))
    walk = frontiers(graph, sources, half)
    each = range(1, top + 1)
    at = across = None
    for t in each:
        if t <= half:
            own = walk[t].filter("i = j").select("i", F.lit(t).alias("t"), "w")
            pair_of = walk[t].select(F.col("i").alias("u"), F.col("j").alias("v"), "w").join(asked, ["u", "v"], "left_semi").select("u", "v", F.lit(t).alias("t"), "w")
        else:
            low, high = walk[t // 2], walk[t - t // 2]
            both = low.select("i", "j", F.col("w").alias("x")).join(high.select("i", "j", F.col("w").alias("y")), ["i", "j"])
            own = both.groupBy("i").agg(F.sum(F.col("x") * F.col("y")).alias("w")).select("i", F.lit(t).alias("t"), "w")
            step = asked.join(low.select(F.col("i").alias("u"), F.col("j").alias("k"), F.col("w").alias("x")), "u")
            step = step.join(high.select(F.col("i").alias("v"), F.col("j").alias("k"), F.col("w").alias("y")), ["v", "k"])
            pair_of = step.groupBy("u", "v").agg(F.sum(F.col("x") * F.col("y")).alias("w")).select("u", "v", F.lit(t).alias("t"), "w")
        at = own if at is None else at.unionByName(own)
        across = pair_of if across is None else across.unionByName(pair_of)
    entries = [F.sum(F.when(F.col("t") == t, F.col("w"))).alias(f"w{t}") for t in each]
    return at.groupBy("i").agg(*entries), across.groupBy("u", "v").agg(*entries)


def walk_values(graph: Graph, pairs: DataFrame, top: int, present: bool = False, deg: DataFrame | None = None) -> DataFrame:
    """Pairs with du, dv and s<t>_uu, s<t>_vv, s<t>_uv, s<t>_vu for t = 0..top.

    Pairs that are edges (``present``) take entries up to order 5 from walks.walk_sums, which writes no power of S.

    Else only rows of S^t that start at an end of a pair are made, up to t = ceil(top / 2): they hold what lies
    within so many steps of the pairs. Entries of higher powers meet in the middle: the diagonal is a sum
    over two rows of the same end, and a pair's entry, as powers of S are symmetric, a sum over the lower
    power's row of one end and the higher power's row of the other.
    """
    deg = stats.all_degrees(graph) if deg is None else deg
    asked = cut(pairs.select("u", "v"))
    rows = asked
    for e in "uv":
        rows = rows.join(deg.select(F.col("id").alias(e), F.col("d").cast("double").alias(f"d{e}")), e)
    one, zero = F.lit(1.0), F.lit(0.0)
    each = range(1, top + 1)
    sources = asked.select(F.explode(F.array("u", "v")).alias("i")).distinct()
    sums = walk_sums(graph, top, None if pairs is graph.edges else sources) if present else None
    if sums is not None:
        sums = cut(sums)
        diagonal, across = sums.filter("u = v").select(F.col("u").alias("i"), *[f"w{t}" for t in each]), sums.filter("u <> v")
    else:
        diagonal, across = _powers_at(graph, asked, sources, top)
    for e in "uv":
        rows = rows.join(diagonal.select(F.col("i").alias(e), *[F.col(f"w{t}").alias(f"s{t}_{e}{e}") for t in each]), e, "left")
    rows = rows.join(across, ["u", "v"], "left")
    ratio = F.when((F.col("du") > 0) & (F.col("dv") > 0), F.sqrt(F.col("du") / F.col("dv")))
    named = {"s0_uu": one, "s0_vv": one, "s0_uv": zero, "s0_vu": zero}
    for t in each:
        named |= {f"s{t}_{e}{e}": F.coalesce(F.col(f"s{t}_{e}{e}"), zero) for e in "uv"}
        named |= {f"s{t}_uv": F.coalesce(ratio * F.col(f"w{t}"), zero), f"s{t}_vu": F.coalesce(F.col(f"w{t}") / ratio, zero)}
    return rows.select("u", "v", "du", "dv", *[x.alias(name) for name, x in named.items()])


def walk_deltas(graph: Graph, candidates: DataFrame, orders, adding: bool = False, deg: DataFrame | None = None) -> DataFrame:
    """u, v, delta_m<k> for any orders, for deletions of edges or additions of non-edges."""
    wanted = orders_of(orders)
    top = wanted[-1]
    rows = walk_values(graph, candidates, top, present=not adding, deg=deg)

    def s(t: int, ab: str):
        return F.col(f"s{t}_{ab}")

    h = {}
    for t in range(top):
        if adding:
            du, dv = F.col("du") + 1.0, F.col("dv") + 1.0
            h[t] = ((s(t, "uv") - s(t + 1, "uu")) / du, (s(t, "uu") - s(t + 1, "uv")) / dv, (s(t, "vv") - s(t + 1, "vu")) / du, (s(t, "vu") - s(t + 1, "vv")) / dv)
        else:
            du, dv = F.col("du"), F.col("dv")
            first = F.when(du > 1, (s(t + 1, "uu") - s(t, "uv")) / (du - 1.0)).otherwise(-s(t, "uv"))
            third = F.when(du > 1, (s(t + 1, "vu") - s(t, "vv")) / (du - 1.0)).otherwise(-s(t, "vv"))
            second = F.when(dv > 1, (s(t + 1, "uv") - s(t, "uu")) / (dv - 1.0)).otherwise(-s(t, "uu"))
            fourth = F.when(dv > 1, (s(t + 1, "vv") - s(t, "vu")) / (dv - 1.0)).otherwise(-s(t, "vu"))
            h[t] = (first, second, third, fourth)
    rows = rows.select("u", "v", *[x.alias(f"h{t}_{k}") for t, m in h.items() for k, x in enumerate(m)])
    return fn.with_determinant_deltas(rows, top, float(graph.n)).select("u", "v", *[f"delta_m{k}" for k in wanted])


def all_addition_deltas(graph: Graph, orders) -> DataFrame:
    """u, v, delta_m<k> of adding each pair that is no edge, for any orders: quadratic in n by definition.

    Up to order 8 the pairs are made in place beside the columns of the walk powers (blocks.addition_changes).
    """
    wanted = orders_of(orders)
    graph = Graph(cut(graph.edges), graph.n)
    if wanted[-1] > WHOLE or graph.n >= 1 << 31 or 2 * graph.edges.count() > blocks.ARCS:
        return walk_deltas(graph, complement(graph), wanted, adding=True)
    names = [f"w{t}" for t in range(1, wanted[-1] + 1)]
    near = blocks.near_lists(graph.arcs())
    back = walk_sums(graph, wanted[-1], across=False).select(F.col("u").alias("id"), *names)
    rows = graph.nodes().join(near, "id", "left").join(back, "id", "left")
    none = F.array().cast("array<long>")
    return blocks.addition_changes(cut(rows.select("id", F.coalesce("near", none).alias("near"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])), graph.n, wanted)


def apply_edits(graph: Graph, additions: DataFrame | None, deletions: DataFrame | None) -> Graph:
    """The graph after a valid batch; raises where a batch repeats, adds an edge or deletes a non-edge."""
    edges = graph.edges
    if deletions is not None:
        gone = require_members(deletions, graph.edges, True)
        edges = edges.join(gone, ["u", "v"], "left_anti")
    if additions is not None:
        edges = edges.unionByName(require_members(additions, graph.edges, False))
    return Graph(edges, graph.n)


def joint_delta(graph: Graph, additions: DataFrame | None, deletions: DataFrame | None, orders=(2, 3)) -> dict[int, float]:
    """Exact change of each moment by a whole batch at once; an empty batch changes nothing."""
    after = apply_edits(graph, additions, deletions)
    old, new = compute_moments(graph, orders), compute_moments(after, orders)
    return {k: new[k] - old[k] for k in old}


def transition_update(graph: Graph, additions: DataFrame | None, deletions: DataFrame | None) -> DataFrame:
    """i, t, w: entries of the change of the column-stochastic transition matrix, columns t of touched nodes."""
    after = apply_edits(graph, additions, deletions)
    touched = None
    for edits in (additions, deletions):
        if edits is not None:
            ends = edits.select(F.col("u").alias("t")).unionByName(edits.select(F.col("v").alias("t")))
            touched = ends if touched is None else touched.unionByName(ends)
    touched = touched.distinct()

    def columns(g: Graph, name: str) -> DataFrame:
        near = g.arcs().select(F.col("src").alias("t"), F.col("dst").alias("i")).join(touched, "t")
        size = near.groupBy("t").agg(F.count("*").alias("d"))
        return near.join(size, "t").select("i", "t", (1.0 / F.col("d")).alias(name))

    both = columns(graph, "old").join(columns(after, "new"), ["i", "t"], "full")
    change = F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    return both.select("i", "t", change.alias("w")).filter("w <> 0")


def joint_delta_low_rank(graph: Graph, additions: DataFrame | None, deletions: DataFrame | None, orders=(2, 3)) -> dict[int, float]:
    """The same by a low-rank series: P' = P + C R' with one column of C for each touched node.

    H_t, the touched rows of P^t C, are small (touched x touched) and come to the driver; the walk
    products stay in Spark. Traces follow from sum over l of tr(S^l) / l with S(z) = sum z^(t+1) H_t.
    """
    wanted = orders_of(orders)
    top = wanted[-1]
    change = cut(transition_update(graph, additions, deletions))
    touched = [r["t"] for r in change.select("t").distinct().orderBy("t").collect()]  # at most two for each edit
    if not touched:
        return dict.fromkeys(wanted, 0.0)
    place = {t: k for k, t in enumerate(touched)}
    deg = stats.degrees(graph)
    walk = graph.arcs().join(deg.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), (1.0 / F.col("d")).alias("p"))
    rows = graph.spark.createDataFrame([(t,) for t in touched], "i long")
    current, h = change, []
    for t in range(top):
        small = np.zeros((len(touched), len(touched)))
        for r in current.join(rows, "i", "left_semi").collect():
            small[place[r["i"]], place[r["t"]]] = r["w"]
        h.append(small)
        if t + 1 < top:
            current = cut(walk.join(current.withColumnRenamed("i", "j"), "j").groupBy("i", "t").agg(F.sum(F.col("p") * F.col("w")).alias("w")))
    return {k: v / graph.n for k, v in trace_series(h, top).items() if k in wanted}


def trace_series(h: list[np.ndarray], top: int) -> dict[int, float]:
    """Change of Tr(P^k) for k = 1..top from H_0..H_(top-1): k times the z^k term of sum tr(S^l) / l."""
    out = dict.fromkeys(range(1, top + 1), 0.0)
    power = {j + 1: h[j] for j in range(top)}  # S, by degree
    for l in range(1, top + 1):
        for k, m in power.items():
            out[k] += k * float(np.trace(m)) / l
        following: dict[int, np.ndarray] = {}
        for a, m in power.items():
            for j in range(top - a):
                following[a + j + 1] = following.get(a + j + 1, 0) + m @ h[j]
        power = following
    return out


def direct_deltas(graph: Graph, candidates: list[tuple[int, int]], orders) -> list[tuple]:
    """(u, v, change per order) by recomputing the moments after each deletion: the slow reference way."""
    spark, out = graph.spark, []
    before = compute_moments(graph, orders)
    for u, v in candidates:
        one = spark.createDataFrame([(u, v)], "u long, v long")
        after = compute_moments(Graph(graph.edges.join(one, ["u", "v"], "left_anti"), graph.n), orders)
        out.append((u, v, *[after[k] - before[k] for k in sorted(before)]))
    return out


def direct_deltas_near(graph: Graph) -> DataFrame:
    """u, v, delta_m2, delta_m3 of every edge: the terms of the traces that it touches, summed with it and without it.

    These are the edges and triangles at its ends; all other terms are the same in both traces. A triangle at both
    ends goes with the edge.
    """
    c, n, one, zero = F.col, float(graph.n), F.lit(1.0), F.lit(0.0)
    deg = stats.degrees(graph)
    edges = graph.edges.select("u", "v")
    for e in "uv":
        edges = edges.join(deg.select(c("id").alias(e), c("d").cast("double").alias(f"d{e}")), e)
    edges = cut(edges)
    ways = edges.select("u", "v", c("u").alias("at"), c("v").alias("to"), c("du").alias("d"), c("dv").alias("e"))
    ways = ways.unionByName(edges.select("u", "v", c("v").alias("at"), c("u").alias("to"), c("dv").alias("d"), c("du").alias("e")))
    less = F.when(c("d") > 1, one / F.greatest(c("d") - 1.0, one)).otherwise(zero) - one / c("d")
    arcs = ways.select("at", c("to").alias("x"), c("e").alias("dx"))
    two = ways.join(arcs, "at").select("u", "v", F.when(c("x") == c("to"), -one / (c("d") * c("dx"))).otherwise(2.0 * less / c("dx")).alias("two"), zero.alias("three"))
    near = stats.corners(stats.triangles(graph)).select(c("id").alias("at"), "x", "y", "dx", "dy")
    both = (c("x") == c("to")) | (c("y") == c("to"))  # seen from either end of the edge: half each
    three = ways.join(near, "at").select("u", "v", zero.alias("two"), (F.when(both, -3.0 / c("d")).otherwise(6.0 * less) / (c("dx") * c("dy"))).alias("three"))
    return two.unionByName(three).groupBy("u", "v").agg((F.sum("two") / n).alias("delta_m2"), (F.sum("three") / n).alias("delta_m3"))


def direct_deltas_all(graph: Graph, orders) -> DataFrame:
    """u, v, delta_m<k> of every edge: the traces of the graph without it less those with it.

    Orders 2 and 3 sum the terms near the edge (direct_deltas_near); higher ones take dense walk powers, edges dealt to tasks.
    """
    wanted, n = orders_of(orders, 2), graph.n
    if set(wanted) <= {2, 3}:
        return direct_deltas_near(graph).select("u", "v", *[f"delta_m{k}" for k in wanted])
    held = np.array(sorted((r["u"], r["v"]) for r in graph.edges.collect()), dtype=np.int64).reshape(-1, 2)  # a dense matrix holds the graph anyway
    names = ["u", "v", *[f"delta_m{k}" for k in wanted]]

    def moments(adjacent: np.ndarray) -> list[float]:
        d = adjacent.sum(1)
        scale = np.divide(1, np.sqrt(d), out=np.zeros(n), where=d > 0)
        base = adjacent * scale[:, None] * scale
        walk, found = {1: base}, []
        for k in range(2, (max(wanted) + 1) // 2 + 1):
            walk[k] = walk[k - 1] @ base
        for k in wanted:
            found.append(float((walk[(k + 1) // 2] * walk[k // 2]).sum()) / n)
        return found

    def run(parts):
        whole = np.zeros((n, n))
        whole[held[:, 0], held[:, 1]] = whole[held[:, 1], held[:, 0]] = 1
        before = moments(whole)
        for part in parts:
            rows = []
            for u, v in zip(part.u, part.v, strict=True):
                whole[u, v] = whole[v, u] = 0
                rows.append((u, v, *[a - b for a, b in zip(moments(whole), before, strict=True)]))
                whole[u, v] = whole[v, u] = 1
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"{c} {'long' if c in 'uv' else 'double'}" for c in names)
    return graph.edges.select("u", "v").repartition(8 * graph.spark.sparkContext.defaultParallelism, "u", "v").mapInPandas(run, schema)


BACKENDS = ("topology", "low_rank")


def deletion_deltas(graph: Graph, orders=(2, 3), backend: str = "low_rank", candidates: DataFrame | None = None) -> DataFrame:
    """u, v, delta_m<k>: closed forms for ``topology`` (orders 2 and 3 only), walk values for ``low_rank``;
    ``hybrid`` and ``auto`` take closed forms where they exist and walk values for the rest."""
    wanted = orders_of(orders, 2)
    pairs = graph.edges if candidates is None else candidates
    near = [k for k in wanted if k in (2, 3)]
    if backend == "topology" and len(near) < len(wanted):
        raise ValueError("the topology backend has orders 2 and 3 only")
    if backend not in (*BACKENDS, "hybrid", "auto"):
        raise ValueError(f"unknown backend {backend!r}")
    if backend == "low_rank":
        return walk_deltas(graph, pairs, wanted)
    far = [k for k in wanted if k not in near]
    state = None
    if near and far:  # degrees, triangles and statistics of nodes are read more than once: made once
        deg = cut(stats.degrees(graph))
        tri = cut(stats.triangles(graph, deg))
        state = State(tri, cut(stats.node_stats(graph, tri, deg)), {})
    close = delete_deltas(graph, pairs, state).select("u", "v", *[f"delta_m{k}" for k in near])
    return close.join(walk_deltas(graph, pairs, far, deg=state and state.nodes.select("id", "d")), ["u", "v"]) if far else close


@dataclass
class MomentDeltaCalculator:
    """Queries against one fixed graph; none of them changes it."""

    graph: Graph

    @classmethod
    def from_undirected_edges(cls, edges: DataFrame, num_nodes: int) -> MomentDeltaCalculator:
        return cls(canonical(edges, num_nodes))

    @property
    def num_nodes(self) -> int:
        return self.graph.n

    @property
    def edges(self) -> DataFrame:
        return self.graph.edges

    def deletion_deltas(self, candidates: DataFrame | None = None, *, orders=(2, 3), backend: str = "low_rank") -> DataFrame:
        if backend not in BACKENDS:
            raise ValueError(f"backend must be one of {BACKENDS}")
        wanted = orders_of(orders, 2)
        rows = None if candidates is None else require_members(candidates, self.edges, True)
        return deletion_deltas(self.graph, wanted, backend, rows)

    def addition_deltas(self, candidates: DataFrame, *, orders=(2, 3), backend: str = "low_rank") -> DataFrame:
        if backend not in BACKENDS:
            raise ValueError(f"backend must be one of {BACKENDS}")
        wanted = orders_of(orders, 2)
        rows = require_members(candidates, self.edges, False)
        if backend == "topology":
            if wanted[-1] > 3:
                raise ValueError("the topology backend has orders 2 and 3 only")
            return add_deltas(self.graph, rows).select("u", "v", *[f"delta_m{k}" for k in wanted])
        return walk_deltas(self.graph, rows, wanted, adding=True)

    def batch_edit_delta(self, additions: DataFrame | None = None, deletions: DataFrame | None = None, *, orders=(2, 3)) -> dict[int, float]:
        wanted = orders_of(orders, 2)
        add = additions if additions is None or not additions.isEmpty() else None
        drop = deletions if deletions is None or not deletions.isEmpty() else None
        if add is None and drop is None:
            return dict.fromkeys(wanted, 0.0)
        return joint_delta_low_rank(self.graph, add, drop, wanted)


__all__ = ["MomentDeltaCalculator", "add_deltas", "apply_edits", "delete_deltas", "deletion_deltas", "direct_deltas", "joint_delta", "joint_delta_low_rank", "pair", "trace_series", "transition_update", "walk_deltas"]
