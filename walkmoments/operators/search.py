"""Choosing edits: scores, argmin, top-k, directional choices, and target-driven trajectories.

Ties: scores are compared after rounding their square root to 12 digits, then by (operation,) u, v.
One step over all candidates is a DataFrame expression. A trajectory is sequential by nature: a
small graph's whole trajectory runs in one task of a grouped map (many graphs and runs in parallel),
a large graph's steps run one Spark job each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from . import blocks, stats
from .additions import best_addition
from .blocks import determinant_changes
from .deltas import add_deltas, apply_edits, delete_deltas, deletion_deltas, walk_deltas
from .graph import Graph, canonical, complement
from .incremental import MaintainedGraph
from .lineage import cut, written
from .moments import compute_moments, orders_of
from .sampling import subsample

DIGITS = 12


def after(moments: dict[int, float], orders) -> dict[int, Column]:
    return {k: F.lit(moments[k]) + F.col(f"delta_m{k}") for k in orders}


def scored(deltas: DataFrame, moments: dict[int, float], target: dict[int, float], scale: dict[int, float], origin: dict[int, float] | None = None, euclidean: bool = False) -> DataFrame:
    """Adds score: the distance of the edited moments from the target."""
    return deltas.withColumn("score", fn.target_distance(after(moments, target), target, scale, origin, euclidean))


def rank_key(*more: str) -> list[Column]:
    return [F.round(F.sqrt("score"), DIGITS), *[F.col(c) for c in (*more, "u", "v")]]


def best(rows: DataFrame, k: int = 1, *more: str) -> DataFrame:
    """The k rows with the least score; a bounded top-k, never a sort of all rows."""
    return rows.orderBy(*rank_key(*more)).limit(k)


def std_scale(deltas: DataFrame, orders) -> dict[int, float]:
    """Population standard deviation of each order's changes, 1 where it vanishes."""
    row = deltas.agg(*[F.stddev_pop(f"delta_m{k}").alias(f"s{k}") for k in orders]).first()
    return {k: row[f"s{k}"] if row[f"s{k}"] is not None and row[f"s{k}"] > 1e-12 else 1.0 for k in orders}


def relative_scale(moments: dict[int, float]) -> dict[int, float]:
    return {k: abs(m) if abs(m) > 1e-12 else 1.0 for k, m in moments.items()}


def edit_candidates(graph: Graph, operation: str, orders=(2, 3), skip: DataFrame | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """op, op_rank, u, v and changes of the possible edits of a kind (add, delete or mixed).

    ``skip``: pairs left out. ``limit``: so many additions and so many deletions, chosen by hash,
    before anything is computed for them.
    """
    def changes(adding: bool) -> DataFrame:
        if adding and skip is None and limit is None and set(orders) <= {2, 3}:
            pairs = None  # every non-edge
        else:
            pairs = complement(graph) if adding else graph.edges
        if skip is not None:
            pairs = pairs.join(F.broadcast(skip), ["u", "v"], "left_anti")  # the edits so far
        if limit is not None:
            pairs = subsample(pairs.select("u", "v"), limit, seed)
        if set(orders) <= {2, 3}:
            rows = add_deltas(graph, pairs) if adding else delete_deltas(graph, pairs)
        else:
            rows = walk_deltas(graph, pairs, orders, adding)
        name, rank = ("add", 0) if adding else ("delete", 1)
        return rows.select(F.lit(name).alias("op"), F.lit(rank).alias("op_rank"), "u", "v", *[f"delta_m{k}" for k in orders])

    if operation == "mixed":
        return changes(True).unionByName(changes(False))
    return changes(operation == "add")


def best_mixed(graph: Graph) -> DataFrame:
    """op, op_rank, u, v, changes and score of the edit that keeps the moments nearest: the best addition, found without the complement, against all deletions."""
    m = compute_moments(graph, (2, 3))
    scale = relative_scale(m)
    add = best_addition(graph, m, m, scale).select(F.lit("add").alias("op"), F.lit(0).alias("op_rank"), "u", "v", "delta_m2", "delta_m3")
    return best(scored(add.unionByName(edit_candidates(graph, "delete")), m, m, scale), 1, "op_rank")


def directional(rows: DataFrame, moments: dict[int, float], x: float, y: float) -> DataFrame:
    """The edit whose relative change reaches farthest along (x, y); a deletion wins only if strictly better."""
    gain = x * fn.relative(F.col("delta_m2"), moments[2]) + y * fn.relative(F.col("delta_m3"), moments[3])
    return rows.withColumn("gain", gain).orderBy(F.round("gain", DIGITS).desc(), "op_rank", "u", "v").limit(1)


def best_directional(graph: Graph, moments: dict[int, float], x: float, y: float) -> DataFrame:
    """:func:`directional` of all edits: each block of nodes names its best addition (blocks.farthest_additions), and only these meet the deletions.

    Graphs of more than blocks.ARCS arcs list all pairs.
    """
    graph = Graph(written(graph.edges.select("u", "v"), "directional-edges"), graph.n)
    deletions = edit_candidates(graph, "delete")
    if graph.n >= 1 << 31 or 2 * graph.edges.count() > blocks.ARCS:
        return directional(edit_candidates(graph, "mixed"), moments, x, y)
    lists = stats.node_stats(graph).select("id", "W", "H").join(blocks.near_lists(graph.arcs()), "id", "left")
    each = [weight / max(abs(moments[k]), 1e-12) for k, weight in ((2, x), (3, y))]
    pairs = cut(blocks.farthest_additions(written(lists, "directional-lists"), graph.n, *each))
    additions = add_deltas(graph, pairs).select(F.lit("add").alias("op"), F.lit(0).alias("op_rank"), "u", "v", "delta_m2", "delta_m3")
    return directional(additions.unionByName(deletions), moments, x, y)


def direction_record(rows: DataFrame, moments: dict[int, float], x: float, y: float) -> DataFrame:
    """Adds rel_m2, rel_m3, gain, orthogonal, cosine (null below 1e-12) and length of each change along (x, y)."""
    size = float(np.hypot(x, y))
    ux, uy = x / size, y / size
    rows = rows.withColumn("rel_m2", fn.relative(F.col("delta_m2"), moments[2])).withColumn("rel_m3", fn.relative(F.col("delta_m3"), moments[3]))
    rows = rows.withColumn("gain", ux * F.col("rel_m2") + uy * F.col("rel_m3")).withColumn("orthogonal", F.abs(ux * F.col("rel_m3") - uy * F.col("rel_m2")))
    rows = rows.withColumn("length", F.sqrt(F.col("rel_m2") ** 2 + F.col("rel_m3") ** 2))
    return rows.withColumn("cosine", F.when(F.col("length") > 1e-12, F.col("gain") / F.col("length")))


def ray_constrained(rows: DataFrame, moments: dict[int, float], x: float, y: float, least_gain: float = 0.0, least_cosine: float = 0.0, penalty: float = 1.0) -> DataFrame:
    """The edit near the ray (x, y) with the best gain less penalised drift."""
    found = direction_record(rows, moments, x, y).filter((F.col("gain") > least_gain) & (F.col("cosine") >= least_cosine))
    return found.withColumn("value", F.col("gain") - penalty * F.col("orthogonal")).orderBy(F.round("value", DIGITS).desc(), "op_rank", "u", "v").limit(1)


def target_grid(spark, m2: float, m3: float, steps2: int, steps3: int, spread: float, with_origin: bool = True) -> DataFrame:
    """target_id, m2, m3: a box around (m2, m3), clamped to [0, 1] and [0, 1/4], without points m3 > m2; the origin comes last."""
    def axis(name: str, at: float, steps: int, top: float) -> Column:
        low, high = at * (1 - spread), at * (1 + spread)
        step = (high - low) / (steps - 1) if steps > 1 else 0.0
        return F.least(F.greatest(F.lit(low) + F.col(name) * F.lit(step), F.lit(0.0)), F.lit(top))

    a, b = spark.range(steps2).withColumnRenamed("id", "i"), spark.range(steps3).withColumnRenamed("id", "j")
    # steps2 * steps3 points
    grid = a.select("i", F.explode(F.sequence(F.lit(0), F.lit(steps3 - 1))).alias("j"))
    rows = grid.select((F.col("i") * steps3 + F.col("j")).cast("long").alias("target_id"), axis("i", m2, steps2, 1.0).alias("m2"), axis("j", m3, steps3, 0.25).alias("m3")).filter("m3 <= m2")
    if with_origin:
        rows = rows.unionByName(b.limit(1).select(F.lit(steps2 * steps3).cast("long").alias("target_id"), F.lit(m2).alias("m2"), F.lit(m3).alias("m3")))
    return rows


def budgets(edges: int, most: float | None = None, add: float | None = None, delete: float | None = None) -> tuple[int, int, int]:
    """Additions, deletions and edits in all that a run may make: parts of the edges each, or one part (at least one edit) for both."""
    if add is not None and delete is not None:
        return round(edges * add), round(edges * delete), round(edges * add) + round(edges * delete)
    if most is None:
        raise ValueError("give a part for all edits, or one for additions and one for deletions")
    both = max(1, round(edges * most))
    return both, both, both


def select_points(points: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """The rows of ``points`` (target_id, ...) whose ids are ``wanted``, all by default.

    Raises where an id is missing or negative in the table, where a wanted id isn't in it, and where nothing is
    left; a wanted id that repeats counts once, rows that repeat an id are all kept.
    """
    if points.filter("target_id is null or target_id < 0").limit(1).count():
        raise ValueError("target ids must be non-negative")
    if wanted is not None:
        ids = points.sparkSession.createDataFrame([(int(i),) for i in dict.fromkeys(wanted)], "target_id long")
        unknown = sorted(r["target_id"] for r in ids.join(points, "target_id", "left_anti").collect())  # of the given list
        if unknown:
            raise ValueError(f"no such target: {unknown}")
        points = points.join(F.broadcast(ids), "target_id", "left_semi")
    if points.isEmpty():
        raise ValueError("no target is left")
    return points


def prepare_points(points: DataFrame, edges: int, wanted: list[int] | None = None, **parts: float) -> DataFrame:
    """point_id, target_id, target_m2, target_m3 and the three budgets of selected targets (target_id, m2, m3)."""
    add, delete, total = budgets(edges, **parts)
    rows = select_points(points, wanted)
    name = F.concat(F.lit("target_"), F.lpad(F.col("target_id").cast("string"), 3, "0"))
    name = F.when(F.col("target_id") < 1000, name).otherwise(F.concat(F.lit("target_"), F.col("target_id").cast("string")))
    counts = [F.lit(x).cast("long").alias(f"{n}_budget") for n, x in (("add", add), ("delete", delete), ("total", total))]
    return rows.select(name.alias("point_id"), "target_id", F.col("m2").alias("target_m2"), F.col("m3").alias("target_m3"), *counts)


class SmallGraph:
    """One graph's statistics as arrays, with exact updates by recomputing what an edit touches.

    Dense in n: meant for graphs of a few thousand nodes inside one task.
    """

    def __init__(self, edges: np.ndarray, n: int):
        self.n = n
        self.a = np.zeros((n, n))
        self.a[edges[:, 0], edges[:, 1]] = self.a[edges[:, 1], edges[:, 0]] = 1.0
        self.refresh()

    def refresh(self) -> None:
        self.d = self.a.sum(1)
        self.inv = np.divide(1.0, self.d, out=np.zeros(self.n), where=self.d > 0)
        self.w = self.a @ self.inv
        self.m = (self.a * self.inv) @ self.a
        self.h = 0.5 * ((self.m * self.a) @ self.inv)

    def edit(self, u: int, v: int, present: bool) -> None:
        """Only the two degrees change, so W, H and M change at the ends and their neighbours alone.

        Those entries are summed anew, in O(d d n): nothing is added to old sums, and no error piles up.
        """
        self.a[u, v] = self.a[v, u] = 1.0 if present else 0.0
        near = np.flatnonzero((self.a[u] + self.a[v]) > 0)
        near = np.union1d(near, [u, v])
        for x in (u, v):
            self.d[x] = self.a[x].sum()
            self.inv[x] = 1.0 / self.d[x] if self.d[x] else 0.0
        rows = self.a[near] * self.inv
        self.w[near] = self.a[near] @ self.inv
        self.m[np.ix_(near, near)] = rows @ self.a[:, near]
        self.h[near] = 0.5 * (self.m[near] * rows).sum(1)

    def pairs(self, present: bool) -> np.ndarray:
        u, v = np.nonzero(np.triu(self.a == (1.0 if present else 0.0), 1))
        return np.stack([u, v], 1)

    def powers(self, top: int) -> list[np.ndarray]:
        p = self.a * self.inv[None, :]  # column-stochastic
        out = [np.eye(self.n)]
        for _ in range(top):
            out.append(out[-1] @ p)
        return out

    def moments(self, orders) -> dict[int, float]:
        out, high = {}, max(orders)
        walk = self.powers(high) if high > 3 else None
        for k in orders:
            if k == 1:
                out[k] = 0.0
            elif k == 2:
                out[k] = float(self.w @ self.inv) / self.n
            elif k == 3:
                out[k] = 2 * float(self.h @ self.inv) / self.n
            else:
                out[k] = float(np.trace(walk[k])) / self.n
        return out

    def deltas(self, pairs: np.ndarray, orders, adding: bool) -> dict[int, np.ndarray]:
        u, v = pairs[:, 0], pairs[:, 1]
        d, w, h, n = self.d, self.w, self.h, self.n
        out: dict[int, np.ndarray] = {}
        if adding:
            loss = np.divide(1.0, d * (d + 1), out=np.zeros(n), where=d > 0)
            link = 1 / ((d[u] + 1) * (d[v] + 1))
            out[2] = 2 / n * (link - w[u] * loss[u] - w[v] * loss[v])
            out[3] = 6 / n * (self.m[u, v] * link - h[u] * loss[u] - h[v] * loss[v])
        else:
            gap = np.where(d > 1, d * (d - 1), 1.0)
            m = self.m[u, v]
            out[2] = 2 / n * ((w[u] - 1 / d[v]) / gap[u] + (w[v] - 1 / d[u]) / gap[v] - 1 / (d[u] * d[v]))
            out[3] = 6 / n * ((h[u] - m / d[v]) / gap[u] + (h[v] - m / d[u]) / gap[v] - m / (d[u] * d[v]))
        if max(orders) > 3:
            out |= self.walk_deltas(u, v, max(orders), adding)
        return {k: out[k] for k in orders}

    def walk_deltas(self, u: np.ndarray, v: np.ndarray, top: int, adding: bool) -> dict[int, np.ndarray]:
        power = self.powers(top)
        s = {"uu": [x[u, u] for x in power], "uv": [x[u, v] for x in power], "vu": [x[v, u] for x in power], "vv": [x[v, v] for x in power]}
        return {k: x / self.n for k, x in determinant_changes(s, self.d[u], self.d[v], top, adding).items()}


#: Graphs of more nodes than this have no dense matrix anywhere: in a task they are neighbour lists, and whole searches are jobs.
DENSE = 4096


class SparseGraph:
    """The same for orders 2 and 3 from sorted neighbour lists: linear in edges, pairs without an edge are counted and numbered, not listed."""

    def __init__(self, edges: np.ndarray, n: int):
        self.n = n
        both = np.concatenate([edges, edges[:, ::-1]])
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        self.near = np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, n)))
        self.d = np.array([len(x) for x in self.near], dtype=float)
        self.inv = np.divide(1.0, self.d, out=np.zeros(n), where=self.d > 0)
        self.w, self.h, self.mark = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        self.renew(range(n))

    def mass(self, u: int, v: int) -> float:
        return float(self.inv[np.intersect1d(self.near[u], self.near[v], assume_unique=True)].sum())

    def renew(self, nodes) -> None:
        for x in nodes:
            near = self.near[x]
            self.w[x] = self.inv[near].sum()
            ends, value = self.two_steps(near)
            self.mark[near] = True
            self.h[x] = 0.5 * float((value * self.inv[ends])[self.mark[ends]].sum())
            self.mark[near] = False

    def two_steps(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of ``near``, one list after the other, and 1 / d of those they are neighbours of."""
        lists = [self.near[y] for y in near.tolist()]
        return np.concatenate(lists) if lists else near, np.repeat(self.inv[near], [len(x) for x in lists])

    def masses(self, u: int) -> np.ndarray:
        """By node: the sum of 1 / d over the common neighbours with u."""
        ends, value = self.two_steps(self.near[u])
        return np.bincount(ends, weights=value, minlength=self.n)

    def edit(self, u: int, v: int, present: bool) -> None:
        touched = np.unique(np.concatenate([self.near[u], self.near[v], [u, v]]))
        for x, y in ((u, v), (v, u)):
            at = int(np.searchsorted(self.near[x], y))
            self.near[x] = np.insert(self.near[x], at, y) if present else np.delete(self.near[x], at)
            self.d[x] = len(self.near[x])
            self.inv[x] = 1.0 / self.d[x] if self.d[x] else 0.0
        self.renew(touched.tolist())

    def later(self) -> list[np.ndarray]:
        """The neighbours after each node."""
        return [x[np.searchsorted(x, u, "right") :] for u, x in enumerate(self.near)]

    def pairs(self, present: bool) -> np.ndarray:
        if not present:
            return self.numbered(None, set())
        later = self.later()
        return np.stack([np.repeat(np.arange(self.n), [len(x) for x in later]), np.concatenate(later)], 1)

    def numbered(self, choose, done: set[tuple[int, int]]) -> np.ndarray:
        """The pairs without an edge and not ``done`` at the places that ``choose`` takes of their count, by u, v; all of them without it."""
        later = self.later()
        for u, v in done:
            later[u] = np.union1d(later[u], [v])
        sizes = np.array([self.n - 1 - u - len(x) for u, x in enumerate(later)])
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) if choose is None else choose(int(ends[-1]))
        u = np.searchsorted(ends, places, "right")
        k = places - (ends[u] - sizes[u])
        skipped = [np.searchsorted(later[a] - np.arange(len(later[a])) - a - 1, b, "right") for a, b in zip(u.tolist(), k.tolist())]
        return np.stack([u, u + 1 + k + np.array(skipped, dtype=np.int64)], 1) if len(u) else np.zeros((0, 2), dtype=np.int64)

    def moments(self, orders) -> dict[int, float]:
        return {k: float(self.w @ self.inv) / self.n if k == 2 else 2 * float(self.h @ self.inv) / self.n for k in orders}

    @property
    def m(self) -> SparseGraph:
        return self

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if len(at[0]) > 2 * self.n and (at[0][1:] >= at[0][:-1]).all():  # most nodes are an end of several: one pass a node
            out, first = np.zeros(len(at[0])), np.flatnonzero(np.r_[True, at[0][1:] > at[0][:-1]])
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(out)]):
                out[low:high] = self.masses(int(at[0][low]))[at[1][low:high]]
            return out
        return np.array([self.mass(u, v) for u, v in zip(at[0].tolist(), at[1].tolist())])

    deltas = SmallGraph.deltas

    def best_addition(self, now: dict[int, float], target: dict[int, float], scale: dict[int, float], done: set[tuple[int, int]]) -> tuple | None:
        """(score, u, v, changes) of the best pair that is no edge and not ``done``: a node's pairs at a time, in linear memory."""
        n, a, orders = self.n, 1 / (self.d + 1), tuple(target)
        loss = np.divide(1.0, self.d * (self.d + 1), out=np.zeros(n), where=self.d > 0)
        own = {2: self.w * loss, 3: self.h * loss}
        later, best = self.later(), None
        for u, v in done:
            later[u] = np.union1d(later[u], [v])
        for u in range(n - 1):
            link, total = a[u] * a[u + 1 :], np.zeros(n - u - 1)
            for k in orders:
                change = (link if k == 2 else self.masses(u)[u + 1 :] * link) - own[k][u + 1 :]
                change *= (2 if k == 2 else 6) / n / scale[k]
                change += (now[k] - target[k] - (2 if k == 2 else 6) / n * own[k][u]) / scale[k]
                total += change * change
            total[later[u] - u - 1] = np.inf
            low = float(total.min())
            if not np.isfinite(low) or (best is not None and np.sqrt(low) > best[0] + NEAR):
                continue
            v = u + 1 + np.flatnonzero(total <= (np.sqrt(low) + NEAR) ** 2)
            rows = np.stack([np.full(len(v), u), v], 1)
            changes = self.deltas(rows, orders, True)
            score = _distance(now, changes, target, scale)
            at = int(np.argmin(score))  # the first of equal ones
            if best is None or score[at] < best[0]:
                best = (float(score[at]), u, int(v[at]), {k: float(x[at]) for k, x in changes.items()})
        return best


#: Edges whose scores are this near the best before rounding are compared after it.
NEAR = 1e-11
#: More steps than this are one task's, not jobs, while the graph has at most so many arcs.
STEPS, TASK_ARCS = 16, 1 << 22
#: Neighbourhoods of an edit up to this size meet in a product.
MET = 1 << 22


class EdgeTable:
    """Deletions of orders 2 and 3 from arcs sorted by (src, dst): a step renews what lies near its edit, and scores all edges at once. Linear in edges."""

    def __init__(self, edges: np.ndarray, n: int):
        self.n, self.u, self.v = n, edges[:, 0], edges[:, 1]
        src, dst = np.concatenate([self.u, self.v]), np.concatenate([self.v, self.u])
        order = np.lexsort((dst, src))
        self.dst, self.edge = dst[order], order % max(len(edges), 1)
        self.start = np.searchsorted(src[order], np.arange(n + 1))
        self.alive = np.ones(len(edges), bool)
        self.d = np.diff(self.start).astype(float)
        self.inv = np.divide(1.0, self.d, out=np.zeros(n), where=self.d > 0)
        self.w, self.h, self.m = np.zeros(n), np.zeros(n), np.zeros(len(edges))
        self.change = {k: np.full(len(edges), np.inf) for k in (2, 3)}
        for x in np.flatnonzero(self.d).tolist():
            at, _ = self.arcs(np.array([x]))
            far, row = self.arcs(self.dst[at])
            self.m[self.edge[at]] = np.bincount(self.dst[far], weights=self.inv[self.dst[at]][row], minlength=n)[self.dst[at]]
        self.renew(np.arange(n))

    def arcs(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' arcs that are left, and whose of ``nodes`` each is."""
        size = self.start[nodes + 1] - self.start[nodes]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[nodes] - ends + size, size)
        live = self.alive[self.edge[at]]
        return at[live], np.repeat(np.arange(len(nodes)), size)[live]

    def renew(self, nodes: np.ndarray) -> None:
        """W and H of nodes, summed anew, and the changes of their edges."""
        at, row = self.arcs(nodes)
        inv = self.inv[self.dst[at]]
        self.w[nodes] = np.bincount(row, weights=inv, minlength=len(nodes))
        self.h[nodes] = 0.5 * np.bincount(row, weights=self.m[self.edge[at]] * inv, minlength=len(nodes))
        e = np.unique(self.edge[at])
        u, v, m, n = self.u[e], self.v[e], self.m[e], self.n
        d, w, h, gap = self.d, self.w, self.h, np.where(self.d > 1, self.d * (self.d - 1), 1.0)
        self.change[2][e] = 2 / n * ((w[u] - 1 / d[v]) / gap[u] + (w[v] - 1 / d[u]) / gap[v] - 1 / (d[u] * d[v]))
        self.change[3][e] = 6 / n * ((h[u] - m / d[v]) / gap[u] + (h[v] - m / d[u]) / gap[v] - m / (d[u] * d[v]))

    def delete(self, e: int) -> None:
        ends = np.array([self.u[e], self.v[e]])
        touched = np.unique(np.concatenate([self.dst[self.arcs(ends)[0]], ends]))
        self.alive[e] = False
        for k in self.change:
            self.change[k][e] = np.inf
        self.d[ends] -= 1
        self.inv[ends] = [1.0 / x if x else 0.0 for x in self.d[ends]]
        at, row = self.arcs(touched)
        place = np.minimum(np.searchsorted(touched, self.dst[at]), len(touched) - 1)
        inside = touched[place] == self.dst[at]
        met, column = np.unique(self.dst[at], return_inverse=True)
        if len(touched) * len(met) <= MET:
            near = np.zeros((len(touched), len(met)))
            near[row, column] = 1.0
            mass = ((near * self.inv[met]) @ near.T)[row[inside], place[inside]]
        else:
            lists = np.split(self.dst[at], np.searchsorted(row, np.arange(1, len(touched))))
            mass = [float(self.inv[np.intersect1d(lists[x], lists[y], assume_unique=True)].sum()) for x, y in zip(row[inside].tolist(), place[inside].tolist())]
        self.m[self.edge[at[inside]]] = mass
        self.renew(touched)

    def best(self, now: dict[int, float], target: dict[int, float], scale: dict[int, float], orders: tuple[int, ...]) -> int:
        total = sum(((self.change[k] + (now[k] - target[k])) / scale[k]) ** 2 for k in orders)
        low = float(total.min()) if len(total) else np.inf
        if not np.isfinite(low):
            raise ValueError("no candidate is left")
        near = np.flatnonzero(total <= (np.sqrt(low) + NEAR) ** 2)
        return int(near[np.argmin(_distance(now, {k: self.change[k][near] for k in orders}, target, scale))])

    def moments(self, orders) -> dict[int, float]:
        return SparseGraph.moments(self, orders)

    def pairs(self) -> np.ndarray:
        return np.stack([self.u[self.alive], self.v[self.alive]], 1)


@dataclass
class Plan:
    """What a trajectory does; the same for the task kernel and the job-per-step way."""

    budget: int
    orders: tuple[int, ...]
    target: dict[int, float] | None = None
    scale: dict[int, float] | None = None
    operation: str = "delete"
    strategy: str = "greedy"
    top_k: int = 25
    candidate_limit: int | None = None
    seed: int = 0
    checkpoints: tuple[int, ...] = ()
    refresh_interval: int | None = None  # lazy strategy: all scores are renewed after so many steps
    most_adds: int | None = None  # mixed trajectories make at most so many additions, and deletions
    most_deletes: int | None = None


def _distance(moments: dict[int, float], deltas: dict[int, np.ndarray], target: dict[int, float], scale: dict[int, float]) -> np.ndarray:
    total = sum(((moments[k] + deltas[k] - target[k]) / scale[k]) ** 2 for k in deltas)
    return np.round(np.sqrt(total), DIGITS)


def run_small(edges: np.ndarray, n: int, plan: Plan) -> tuple[list[tuple], dict[int, float], dict[int, float], dict[int, np.ndarray]]:
    """Edits (step, op, u, v), first and last moments, and the edges at each checkpoint."""
    if n > DENSE and set(plan.orders) <= {2, 3} and plan.operation == "delete":
        if plan.strategy == "greedy" and plan.candidate_limit is None:
            return _run_deletions(edges, n, plan)
        if plan.strategy == "random":
            return _run_random(edges, n, plan)
    g = SparseGraph(edges, n) if n > DENSE and set(plan.orders) <= {2, 3} else SmallGraph(edges, n)
    first = g.moments(plan.orders)
    target, scale = plan.target or first, plan.scale or relative_scale(first)
    now, edits, kept = dict(first), [], {}
    rng = np.random.default_rng(plan.seed)
    done: set[tuple[int, int]] = set()
    cache: np.ndarray | None = None
    pool: np.ndarray | None = None
    if 0 in plan.checkpoints:
        kept[0] = g.pairs(True)
    for step in range(1, plan.budget + 1):
        if plan.strategy == "random":
            live = g.pairs(True)
            u, v = (int(x) for x in live[rng.integers(len(live))])
            op, change = "delete", None
        elif plan.strategy == "lazy":
            if pool is None:
                pool = g.pairs(True)
            if cache is None or (plan.refresh_interval and (step - 1) % plan.refresh_interval == 0):
                cache = _distance(now, g.deltas(pool, plan.orders, False), target, scale)
            order = np.lexsort((pool[:, 1], pool[:, 0], cache))[: plan.top_k]
            fresh = g.deltas(pool[order], plan.orders, False)
            cache[order] = _distance(now, fresh, target, scale)
            pick = order[np.lexsort((pool[order, 1], pool[order, 0], cache[order]))[0]]
            at = int(np.flatnonzero(order == pick)[0])
            (u, v), op, change = (int(x) for x in pool[pick]), "delete", {k: float(x[at]) for k, x in fresh.items()}
            pool, cache = np.delete(pool, pick, 0), np.delete(cache, pick)
        else:
            choices = []
            kinds = {"delete": (False,), "add": (True,), "mixed": (True, False)}[plan.operation]
            for adding in kinds:
                most = plan.most_adds if adding else plan.most_deletes
                if most is not None and sum(e[1] == ("add" if adding else "delete") for e in edits) >= most:
                    continue
                limit = plan.candidate_limit
                if adding and limit is not None and isinstance(g, SparseGraph):
                    rows = g.numbered(lambda size: np.sort(rng.choice(size, limit, replace=False)) if limit < size else np.arange(size), done)
                else:
                    rows = g.pairs(not adding)
                    if done and plan.operation != "delete":
                        rows = rows[[(a, b) not in done for a, b in rows.tolist()]]
                    if limit is not None and limit < len(rows):
                        rows = rows[np.sort(rng.choice(len(rows), limit, replace=False))]
                if len(rows):
                    change = g.deltas(rows, plan.orders, adding)
                    score = _distance(now, change, target, scale)
                    at = int(np.lexsort((rows[:, 1], rows[:, 0], score))[0])
                    choices.append((float(score[at]), 0 if adding else 1, int(rows[at, 0]), int(rows[at, 1]), {k: float(x[at]) for k, x in change.items()}))
            if not choices:
                raise ValueError("no candidate is left")
            _, rank, u, v, change = min(choices, key=lambda c: c[:4])
            op = "delete" if rank else "add"
        done.add((u, v))
        g.edit(u, v, op == "add")
        if change is not None:
            now = {k: now[k] + change[k] for k in now}
        edits.append((step, op, u, v))
        if step in plan.checkpoints:
            kept[step] = g.pairs(True)
    return edits, first, g.moments(plan.orders), kept


def _run_deletions(edges: np.ndarray, n: int, plan: Plan):
    """The greedy path of :func:`run_small` over an edge table."""
    g = EdgeTable(edges, n)
    first = g.moments(plan.orders)
    target, scale = plan.target or first, plan.scale or relative_scale(first)
    now, edits, kept = dict(first), [], {0: g.pairs()} if 0 in plan.checkpoints else {}
    for step in range(1, plan.budget + 1):
        if plan.most_deletes is not None and step > plan.most_deletes:
            raise ValueError("no candidate is left")
        e = g.best(now, target, scale, plan.orders)
        now = {k: now[k] + float(g.change[k][e]) for k in now}
        edits.append((step, "delete", int(g.u[e]), int(g.v[e])))
        g.delete(e)
        if step in plan.checkpoints:
            kept[step] = g.pairs()
    return edits, first, g.moments(plan.orders), kept


def _run_random(edges: np.ndarray, n: int, plan: Plan):
    """The random path of :func:`run_small`: the edges left are kept in order, and no statistics."""
    live, rng = edges[np.lexsort((edges[:, 1], edges[:, 0]))], np.random.default_rng(plan.seed)
    first, edits, kept = SparseGraph(edges, n).moments(plan.orders), [], {0: live} if 0 in plan.checkpoints else {}
    for step in range(1, plan.budget + 1):
        at = int(rng.integers(len(live)))
        edits.append((step, "delete", int(live[at, 0]), int(live[at, 1])))
        live = np.delete(live, at, 0)
        if step in plan.checkpoints:
            kept[step] = live
    return edits, first, SparseGraph(live, n).moments(plan.orders), kept


@dataclass
class SamplingResult:
    edges: DataFrame
    edits: DataFrame  # step, op, u, v
    initial_moments: dict[int, float]
    final_moments: dict[int, float]
    delta_moments: dict[int, float]
    metadata: dict
    snapshots: DataFrame | None = None  # step, u, v
    snapshot_moments: dict[int, dict[int, float]] = field(default_factory=dict)


def _mapping(name: str, given: dict | None, orders: tuple[int, ...], positive: bool) -> dict[int, float] | None:
    if given is None:
        return None
    if set(given) != set(orders) or not all(np.isfinite(x) and (x > 0 or not positive) for x in given.values()):
        raise ValueError(f"{name} needs one finite{' positive' if positive else ''} value for each order")
    return {int(k): float(x) for k, x in given.items()}


def sample_by_moments(
    edges: DataFrame,
    num_nodes: int,
    *,
    budget: int,
    target: dict[int, float] | None = None,
    orders=None,
    operation: str = "delete",
    strategy: str = "greedy",
    top_k: int = 25,
    candidate_limit: int | None = None,
    scale: dict[int, float] | None = None,
    backend: str = "low_rank",
    seed: int = 0,
    checkpoints=(),
    relational: bool = False,
) -> SamplingResult:
    """Exactly ``budget`` edits, each the best next one towards ``target`` (default: the present moments).

    All arguments are checked before any search. No pair is edited twice. Checkpoints keep the edges
    at some steps and don't alter the path. ``relational`` runs each step as a Spark job over all
    candidates, for graphs too large for one task; else the trajectory runs in one task. More than DENSE nodes
    are always run as jobs, but for the random strategy, and for more than STEPS greedy deletions of orders 2 and 3,
    which a task makes over an edge table of at most TASK_ARCS arcs.
    """
    graph = canonical(edges, num_nodes)
    n, size = graph.n, graph.edges.count()
    if isinstance(budget, bool) or not isinstance(budget, int) or budget < 0:
        raise ValueError("the budget must be a non-negative integer")
    room = {"delete": size, "add": n * (n - 1) // 2 - size, "mixed": n * (n - 1) // 2}
    if operation not in room:
        raise ValueError(f"operation must be one of {tuple(room)}")
    if budget > room[operation]:
        raise ValueError(f"the budget exceeds the {room[operation]} possible edits")
    strategy = "lazy" if strategy == "heap_lazy" else strategy  # the older name
    if strategy not in ("greedy", "lazy", "random"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "lazy" and (operation != "delete" or candidate_limit is not None):
        raise ValueError("the lazy strategy deletes, and takes no candidate limit")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k <= 0 or (candidate_limit is not None and candidate_limit <= 0):
        raise ValueError("top_k and candidate_limit must be positive")
    steps = tuple(sorted(set(checkpoints)))
    if steps and (steps[0] < 0 or steps[-1] > budget):
        raise ValueError("checkpoints must lie in 0..budget")
    wanted = orders_of(orders if orders is not None else (target or (2, 3)), 2)
    if backend not in ("topology", "low_rank") or (backend == "topology" and wanted[-1] > 3):
        raise ValueError("the backend has no such orders")
    aim, by = _mapping("target", target, wanted, False), _mapping("scale", scale, wanted, True)
    plan = Plan(budget, wanted, aim, by, operation, strategy, top_k, candidate_limit, seed, steps)
    spark = graph.spark
    table = operation == "delete" and strategy == "greedy" and candidate_limit is None and set(wanted) <= {2, 3} and budget > STEPS and 2 * size <= TASK_ARCS
    if relational or n > DENSE:
        graph = Graph(written(graph.edges, "trajectory-edges"), n)
    if relational or (n > DENSE and strategy != "random" and not table):
        made = run_relational(graph, plan)
    else:
        made = run_grouped(graph.edges.select(F.lit(0).alias("run_id"), "u", "v"), n, {0: plan})
        made = made.orderBy("step").select("step", "op", "u", "v").collect()  # one row for each edit of the budget
    log = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in made], "step int, op string, u long, v long")

    def at(step: int) -> Graph:
        part = log.filter(F.col("step") <= step)
        touched = part.groupBy("u", "v").agg(F.max_by("op", "step").alias("op"))
        rest = graph.edges.join(touched, ["u", "v"], "left_anti")
        return Graph(rest.unionByName(touched.filter("op = 'add'").select("u", "v")), n)

    kept = {s: at(s) if n <= DENSE else Graph(written(at(s).edges, "trajectory-edges"), n) for s in {*steps, budget}}
    moments = {s: compute_moments(x, wanted) for s, x in kept.items()}
    first, final = compute_moments(graph, wanted), moments[budget]
    shots = None
    for s in steps:
        one = kept[s].edges.select(F.lit(s).alias("step"), "u", "v")
        shots = one if shots is None else shots.unionByName(one)
    return SamplingResult(
        kept[budget].edges,
        log,
        first,
        final,
        {k: final[k] - first[k] for k in wanted},
        {"operation": operation, "strategy": strategy, "orders": wanted, "target": aim or first, "scale": by or relative_scale(first), "backend": backend, "seed": seed, "budget": budget},
        shots,
        {s: moments[s] for s in steps},
    )


def run_grouped(edges: DataFrame, n: int, plans: dict[int, Plan]) -> DataFrame:
    """run_id, step, op, u, v: each run's whole trajectory in one task, runs side by side."""

    def kernel(key, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = rows[["u", "v"]].to_numpy(np.int64)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        edits, *_ = run_small(pairs, n, plans[int(key[0])])
        out = pd.DataFrame(edits, columns=["step", "op", "u", "v"])
        out.insert(0, "run_id", int(key[0]))
        return out

    return edges.groupBy("run_id").applyInPandas(kernel, "run_id int, step int, op string, u long, v long")


def edited(graph: Graph, made: list[tuple]) -> Graph:
    """The graph after edits (step, op, u, v), none of a pair twice."""
    spark, pair_type = graph.spark, "u long, v long"
    gone = spark.createDataFrame([e[2:] for e in made if e[1] == "delete"], pair_type)
    come = spark.createDataFrame([e[2:] for e in made if e[1] == "add"], pair_type)
    return Graph(graph.edges.join(F.broadcast(gone), ["u", "v"], "left_anti").unionByName(come), graph.n)


def _kinds(plan: Plan, made: list[tuple]) -> str:
    """The operation of the next step: of a mixed trajectory only what its caps leave."""
    left = {"add": plan.most_adds, "delete": plan.most_deletes}
    open_ = [op for op, most in left.items() if plan.operation in (op, "mixed") and (most is None or sum(e[1] == op for e in made) < most)]
    if not open_:
        raise ValueError("no candidate is left")
    return "mixed" if len(open_) == 2 else open_[0]


def run_relational(graph: Graph, plan: Plan) -> list[tuple]:
    """The same path with a few jobs a step; edits so far are a small table that updates the graph.

    Candidate limits choose by hash of the seed and the step. The lazy strategy scores every edge
    once, into a written table; each step then refreshes the ``top_k`` best by the scores held, which
    are the table's, or for edges refreshed before, at most ``top_k`` a step, the driver's. Deletions of
    orders 2 and 3 keep their statistics (incremental.MaintainedGraph): a step renews those near its edit. Additions
    of these orders without a limit are searched for without the complement (additions.best_addition).
    """
    if plan.strategy == "random":
        raise ValueError("steps as jobs are greedy or lazy")
    first = compute_moments(graph, plan.orders)
    target, scale = plan.target or first, plan.scale or relative_scale(first)
    now, made, current = dict(first), [], graph
    spark, pair_type = graph.spark, "u long, v long"
    held: dict[tuple[int, int], float] = {}
    score = F.round(F.sqrt("score"), DIGITS).alias("score")
    base = None
    # where every edge is refreshed at each step, the lazy path is the greedy one, and nothing need be held
    lazy = plan.strategy == "lazy" and plan.top_k < graph.edges.count()
    kept = MaintainedGraph.of(graph) if plan.operation == "delete" and set(plan.orders) <= {2, 3} else None
    if lazy:
        base = cut(scored(edit_candidates(graph, "delete", plan.orders), now, target, scale).select("u", "v", score))
    for step in range(1, plan.budget + 1):
        so_far = spark.createDataFrame([(u, v) for _, _, u, v in made], pair_type)
        if base is not None:
            if plan.refresh_interval and step > 1 and (step - 1) % plan.refresh_interval == 0:
                base = cut(scored(edit_candidates(current, "delete", plan.orders), now, target, scale).select("u", "v", score))
                held = {}
            known = so_far.unionByName(spark.createDataFrame(list(held), pair_type))
            fresh = base.join(F.broadcast(known), ["u", "v"], "left_anti").orderBy("score", "u", "v").limit(plan.top_k).collect()
            ranked = sorted([(r["score"], r["u"], r["v"]) for r in fresh] + [(x, u, v) for (u, v), x in held.items()])[: plan.top_k]
            pool = spark.createDataFrame([(u, v) for _, u, v in ranked], pair_type)
            rows = kept.deletion_deltas().join(F.broadcast(pool), ["u", "v"]) if kept else walk_deltas(current, pool, plan.orders)
            rows = scored(rows.withColumn("op", F.lit("delete")), now, target, scale).select("*", score.alias("ranked")).collect()
            held |= {(r["u"], r["v"]): r["ranked"] for r in rows}
            row = min(rows, key=lambda r: (r["ranked"], r["u"], r["v"]))
            held.pop((row["u"], row["v"]))
        else:
            skip, kind = so_far if made and plan.operation != "delete" else None, _kinds(plan, made)
            if kept:
                rows = kept.deletion_deltas().select(F.lit("delete").alias("op"), F.lit(1).alias("op_rank"), "u", "v", "delta_m2", "delta_m3")
                rows = rows if plan.candidate_limit is None else subsample(rows, plan.candidate_limit, plan.seed + step)
            elif kind != "delete" and plan.candidate_limit is None and set(plan.orders) <= {2, 3}:
                rows = best_addition(current, now, target, scale, skip).select(F.lit("add").alias("op"), F.lit(0).alias("op_rank"), "u", "v", *[f"delta_m{k}" for k in plan.orders])
                if kind == "mixed":
                    rows = rows.unionByName(edit_candidates(current, "delete", plan.orders, skip))
            else:
                rows = edit_candidates(current, kind, plan.orders, skip, plan.candidate_limit, plan.seed + step)
            row = best(scored(rows, now, target, scale), 1, "op_rank").first()
            if row is None:
                raise ValueError("no candidate is left")
        now = {k: now[k] + row[f"delta_m{k}"] for k in now}
        made.append((step, row["op"], row["u"], row["v"]))
        if kept and step < plan.budget:
            kept = kept.apply(None, spark.createDataFrame([(row["u"], row["v"])], pair_type), checked=True)
        # always from the first graph: the plan doesn't grow with the steps
        current = edited(graph, made)
    return made


def progressive(edges: np.ndarray, n: int, target: dict[int, float], steps: int, add_budget: int, delete_budget: int) -> list[tuple]:
    """Edits towards target * (t + 1) / steps in relative Euclidean distance, within caps on additions and deletions."""
    g, edits, done = SparseGraph(edges, n) if n > DENSE else SmallGraph(edges, n), [], set()
    first = g.moments((2, 3))
    scale = {k: max(abs(first[k]), 1e-12) for k in first}
    now, left = dict(first), {"add": add_budget, "delete": delete_budget}
    for t in range(steps):
        aim = {k: first[k] + (target[k] - first[k]) * (t + 1) / steps for k in first}
        choices = []
        for op in ("add", "delete"):
            if op == "add" and left[op] and isinstance(g, SparseGraph):
                found = g.best_addition(now, aim, scale, done)
                choices += [(found[0], op, *found[1:])] if found else []
                continue
            rows = g.pairs(op == "delete") if left[op] else np.zeros((0, 2), int)
            rows = rows[[(a, b) not in done for a, b in rows.tolist()]] if len(rows) else rows
            if len(rows):
                change = g.deltas(rows, (2, 3), op == "add")
                score = _distance(now, change, aim, scale)
                at = int(np.lexsort((rows[:, 1], rows[:, 0], score))[0])
                choices.append((float(score[at]), op, int(rows[at, 0]), int(rows[at, 1]), {k: float(x[at]) for k, x in change.items()}))
        if not choices:
            break
        _, op, u, v, change = min(choices, key=lambda c: c[:4])
        left[op] -= 1
        done.add((u, v))
        g.edit(u, v, op == "add")
        now = {k: now[k] + change[k] for k in now}
        edits.append((t + 1, op, u, v))
    return edits


def progressive_jobs(graph: Graph, target: dict[int, float], steps: int, add_budget: int, delete_budget: int) -> list[tuple]:
    """The same path as jobs: the best addition without the complement, the best deletion of all edges."""
    first = compute_moments(graph, (2, 3))
    scale = {k: max(abs(first[k]), 1e-12) for k in first}
    now, left, made, current, spark = dict(first), {"add": add_budget, "delete": delete_budget}, [], graph, graph.spark
    for t in range(steps):
        aim = {k: first[k] + (target[k] - first[k]) * (t + 1) / steps for k in first}
        skip = spark.createDataFrame([(u, v) for _, _, u, v in made], "u long, v long")
        found = []
        if left["add"]:
            found += scored(best_addition(current, now, aim, scale, skip).withColumn("op", F.lit("add")), now, aim, scale).select("*", F.round(F.sqrt("score"), DIGITS).alias("root")).collect()  # one row
        if left["delete"]:
            found += best(scored(edit_candidates(current, "delete", (2, 3), skip), now, aim, scale)).select("*", F.round(F.sqrt("score"), DIGITS).alias("root")).collect()  # one row
        if not found:
            break
        row = min(found, key=lambda r: (r["root"], r["op"], r["u"], r["v"]))
        left[row["op"]] -= 1
        now = {k: now[k] + row[f"delta_m{k}"] for k in now}
        made.append((t + 1, row["op"], row["u"], row["v"]))
        current = edited(graph, made)
    return made


__all__ = ["Plan", "SamplingResult", "SmallGraph", "apply_edits", "best", "deletion_deltas", "directional", "progressive", "ray_constrained", "run_grouped", "run_small", "sample_by_moments", "scored", "std_scale", "target_grid"]
