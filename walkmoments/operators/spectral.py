"""Components, Laplacians, effective resistance, spectra, and diffusion weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, jacobi, solvers, stats
from .graph import Graph, arcs, run_pairs
from .lineage import cut, written
from .moments import average_neighbour_inverse_degree, powers, product, symmetric, weighted_clustering


def components(graph: Graph, rounds: int = 60) -> DataFrame:
    """id, component (least id) of every node: labels spread to neighbours, then jump to their label's label.

    Each round is checkpointed to the shared folder of the session, so plans stay short and survive
    lost executors.
    """
    near = arcs(graph.edges)
    state = graph.nodes().select("id", F.col("id").alias("component"))
    before = None
    for _ in range(rounds):
        offered = near.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("low"))
        least = state.join(offered, "id", "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("up"))
        state = least.join(jump, "component").select("id", F.col("up").alias("component"))
        state = cut(state)
        total = state.agg(F.sum("component")).first()[0]
        if total == before:
            break
        before = total
    else:
        raise RuntimeError("components did not converge")
    return state


def laplacian(edges: DataFrame, weight: str | None = None, normalized: bool = False) -> DataFrame:
    """i, j, w of D - A, or of D^-1/2 (D - A) D^-1/2; nodes without edges have no entries."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = edges.select("u", "v", w.cast("double").alias("w"))
    both = rows.select(F.col("u").alias("i"), F.col("v").alias("j"), "w").unionByName(rows.select(F.col("v").alias("i"), F.col("u").alias("j"), "w"))
    size = both.groupBy("i").agg(F.sum("w").alias("d"))
    off = both.select("i", "j", (-F.col("w")).alias("w"))
    diagonal = size.select("i", F.col("i").alias("j"), F.col("d").alias("w"))
    if not normalized:
        return off.unionByName(diagonal)
    scale = size.select("i", (1.0 / F.sqrt("d")).alias("s"))
    whole = off.unionByName(diagonal).join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    return whole.select("i", "j", (F.col("w") * F.col("s") * F.col("t")).alias("w"))


def _weights(edges: DataFrame) -> DataFrame:
    return edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))


#: Components of up to so many nodes are solved densely, each a bounded matrix in one task; larger ones by conjugate gradients.
DENSE = 256


def resistances(
    edges: DataFrame, comps: DataFrame, normalized: bool = False, approximate: bool = False, epsilon: float = 0.3, seed: int = 0, gaussian: bool = False, dense_up_to: int = DENSE
) -> DataFrame:
    """u, v, w, resistance, leverage of every edge; ``comps`` are the nodes' components, id and component.

    Exact: the pseudo-inverse of small components, and solves of large ones (solvers.exact_resistances), which
    agree to about 1e-9. Approximate: ceil(24 ln n / eps^2) projections of the edges, random signs or
    (``gaussian``) normal numbers, each solved (solvers.projected_resistances), whatever the component's size.

    ``normalized`` asks for a^T N^+ a with N = D^-1/2 L D^-1/2 and a = D^-1/2 b of an edge's vector b. With
    L x = b, D^1/2 x solves N y = a, so a^T N^+ a = b^T x = b^T L^+ b: the same number, and the same code.

    Repeated pairs are one edge each; nodes without edges have no rows; an empty table gives an empty one.
    """
    rows = written(_weights(edges).select("u", "v", F.col("w").cast("double").alias("w")), "resistance-edges")
    size = comps.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    kind = "u long, v long, w double, resistance double, leverage double"
    if rows.isEmpty():
        return edges.sparkSession.createDataFrame([], kind)
    if approximate:
        columns = math.ceil(24 * math.log(max(size["n"], 2)) / epsilon**2)
        found = solvers.projected_resistances(rows, size["last"] + 1, columns, seed, gaussian)
        return found.select("u", "v", "w", "resistance", (F.col("w") * F.col("resistance")).alias("leverage"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["u", "v"])
        ids = np.unique(part[["u", "v"]].to_numpy())
        u, v, w = np.searchsorted(ids, part.u), np.searchsorted(ids, part.v), part.w.to_numpy()
        lap = np.zeros((len(ids), len(ids)))
        np.add.at(lap, (u, v), -w)
        np.add.at(lap, (v, u), -w)
        lap[np.arange(len(ids)), np.arange(len(ids))] = -lap.sum(1)
        inverse = np.linalg.pinv(lap, hermitian=True)
        r = np.maximum(inverse[u, u] + inverse[v, v] - 2 * inverse[u, v], 0)
        return pd.DataFrame({"u": part.u, "v": part.v, "w": w, "resistance": r, "leverage": r * w})

    sizes = comps.groupBy("component").agg((F.count("*") > dense_up_to).alias("large"))
    labelled = written(rows.join(comps.select(F.col("id").alias("u"), "component"), "u").join(sizes, "component").select("u", "v", "w", "component", "large"), "resistance-parts")
    found = labelled.filter(~F.col("large")).groupBy("component").applyInPandas(lambda p: solve(p), kind)
    large = labelled.filter("large").select("u", "v", "w")
    if large.isEmpty():
        return found
    hung, large = _without_leaves(large)
    for edge in hung:  # the only way to its leaf
        found = found.unionByName(edge.select("u", "v", "w", (1.0 / F.col("w")).alias("resistance"), F.lit(1.0).alias("leverage")))
    if large.isEmpty():
        return found
    if hung:  # a component's least node may be a leaf that is gone
        left = large.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(comps, "id")
        comps = written(left.join(left.groupBy("component").agg(F.min("id").alias("root")), "component").select("id", F.col("root").alias("component")), "resistance-roots")
    exact = solvers.exact_resistances(large, comps, size["last"] + 1)
    return found.unionByName(exact.select("u", "v", "w", "resistance", (F.col("w") * F.col("resistance")).alias("leverage")))


#: Rounds of taking leaves off before the rest is solved.
PEELED = 8


def _without_leaves(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(edges to leaves, round by round; the other edges): an edge to a leaf carries no current but its own, and no other one's resistance depends on it."""
    hung = []
    for _ in range(PEELED):
        ends = rows.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("times"))
        leaves = written(ends.filter("times = 1").select("id", F.lit(True).alias("leaf")), "resistance-leaves")
        if leaves.isEmpty():
            break
        marked = rows
        for e in "uv":
            marked = marked.join(leaves.select(F.col("id").alias(e), F.col("leaf").alias(f"leaf_{e}")), e, "left")
        marked = written(marked.select("u", "v", "w", (F.col("leaf_u").isNotNull() | F.col("leaf_v").isNotNull()).alias("leaf")), "resistance-peeled")
        hung.append(marked.filter("leaf").select("u", "v", "w"))
        rows = marked.filter("not leaf").select("u", "v", "w")
        if rows.isEmpty():
            break
    return hung, rows


def probabilities(rows: DataFrame) -> DataFrame:
    """Adds prob: leverage over its sum, or uniform where the sum vanishes."""
    total = rows.agg(F.sum("leverage").alias("__t"), F.count("*").alias("__n"))
    share = F.when(F.col("__t") <= 1e-15, 1.0 / F.col("__n")).otherwise(F.col("leverage") / F.col("__t"))
    return rows.join(F.broadcast(total)).withColumn("prob", share).drop("__t", "__n")


def spectrum(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """graph_id, eigenvalues (ascending, of the normalized adjacency), m2, m3, m4 of each graph.

    ``edges`` has graph_id, u, v; ``sizes`` graph_id, n. One dense solve a graph, graphs side by side.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part.n.iloc[0])
        a = np.zeros((n, n))
        known = part.dropna(subset=["u"])
        u, v = known.u.to_numpy(int), known.v.to_numpy(int)
        a[u, v] = a[v, u] = 1
        d = a.sum(1)
        s = np.divide(1, np.sqrt(d), out=np.zeros(n), where=d > 0)
        a *= s[:, None]
        a *= s
        values = np.linalg.eigvalsh(a)
        return pd.DataFrame({"graph_id": [part.graph_id.iloc[0]], "eigenvalues": [values.tolist()], **{f"m{k}": [float((values**k).mean())] for k in (2, 3, 4)}})

    return sizes.join(edges, "graph_id", "left").groupBy("graph_id").applyInPandas(solve, "graph_id long, eigenvalues array<double>, m2 double, m3 double, m4 double")


#: Nodes of a graph whose dense matrix (and its copy) one task holds where all eigenvalues are asked for.
ONE_TASK = 10_000


def whole_spectrum(graph: Graph, graph_id: int = 0) -> DataFrame:
    """The row of :func:`spectrum` for one graph of any size: beyond ``ONE_TASK`` nodes by blocks of columns (jacobi.eigenvalues)."""
    spark = graph.spark
    if graph.n <= ONE_TASK:
        edges = graph.edges.select(F.lit(graph_id).cast("long").alias("graph_id"), "u", "v")
        return spectrum(edges, spark.createDataFrame([(graph_id, graph.n)], "graph_id long, n long"))
    each = [F.avg(F.pow("value", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)]
    found = jacobi.eigenvalues(graph).agg(F.sort_array(F.collect_list("value")).alias("eigenvalues"), *each)
    return found.select(F.lit(graph_id).cast("long").alias("graph_id"), "eigenvalues", "m2", "m3", "m4")


#: Graphs of more nodes have no dense spectrum in a task; their moments are traces.
DENSE_SPECTRUM = 4096


def spectrum_traces(graph: Graph, graph_id: int = 0) -> DataFrame:
    """graph_id, m2, m3, m4 of one graph without its eigenvalues: their power sums are traces of walk powers, of any size."""
    from .moments import moment_rows

    each = [F.sum(F.when(F.col("k") == k, F.col("m"))).alias(f"m{k}") for k in (2, 3, 4)]
    return moment_rows(graph, (2, 3, 4)).agg(*each).select(F.lit(graph_id).cast("long").alias("graph_id"), "m2", "m3", "m4")


def spectrum_ends(graph: Graph, k: int) -> DataFrame:
    """smallest, largest, residual: the ``k`` least and greatest eigenvalues of a graph (all, if fewer), ascending, by block Lanczos.

    In one task where it may hold the arcs and a basis (blocks.spectrum_ends), else by jobs.
    """
    if blocks.fits_basis(graph.n, k):
        edges = written(graph.edges.select("u", "v"), "ends-edges")
        count = edges.count()
        if 0 < 2 * count <= blocks.ARCS:
            return cut(blocks.spectrum_ends(written(blocks.near_lists(arcs(edges)), "ends-lists"), graph.n, k))
    small, large, residual = solvers.spectrum_ends(graph, k)
    return graph.spark.createDataFrame([(small, large, residual)], "smallest array<double>, largest array<double>, residual double")


def spectrum_rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """graph_id, rmse of sorted eigenvalues of the same graphs in two tables."""
    rows = a.select("graph_id", F.col("eigenvalues").alias("x")).join(b.select("graph_id", F.col("eigenvalues").alias("y")), "graph_id")
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z)
    return rows.select("graph_id", F.sqrt(square / F.size("x")).alias("rmse"))


def estrada_index(graph: Graph) -> DataFrame:
    """One row: the mean of exp(eigenvalue) of the normalized adjacency, from its dense spectrum in one task."""
    edges = graph.edges.select(F.lit(0).cast("long").alias("graph_id"), "u", "v")
    values = spectrum(edges, graph.spark.createDataFrame([(0, graph.n)], "graph_id long, n long"))
    return values.select((F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + F.exp(x)) / F.size("eigenvalues")).alias("value"))


def estrada_series(graph: Graph, residual: float = 1e-9) -> DataFrame:
    """One row: the same as the sum of m_k / k! (m_0 = 1), without a dense spectrum.

    No m_k is beyond 1, so the terms left out add up to less than ``residual``.
    """
    from .moments import moment_rows

    terms = 2
    while 2.0 / math.factorial(terms) > residual:
        terms += 1

    factor = F.lit(1.0)
    for k in range(1, terms):
        factor = F.when(F.col("k") == k, F.lit(1.0 / math.factorial(k))).otherwise(factor)
    rows = moment_rows(graph, range(1, terms))
    return rows.agg((F.lit(1.0) + F.sum(F.col("m") * factor)).alias("value"))


METRICS = ("average_neighbour_inverse_degree", "weighted_clustering", "m2", "m3")


def property_snapshot(graph: Graph, metrics=METRICS) -> DataFrame:
    """metric, value: only what is asked for is computed, all moments at once."""
    from .moments import moment_rows

    out = None
    wanted = [m for m in metrics if m in ("m2", "m3", "m4")]
    if len(wanted) > 1:
        found = moment_rows(graph, [int(m[1:]) for m in wanted]).select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("metric"), F.col("m").alias("value"))
        out, metrics = found, [m for m in metrics if m not in wanted]
    for name in metrics:
        if name == "average_neighbour_inverse_degree":
            row = average_neighbour_inverse_degree(graph)
        elif name == "weighted_clustering":
            row = weighted_clustering(graph).agg(F.avg("c").alias("value"))
        elif name in ("m2", "m3", "m4"):
            row = moment_rows(graph, [int(name[1:])]).select(F.col("m").alias("value"))
        elif name == "estrada":
            row = estrada_index(graph)
        else:
            raise ValueError(f"unknown metric {name!r}")
        row = row.select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def property_distances(a: Graph, b: Graph, metrics=METRICS) -> DataFrame:
    """metric, distance: absolute difference of each metric between two graphs."""
    return _distances(property_snapshot(a, metrics), property_snapshot(b, metrics))


def _distances(one: DataFrame, two: DataFrame) -> DataFrame:
    rows = one.withColumnRenamed("value", "x").join(two.withColumnRenamed("value", "y"), "metric")
    return rows.select("metric", F.abs(F.col("x") - F.col("y")).alias("distance"))


def spectral_greedy(graph: Graph, budget: int) -> DataFrame:
    """step, u, v, rmse: each step deletes the edge that keeps the spectrum nearest the first one's.

    Every candidate's dense spectrum is a task of its own within a step; for small graphs.
    """
    spark, n = graph.spark, graph.n
    pairs = sorted((r["u"], r["v"]) for r in graph.edges.collect())  # one dense matrix holds the graph anyway

    def eigenvalues(edges: np.ndarray) -> np.ndarray:
        a = np.zeros((n, n))
        a[edges[:, 0], edges[:, 1]] = a[edges[:, 1], edges[:, 0]] = 1
        d = a.sum(1)
        s = np.divide(1, np.sqrt(d), out=np.zeros(n), where=d > 0)
        return np.linalg.eigvalsh(a * s[:, None] * s[None, :])

    start, made = eigenvalues(np.array(pairs)), []
    for step in range(1, budget + 1):
        held = np.array(pairs)

        def tried(batches, held=held):
            for part in batches:
                found = [float(np.sqrt(np.mean((eigenvalues(held[(held != (u, v)).any(1)]) - start) ** 2))) for u, v in zip(part.u, part.v)]
                yield part.assign(rmse=np.round(found, 12))

        rows = spark.createDataFrame([(int(u), int(v)) for u, v in pairs], "u long, v long").repartition(spark.sparkContext.defaultParallelism)
        best = rows.mapInPandas(tried, "u long, v long, rmse double").orderBy("rmse", "u", "v").first()
        made.append((step, best["u"], best["v"], best["rmse"]))
        pairs.remove((best["u"], best["v"]))
    return spark.createDataFrame(made, "step int, u long, v long, rmse double")


def pagerank(graph: Graph, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """id, x after rounds of x = (1 - d) x + d * sum over arcs of x / degree, from 1; isolated nodes only decay."""
    deg = stats.degrees(graph)
    near = graph.arcs()
    # each round reads the state twice, so plans would double without a cut
    state = graph.nodes().select("id", F.lit(1.0).alias("x"))
    for _ in range(rounds):
        share = state.join(deg, "id").select(F.col("id").alias("src"), (F.col("x") / F.col("d")).alias("y"))
        flow = near.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("y").alias("f"))
        state = state.join(flow, "id", "left").select("id", ((1 - damping) * F.col("x") + damping * F.coalesce("f", F.lit(0.0))).alias("x"))
        state = cut(state)
    return state


def arc_weights(graph: Graph, scores: DataFrame, score: str) -> DataFrame:
    """src, dst, w = (max - s) / (max - mean) of s, the logarithm of the score of dst."""
    rows = graph.arcs().join(scores.select(F.col("id").alias("dst"), F.log(score).alias("s")), "dst")
    whole = rows.agg(F.max("s").alias("hi"), F.avg("s").alias("mid"))
    return rows.join(F.broadcast(whole)).select("src", "dst", F.coalesce(F.try_divide(F.col("hi") - F.col("s"), F.col("hi") - F.col("mid")), F.lit(0.0)).alias("w"))


def looped_normalized(graph: Graph) -> DataFrame:
    """i, j, w of (D + I)^-1/2 (A + I) (D + I)^-1/2 over all nodes."""
    deg = stats.all_degrees(graph).select("id", (F.col("d") + 1.0).alias("d"))
    loops = deg.select(F.col("id").alias("i"), F.col("id").alias("j"))
    pairs = graph.arcs().select(F.col("src").alias("i"), F.col("dst").alias("j")).unionByName(loops)
    ends = pairs.join(deg.select(F.col("id").alias("i"), F.col("d").alias("x")), "i").join(deg.select(F.col("id").alias("j"), F.col("d").alias("y")), "j")
    return ends.select("i", "j", (1.0 / F.sqrt(F.col("x") * F.col("y"))).alias("w"))


def markov_diffusion(graph: Graph, degree: int = 3, alpha: float = 0.05, least: float = 1e-4) -> DataFrame:
    """i, j, w of (sum of T^t for t = 0..degree) / degree + alpha T, entries of at least ``least``; T has self-loops."""
    edges = cut(graph.edges)
    if least > 0 and graph.n < 1 << 31 and 2 * edges.count() + graph.n <= blocks.ARCS:
        loops = graph.nodes().select(F.col("id").alias("src"), F.col("id").alias("dst"))
        weights = [1.0 / degree] * (degree + 1)
        weights[1] += alpha
        return blocks.walk_rows(cut(blocks.near_lists(arcs(edges).unionByName(loops))), graph.n, tuple(weights), least)
    base = cut(looped_normalized(graph))
    total = graph.nodes().select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0 / degree).alias("w"))
    walk = base
    for t in range(1, degree + 1):
        walk = walk if t == 1 else cut(product(walk, base))
        total = total.unionByName(walk.select("i", "j", (F.col("w") / degree).alias("w")))
    total = total.unionByName(base.select("i", "j", (alpha * F.col("w")).alias("w")))
    return total.groupBy("i", "j").agg(F.sum("w").alias("w")).filter(F.col("w") >= least)


def heat_kernel(graph: Graph, t: float = 5.0, self_loop: bool = True) -> DataFrame:
    """i, j, w = exp(t (a_ij / d_j - 1)) of every pair of nodes, elementwise, by default with self-loops.

    Quadratic in n by definition. Only the entries of arcs (and loops) meet degrees; all others are exp(-t), and made in
    place from the gaps beside these, so no pair is shuffled.
    """
    extra = 1.0 if self_loop else 0.0
    deg = stats.all_degrees(graph).select(F.col("id").alias("j"), (F.col("d") + extra).alias("d"))
    near = graph.arcs().select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("a"))
    if self_loop:
        near = near.unionByName(graph.nodes().select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("a")))
    held = near.join(deg, "j").select("i", "j", F.exp(t * (F.col("a") / F.col("d") - 1.0)).alias("w"))
    marks = near.select("i", "j").unionByName(graph.nodes().select(F.col("id").alias("i"), F.lit(graph.n).cast("long").alias("j")))
    before = F.coalesce(F.lag("j").over(Window.partitionBy("i").orderBy("j")), F.lit(-1))
    runs = marks.select(F.col("i").alias("u"), (before + 1).alias("low"), (F.col("j") - 1).alias("high")).filter("low <= high")
    apart = run_pairs(runs, graph.n).select(F.col("u").alias("i"), F.col("v").alias("j"), F.exp(F.lit(-float(t))).alias("w"))
    return apart.unionByName(held)


def _looped_lists(graph: Graph) -> DataFrame | None:
    """id, near with loops of every node, written, where a task may hold them all."""
    edges = written(graph.edges.select("u", "v"), "looped-edges")
    if graph.n >= 1 << 31 or 2 * edges.count() + graph.n > blocks.ARCS:
        return None
    loops = graph.nodes().select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return written(blocks.near_lists(arcs(edges).unionByName(loops)), "looped-lists")


def ppr_matrix(graph: Graph, alpha: float = 0.2) -> DataFrame:
    """i, j, w: every entry of alpha (I - (1 - alpha) T)^-1 within components, T with self-loops.

    Solved by columns (solvers.inverse_rows) to a relative residual of 1e-12: quadratic in the nodes of a
    component, as the matrix is, but no component meets in a task. Entries between components are 0 and left
    out, and so may be those below 1e-13.
    """
    rows = written(looped_normalized(graph), "ppr-walk")
    diagonal = rows.filter("i = j").select(F.col("i").alias("id"), (1.0 - (1 - alpha) * F.col("w")).alias("d"))
    arcs = rows.filter("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"), ((1 - alpha) * F.col("w")).alias("w"))
    return solvers.inverse_rows(solvers.System(diagonal, arcs), graph.n, alpha)


def ppr_push(graph: Graph, alpha: float = 0.2, epsilon: float = 1e-6, sources: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """i, j, w: the same entries by forward push, as lower bounds; the least are left out.

    With D of the degrees plus one, T^t = D^1/2 P^t D^-1/2 for the walk P, so an entry is sqrt(d_i / d_j) times
    the pushed number, and misses at most ``epsilon`` * sqrt(d_i d_j). ``sources``: ids of rows i, by default all.

    Sources are pushed one at a time in blocks (blocks.push_rows), so no residual is shuffled or written; graphs of more
    than blocks.ARCS arcs push by joins.
    """
    lists = _looped_lists(graph)
    if lists is not None:
        lit = F.lit(True).alias("asked")
        asked = lists.select("*", lit) if sources is None else lists.join(sources.select("id", lit).distinct(), "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        return blocks.push_rows(asked, graph.n, alpha, epsilon, rounds)
    loops = graph.nodes().select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    near = graph.arcs().select("src", "dst", F.lit(1.0).alias("w")).unionByName(loops)
    pushed, _ = solvers.push_pagerank(near, graph.nodes() if sources is None else sources.select("id").distinct(), alpha, epsilon, rounds)
    deg = stats.all_degrees(graph).select("id", (F.col("d") + 1.0).alias("d"))
    ends = pushed.join(deg.select(F.col("id").alias("i"), F.col("d").alias("x")), "i").join(deg.select(F.col("id").alias("j"), F.col("d").alias("y")), "j")
    return ends.select("i", "j", (F.col("w") * F.sqrt(F.col("x") / F.col("y"))).alias("w"))


def ppr_diffusion(graph: Graph, alpha: float = 0.2, least: float = 1e-4) -> DataFrame:
    """i, j, w: personalised PageRank, entries of at least ``least``, rows renormalised.

    A row is made, cut and renormalised in place (blocks.pagerank_rows); graphs of more than blocks.ARCS arcs take the solver by joins.
    """
    lists = _looped_lists(graph) if least > 0 else None
    if lists is not None:
        return blocks.pagerank_rows(lists, graph.n, alpha, least, shares=True)
    rows = ppr_matrix(graph, alpha).filter(F.col("w") >= least)
    return rows.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i")))


def coalesce_arcs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def sparsify_to_degree(rows: DataFrame, n: int, average: float, epsilons=(1e-5, 1e-4, 1e-3, 1e-2)) -> DataFrame:
    """Rows (i, j, w) of at least the epsilon whose mean degree is nearest ``average``, w scaled to [0, 1] per j."""
    counts = rows.agg(*[F.count_if(F.col("w") >= e).alias(str(k)) for k, e in enumerate(epsilons)]).first()
    return _stretched(rows.filter(F.col("w") >= _nearest_epsilon(list(counts), n, average, epsilons)))


def sparsified_ppr(graph: Graph, average: float, alpha: float = 0.2, epsilons=(1e-5, 1e-4, 1e-3, 1e-2)) -> DataFrame:
    """:func:`sparsify_to_degree` of :func:`ppr_matrix`: rows are made once to be counted and once more to be kept, so none below the epsilon is written."""
    lists = _looped_lists(graph)
    if lists is None:
        return sparsify_to_degree(ppr_matrix(graph, alpha), graph.n, average, epsilons)
    least = _nearest_epsilon(blocks.pagerank_counts(lists, graph.n, alpha, epsilons), graph.n, average, epsilons)
    return _stretched(written(blocks.pagerank_rows(lists, graph.n, alpha, least), "ppr-kept"))


def _nearest_epsilon(counts: list[int], n: int, average: float, epsilons) -> float:
    return epsilons[min(range(len(epsilons)), key=lambda k: (abs(counts[k] / n - average), k))]


def _stretched(kept: DataFrame) -> DataFrame:
    ends = kept.groupBy("j").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return kept.join(ends, "j").select("i", "j", F.coalesce(F.try_divide(F.col("w") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("w"))


def feature_weights(features: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """feature, w = (max - s) / (max - mean) of s, the logarithm of the score-weighted feature sum."""
    rows = features.join(scores.select("id", F.col(score).alias("c")), "id").groupBy("feature").agg(F.log(F.sum(F.col("x") * F.col("c"))).alias("s"))
    whole = rows.agg(F.max("s").alias("hi"), F.avg("s").alias("mid"))
    return rows.join(F.broadcast(whole)).select("feature", F.coalesce(F.try_divide(F.col("hi") - F.col("s"), F.col("hi") - F.col("mid")), F.lit(0.0)).alias("w"))


def eigenvector_centrality(graph: Graph, residual: float = 1e-9, rounds: int = 500) -> DataFrame:
    """id, x: power iteration on A + I, scaled to unit length each round, until no entry moves by more than ``residual``."""
    state = graph.nodes().select("id", F.lit(1.0).alias("x"))
    near = graph.arcs()
    for _ in range(rounds):
        flow = near.join(state.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("f"))
        raw = state.join(flow, "id", "left").select("id", F.col("x").alias("old"), (F.col("x") + F.coalesce("f", F.lit(0.0))).alias("x"))
        size = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s"))
        state = cut(raw.join(F.broadcast(size)).select("id", "old", (F.col("x") / F.col("s")).alias("x")))
        if (state.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0) <= residual:
            return state.select("id", "x")
    raise RuntimeError("the iteration did not come to rest")


__all__ = ["powers", "symmetric"]
