"""Graphs as edge tables: canonical forms, validation, filters and set operations.

An edge table has u and v with u < v, each pair once; n counts nodes 0..n-1, isolated ones included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Graph:
    edges: DataFrame
    n: int

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def nodes(self) -> DataFrame:
        return self.spark.range(self.n)

    def arcs(self) -> DataFrame:
        return arcs(self.edges)

    def cached(self) -> Graph:
        return Graph(self.edges.cache(), self.n)


def pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")]


def simple_edges(rows: DataFrame) -> DataFrame:
    """Lenient: endpoints sorted, loops and rows with a null dropped, directions and repeats collapsed."""
    found = rows.select(*pair(F.col("u"), F.col("v"))).filter("u <> v")
    return found.distinct()


def node_count(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError("the number of nodes must be a positive integer")
    return n


def canonical(rows: DataFrame, n: int) -> Graph:
    """Strict: raises on non-integer ids, ids outside 0..n-1, loops, nulls and repeated pairs.

    One aggregation checks everything before the call returns.
    """
    node_count(n)
    kinds = dict(rows.dtypes)
    if not {"u", "v"} <= kinds.keys() or any(kinds[c] not in ("tinyint", "smallint", "int", "bigint") for c in "uv"):
        raise ValueError("edges need integer columns u and v")
    edges = rows.select(*pair(F.col("u"), F.col("v")))
    checked = rows.select(*pair(F.col("u"), F.col("v")), (F.col("u").isNull() | F.col("v").isNull()).alias("gap"))
    found = checked.groupBy("u", "v").agg(F.count("*").alias("times"), F.max("gap").alias("gap"))
    bad = found.agg(
        F.count_if("gap").alias("nulls"), F.count_if(F.expr("u = v")).alias("loops"), F.count_if(F.expr("times > 1 and not gap")).alias("repeats"), F.min("u").alias("low"), F.max("v").alias("high")
    ).first()
    if bad["nulls"]:
        raise ValueError("edges hold nulls")
    if bad["low"] is not None and (bad["low"] < 0 or bad["high"] >= n):
        raise ValueError(f"node ids must lie in 0..{n - 1}")
    if bad["loops"]:
        raise ValueError("edges hold self-loops")
    if bad["repeats"]:
        raise ValueError("edges hold repeated pairs")
    return Graph(edges, n)


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: src, dst."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))


#: Pairs that a run is cut into pieces of, and pairs that one task makes.
PIECE, TASK = 4096, 1 << 21


def gaps(graph: Graph, taken: DataFrame | None = None) -> DataFrame:
    """u, low, high: the runs of ids beyond u, up to the last node, that are not paired with u in ``taken`` (u, v; default: the edges)."""
    pairs = (graph.edges if taken is None else taken).select("u", "v")
    marks = pairs.unionByName(graph.nodes().select(F.col("id").alias("u"), F.lit(graph.n).cast("long").alias("v")))
    before = F.lag("v").over(Window.partitionBy("u").orderBy("v"))
    return marks.select("u", (F.coalesce(before, "u") + 1).alias("low"), (F.col("v") - 1).alias("high")).filter("low <= high")


def run_pairs(runs: DataFrame, n: int, *columns: str) -> DataFrame:
    """The pairs u, v of runs (u, low, high), with further columns of the runs.

    Runs are cut into pieces and dealt to a number of tasks that follows n^2, as Spark cannot know how many pairs
    they stand for; the pairs themselves are made in place and shuffled nowhere.
    """
    tasks = min(2048, n * n // (2 * TASK) + 1)
    piece = F.explode(F.sequence("low", "high", F.lit(PIECE).cast("long")))
    pieces = runs.select("u", piece.alias("start"), "high", *columns).repartition(tasks, "u", "start")
    return pieces.select("u", F.explode(F.sequence("start", F.least(F.col("start") + (PIECE - 1), "high"))).alias("v"), *columns)


def complement(graph: Graph) -> DataFrame:
    """All pairs u < v that are no edges. Quadratic in n by definition; made in place from the gaps between neighbours."""
    return run_pairs(gaps(graph), graph.n)


def first_non_edges(graph: Graph, size: int) -> DataFrame:
    """The first ``size`` pairs of the complement by u, v (all, if fewer), from as many gaps: linear in nodes and edges."""
    runs = gaps(graph).orderBy("u", "low").limit(size)
    pairs = runs.select("u", F.explode(F.sequence("low", F.least("high", F.col("low") + (size - 1)))).alias("v"))
    return pairs.orderBy("u", "v").limit(size)


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Adds <column>_u and <column>_v from a table keyed by id."""
    out = edges
    for end in "uv":
        side = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        out = out.join(side, end)
    return out.select(*edges.columns, *[f"{c}_{end}" for c in columns for end in "uv"])


def deletable(edges: DataFrame, nodes: DataFrame, same_label_only: bool = False, protect_same_label: bool = False, protect_train_same_label: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """Edges that may be deleted, by labels (and train marks) of their ends and an optional whitelist."""
    rows = with_ends(edges, nodes, *(["label", "train"] if protect_train_same_label else ["label"]))
    same = F.col("label_u") == F.col("label_v")
    if same_label_only:
        rows = rows.filter(same)
    if protect_same_label:
        rows = rows.filter(~same)
    if protect_train_same_label:
        rows = rows.filter(~(same & F.col("train_u") & F.col("train_v")))
    rows = rows.select("u", "v")
    return rows.join(allowed, ["u", "v"], "left_semi") if allowed is not None else rows


def addable(pairs: DataFrame, nodes: DataFrame, same_label_only: bool = False, diff_label_only: bool = False) -> DataFrame:
    """Non-edges that may be added, by labels of their ends. There may be n^2 of them, so the labels of the n nodes go to the pairs."""
    rows = with_ends(pairs, F.broadcast(nodes.select("id", "label")), "label")
    same = F.col("label_u") == F.col("label_v")
    if same_label_only:
        rows = rows.filter(same)
    if diff_label_only:
        rows = rows.filter(~same)
    return rows.select("u", "v")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the ids of ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")


def drop_edges(edges: DataFrame, keep: Column) -> DataFrame:
    return edges.filter(keep).select("u", "v")


def require_members(candidates: DataFrame, edges: DataFrame, present: bool) -> DataFrame:
    """Canonical candidates; raises unless each is an edge (``present``) or none is, and none repeats."""
    rows = candidates.select(*pair(F.col("u"), F.col("v")))
    marked = rows.groupBy("u", "v").agg(F.count("*").alias("times")).join(edges.select("u", "v", F.lit(True).alias("held")), ["u", "v"], "left")
    bad = marked.agg(F.count_if(F.expr("times > 1")).alias("repeats"), F.count_if(F.expr("u = v")).alias("loops"), F.count_if(F.col("held").isNull()).alias("absent"), F.count("held").alias("held")).first()
    if bad["repeats"] or bad["loops"]:
        raise ValueError("candidates repeat or are loops")
    if present and bad["absent"]:
        raise ValueError("candidates for deletion must be edges")
    if not present and bad["held"]:
        raise ValueError("candidates for addition must not be edges")
    return rows
