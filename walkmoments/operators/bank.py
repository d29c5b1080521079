"""A bank of edited graphs around target points, grown in waves and resumed after a loss.

Each run, a (target, bank number), is a trajectory in one task, with a seed that follows from both numbers; runs lie
side by side. A wave of runs is written to a folder of its own and then named in the manifest, by one rename: what a
killed job left half written is never read, and the next call does only the runs that no committed wave has.

A bank is made for one graph, operation, candidate limit and seed, and each target keeps its moments and budgets; a
call that differs in any of these raises, as does a smaller size than the bank has. More targets or a greater size
add runs and leave the others as they are. Of two callers at once, the later to commit raises.

Graphs of more than MOST_NODES nodes have no dense matrix: with a candidate limit a run is neighbour lists in a task,
deletions without one are an edge table there (of search.TASK_ARCS arcs at most), and all other runs have jobs as steps;
as nothing is drawn without a limit, runs of one target are alike, and a wave of jobs makes them once.

Defined results: targets that repeat an id, null ids, budgets or moments that are null or not finite, and an empty graph
raise before any run; a budget of 0 gives a run without edits.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .graph import Graph
from .lineage import written
from .moments import compute_moments
from .search import TASK_ARCS, Plan, edited, run_relational, run_small

#: A run's dense matrix has so many rows at most (search.DENSE is the kernel's own bound).
MOST_NODES = 4096
STRIDE = 1_000_003  # fixed value: bank numbers of one target have seeds that follow each other, targets lie so far apart
POINT = ("target_m2", "target_m3", "add_budget", "delete_budget", "total_budget")
RUNS = "target_id long, bank_id int, seed long, point string, m2 double, m3 double, target_distance double, add_count int, delete_count int, edits array<struct<step:int,op:string,u:long,v:long>>"
KERNEL = "run_id int, m2 double, m3 double, target_distance double, ops array<string>, us array<long>, vs array<long>"


def _settings(graph: Graph, operation: str, candidate_limit: int | None, seed: int) -> dict:
    found = graph.edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).cast("string").alias("h")).first()
    return {"version": 1, "nodes": graph.n, "edges": found["n"], "edge_hash": found["h"], "operation": operation, "candidate_limit": candidate_limit, "seed": seed}


def _checked(points: DataFrame) -> DataFrame:
    """``points`` with the settings of each as a string ``point``."""
    bad = F.col("target_id").isNull() | (F.col("target_id") < 0)
    for c in POINT:
        value = F.col(c).cast("double")
        bad = bad | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        if c.endswith("budget"):
            bad = bad | (value < 0)
    if not points.filter(bad).isEmpty():
        raise ValueError("targets need non-negative ids and budgets, and finite moments")
    if not points.groupBy("target_id").count().filter("count > 1").isEmpty():
        raise ValueError("a target id repeats")
    return points.select(F.col("target_id").cast("long").alias("target_id"), *POINT, F.to_json(F.struct(*POINT)).alias("point"))


def read_bank(graph: Graph, folder: str) -> DataFrame:
    """All committed runs: target_id, bank_id, seed, point, m2, m3, target_distance, add_count, delete_count, edits."""
    manifest = f"{folder}/manifest.json"
    parts = json.loads(store.read_text(manifest))["parts"] if store.exists(manifest) else []
    if not parts:
        return graph.spark.createDataFrame([], RUNS)
    return graph.spark.read.schema(RUNS).parquet(*[f"{folder}/{p}" for p in parts])


def grow_bank(
    graph: Graph, points: DataFrame, folder: str, size: int, *, operation: str = "mixed", candidate_limit: int | None = None, seed: int = 0, wave: int = 64
) -> DataFrame:
    """The bank in ``folder`` with ``size`` runs for each of ``points`` (search.prepare_points), made where they are missing.

    A driver holds one wave at a time; a lost one costs at most a wave.
    """
    for name, x in (("size", size), ("wave", wave)):
        if isinstance(x, bool) or not isinstance(x, int) or x < 1:
            raise ValueError(f"{name} must be a positive integer")
    if operation not in ("mixed", "delete", "add") or (candidate_limit is not None and candidate_limit < 1):
        raise ValueError("operation must be mixed, delete or add, and candidate_limit positive")
    settings = _settings(graph, operation, candidate_limit, seed)
    if not settings["edges"]:
        raise ValueError("a bank needs a graph with edges")
    points, manifest = _checked(points), f"{folder}/manifest.json"
    if store.exists(manifest):
        held = json.loads(store.read_text(manifest))["settings"]
        other = sorted(k for k in settings if held.get(k) != settings[k])
        if other:
            raise ValueError(f"the bank in {folder} was made with another {', '.join(other)}")
    else:
        _commit(manifest, settings, [], None)
    done = read_bank(graph, folder)
    mine = done.select("target_id", "bank_id", F.col("point").alias("held")).join(points, "target_id")
    if not mine.filter("held != point").isEmpty():
        raise ValueError(f"the bank in {folder} has a target of the same id with other moments or budgets")
    if not mine.filter(F.col("bank_id") >= size).isEmpty():
        raise ValueError(f"the bank in {folder} is larger than {size}")
    jobs = points.withColumn("bank_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    while True:
        left = jobs.join(read_bank(graph, folder).select("target_id", "bank_id"), ["target_id", "bank_id"], "left_anti")
        now = left.orderBy("target_id", "bank_id").limit(wave).collect()
        if not now:
            return read_bank(graph, folder).join(points.select("target_id"), "target_id", "left_semi")
        parts = json.loads(store.read_text(manifest))["parts"]
        part = f"part-{uuid.uuid4().hex}"
        _runs(graph, now, operation, candidate_limit, seed).write.parquet(f"{folder}/{part}")
        _commit(manifest, settings, [*parts, part], parts)


def _commit(manifest: str, settings: dict, parts: list[str], before: list[str] | None) -> None:
    with store.locked(manifest):
        held = json.loads(store.read_text(manifest))["parts"] if store.exists(manifest) else None
        if held != before:
            raise RuntimeError(f"another job has changed {manifest}")
        store.write_text(json.dumps({"settings": settings, "parts": parts}), manifest)


def _runs(graph: Graph, wave: list, operation: str, candidate_limit: int | None, seed: int) -> DataFrame:
    n, plans = graph.n, {}
    for k, r in enumerate(wave):
        own = seed + (r["target_id"] + 1) * STRIDE + r["bank_id"]
        adds, deletes = int(r["add_budget"]), int(r["delete_budget"])
        budget = min(int(r["total_budget"]), {"mixed": adds + deletes, "add": adds, "delete": deletes}[operation])
        plans[k] = Plan(budget, (2, 3), {2: r["target_m2"], 3: r["target_m3"]}, operation=operation, candidate_limit=candidate_limit, seed=own, most_adds=adds, most_deletes=deletes)

    def kernel(key, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = rows[["u", "v"]].to_numpy(np.int64)
        plan = plans[int(key[0])]
        edits, first, last, _ = run_small(pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))], n, plan)
        off = [(last[k] - plan.target[k]) / (abs(first[k]) or 1.0) for k in (2, 3)]
        out = (int(key[0]), last[2], last[3], float(np.hypot(*off)), [e[1] for e in edits], [e[2] for e in edits], [e[3] for e in edits])
        return pd.DataFrame([out], columns=[c.split()[0] for c in KERNEL.split(", ")])

    if n > MOST_NODES and candidate_limit is None and (operation != "delete" or 2 * graph.edges.count() > TASK_ARCS):
        made = graph.spark.createDataFrame(_by_jobs(graph, plans), KERNEL)
    else:
        copies = graph.edges.select(F.explode(F.array(*[F.lit(k) for k in plans])).alias("run_id"), "u", "v")
        made = copies.groupBy("run_id").applyInPandas(kernel, KERNEL)
    named = graph.spark.createDataFrame([(k, r["target_id"], r["bank_id"], plans[k].seed, r["point"]) for k, r in enumerate(wave)], "run_id int, target_id long, bank_id int, seed long, point string")
    edits = F.transform(F.col("ops"), lambda op, k: F.struct((k + 1).cast("int").alias("step"), op.alias("op"), F.get("us", k).alias("u"), F.get("vs", k).alias("v")))

    def count(op: str):
        return F.size(F.filter("ops", lambda x: x == op)).cast("int").alias(f"{op}_count")

    return made.join(F.broadcast(named), "run_id").select("target_id", "bank_id", "seed", "point", "m2", "m3", "target_distance", count("add"), count("delete"), edits.alias("edits"))


def _by_jobs(graph: Graph, plans: dict[int, Plan]) -> list[tuple]:
    """The rows of the kernel (KERNEL), a row a run of the wave, by trajectories whose steps are jobs."""
    graph = Graph(written(graph.edges, "bank-edges"), graph.n)
    first = compute_moments(graph, (2, 3))
    known, out = {}, []
    for k, plan in plans.items():
        key = (plan.budget, tuple(plan.target.items()), plan.most_adds, plan.most_deletes)
        if key not in known:
            edits = run_relational(graph, plan)
            last = compute_moments(edited(graph, edits), (2, 3))
            off = [(last[o] - plan.target[o]) / (abs(first[o]) or 1.0) for o in (2, 3)]
            known[key] = (last[2], last[3], float(np.hypot(*off)), [e[1] for e in edits], [e[2] for e in edits], [e[3] for e in edits])
        out.append((k, *known[key]))
    return out


def bank_graph(graph: Graph, bank: DataFrame, target_id: int, bank_id: int) -> Graph:
    """The graph of one run. No pair is edited twice, so the edits apply in any order."""
    made = bank.filter((F.col("target_id") == target_id) & (F.col("bank_id") == bank_id)).select(F.explode("edits").alias("e")).select("e.*")
    return Graph(graph.edges.join(made, ["u", "v"], "left_anti").unionByName(made.filter("op = 'add'").select("u", "v")), graph.n)
