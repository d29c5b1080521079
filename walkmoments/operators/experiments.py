"""Experiment drivers: timing of trajectories, preservation of properties, linear probes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectral
from .graph import Graph
from .lineage import cut, written
from .reporting import checkpoint_steps
from .search import sample_by_moments

ANCHORS = {"anchor_m2": (2,), "anchor_m3": (3,), "anchor_m4": (4,), "anchor_m2_m3": (2, 3), "anchor_m2_m4": (2, 4), "anchor_m3_m4": (3, 4), "anchor_m2_m3_m4": (2, 3, 4)}


def efficiency(graph: Graph, budget: int = 100, groups=((2, 3), (2, 3, 4)), ks=(5, 25, 50)) -> DataFrame:
    """orders, strategy, top_k, total_sec, mean_step_ms: greedy and lazy deletion, a fresh trajectory each."""
    rows = []
    for orders in groups:
        for strategy, k in [("greedy", 0), *[("lazy", k) for k in ks]]:
            start = time.time()
            sample_by_moments(graph.edges, graph.n, budget=budget, orders=orders, strategy=strategy, top_k=k or 25).edits.count()
            took = time.time() - start
            rows.append((",".join(map(str, orders)), strategy, k, took, 1000 * took / max(budget, 1)))
    return graph.spark.createDataFrame(rows, "orders string, strategy string, top_k int, total_sec double, mean_step_ms double")


def preservation(graph: Graph, methods=("anchor_m2_m3", "random_edge"), most: float = 0.1, step: float = 0.05, seeds=(0,), metrics=spectral.METRICS) -> DataFrame:
    """method, seed, step, remove_ratio, remaining_edges, metric, distance at checkpoints of one trajectory each.

    Deterministic methods run the first seed only. The graph is written once, and its own properties are made once.
    """
    graph = Graph(written(graph.edges.select("u", "v"), "preserved-edges"), graph.n)
    size, before = graph.edges.count(), cut(spectral.property_snapshot(graph, metrics))
    steps = checkpoint_steps(size, most, step)
    out = None
    for method in methods:
        for seed in seeds if method == "random_edge" else seeds[:1]:
            how = {"strategy": "random", "orders": (2, 3)} if method == "random_edge" else {"orders": ANCHORS[method]}
            made = sample_by_moments(graph.edges, graph.n, budget=steps[-1], seed=seed, checkpoints=tuple(steps), **how)
            for s in steps:
                now = Graph(made.snapshots.filter(F.col("step") == s).select("u", "v"), graph.n)
                rows = spectral._distances(before, spectral.property_snapshot(now, metrics)).select(
                    F.lit(method).alias("method"), F.lit(seed).alias("seed"), F.lit(s).alias("step"), F.lit(s / size).alias("remove_ratio"), F.lit(size - s).alias("remaining_edges"), "metric", "distance"
                )
                out = rows if out is None else out.unionByName(rows)
    return out


def linear_probe(rows: DataFrame, seed: int = 0, strengths=(0.0, 0.01, 0.1)) -> DataFrame:
    """strength, valid_accuracy, test_accuracy, test_f1 of logistic regressions on rows (id, features, label).

    Hashed split: a tenth trains, a tenth validates, the rest tests.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10))
    data = rows.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"), part.alias("part"))
    train, valid, test = data.filter("part = 0").cache(), data.filter("part = 1"), data.filter("part > 1")
    found = []
    for strength in strengths:
        model = LogisticRegression(regParam=strength, maxIter=50).fit(train)

        def score(on: DataFrame, metric: str) -> float:
            return MulticlassClassificationEvaluator(metricName=metric).evaluate(model.transform(on))

        found.append((float(strength), score(valid, "accuracy"), score(test, "accuracy"), score(test, "f1")))
    return rows.sparkSession.createDataFrame(found, "strength double, valid_accuracy double, test_accuracy double, test_f1 double")
