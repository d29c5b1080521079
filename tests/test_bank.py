import json

import pytest
from pyspark.sql import functions as F

from walkmoments.operators import bank, search
from walkmoments.operators.graph import canonical
from walkmoments.operators.moments import compute_moments
from walkmoments.sources import store

POINTS = "target_id long, target_m2 double, target_m3 double, add_budget long, delete_budget long, total_budget long"


@pytest.fixture(scope="module")
def graph(spark):
    pairs = [(i, j) for i in range(14) for j in range(i + 1, 14) if (i * 7 + j * 5) % 4 == 0 or j == i + 1]
    return canonical(spark.createDataFrame(pairs, "u long, v long"), 14).cached()


def rows(runs):
    return sorted((r.target_id, r.bank_id, r.seed, round(r.m2, 12), r.add_count, r.delete_count, tuple(map(tuple, r.edits))) for r in runs.collect())


def test_a_killed_bank_resumes_and_only_grows(spark, graph, tmp_path, monkeypatch):
    points = spark.createDataFrame([(0, 0.25, 0.03, 2, 1, 3), (3, 0.2, 0.05, 1, 4, 4), (9, 0.2, 0.05, 0, 0, 0)], POINTS)
    how = {"candidate_limit": 12, "seed": 5}
    want = rows(bank.grow_bank(graph, points, f"file://{tmp_path}/whole", 3, **how))
    assert len(want) == 9 and [r[2] for r in want[:3]] == [5 + 1_000_003 + b for b in range(3)]
    assert all(r[4] <= 2 and r[5] <= 1 for r in want if r[0] == 0) and all(r[4] <= 1 and r[4] + r[5] == 4 for r in want if r[0] == 3)
    assert all(r[6] == () for r in want if r[0] == 9)

    folder, calls, real = f"file://{tmp_path}/killed", [], bank._commit

    def dies(*a):
        calls.append(a)
        if len(calls) == 3:  # after the part is written, before it is named
            raise KeyboardInterrupt
        return real(*a)

    monkeypatch.setattr(bank, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        bank.grow_bank(graph, points, folder, 2, wave=2, **how)
    monkeypatch.setattr(bank, "_commit", real)
    first = rows(bank.read_bank(graph, folder))
    assert len(first) == 2
    assert rows(bank.grow_bank(graph, points.filter("target_id < 9"), folder, 2, wave=3, **how)) == [r for r in want if r[1] < 2 and r[0] < 9]
    assert rows(bank.grow_bank(graph, points, folder, 3, **how)) == want
    parts = json.loads(store.read_text(f"{folder}/manifest.json"))["parts"]
    assert rows(bank.grow_bank(graph, points, folder, 3, **how)) == want
    assert json.loads(store.read_text(f"{folder}/manifest.json"))["parts"] == parts

    with pytest.raises(ValueError, match="larger"):
        bank.grow_bank(graph, points, folder, 2, **how)
    with pytest.raises(ValueError, match="another seed"):
        bank.grow_bank(graph, points, folder, 3, candidate_limit=12, seed=6)
    with pytest.raises(ValueError, match="edge_hash"):
        bank.grow_bank(canonical(graph.edges.filter("u > 0 or v > 1"), 14), points, folder, 3, **how)
    with pytest.raises(ValueError, match="other moments"):
        bank.grow_bank(graph, points.withColumn("target_m2", F.lit(0.3)), folder, 3, **how)
    with pytest.raises(RuntimeError, match="another job"):
        bank._commit(f"{folder}/manifest.json", {}, ["x"], parts[:1])


def test_runs_give_their_graphs_and_bad_points_raise(spark, graph, tmp_path):
    m = compute_moments(graph, (2, 3))
    points = search.prepare_points(search.target_grid(spark, m[2], m[3], 2, 2, 0.3), graph.edges.count(), add=0.1, delete=0.1)
    got = bank.grow_bank(graph, points, f"file://{tmp_path}/grid", 1)
    for r in got.filter("target_id in (0, 3)").collect():
        made = compute_moments(bank.bank_graph(graph, got, r.target_id, r.bank_id), (2, 3))
        assert abs(made[2] - r.m2) < 1e-9 and abs(made[3] - r.m3) < 1e-9
    bad = [(None, 0.2, 0.1, 1, 1, 1), (-1, 0.2, 0.1, 1, 1, 1), (0, float("nan"), 0.1, 1, 1, 1), (0, 0.2, None, 1, 1, 1), (0, 0.2, 0.1, -1, 1, 1)]
    for row in bad:
        with pytest.raises(ValueError):
            bank.grow_bank(graph, spark.createDataFrame([row], POINTS), f"file://{tmp_path}/bad", 1)
    twice = spark.createDataFrame([(0, 0.2, 0.1, 1, 1, 1)] * 2, POINTS)
    with pytest.raises(ValueError, match="repeats"):
        bank.grow_bank(graph, twice, f"file://{tmp_path}/bad", 1)
    with pytest.raises(ValueError, match="edges"):
        bank.grow_bank(canonical(graph.edges.limit(0), 14), twice.limit(1), f"file://{tmp_path}/bad", 1)
    for size in (0, True, 1.5):
        with pytest.raises(ValueError):
            bank.grow_bank(graph, twice.limit(1), f"file://{tmp_path}/bad", size)
    assert not store.exists(f"file://{tmp_path}/bad/manifest.json")


def test_a_large_graph_has_the_same_runs_by_jobs(spark, graph, tmp_path, monkeypatch):
    points = spark.createDataFrame([(0, 0.25, 0.03, 0, 2, 2)], POINTS)
    want = rows(bank.grow_bank(graph, points, f"file://{tmp_path}/dense", 2))
    monkeypatch.setattr(bank, "MOST_NODES", 10)
    monkeypatch.setattr(bank, "run_small", None)
    assert rows(bank.grow_bank(graph, points, f"file://{tmp_path}/jobs", 2)) == want and all(r[5] == 2 for r in want)


def test_caps_leave_the_other_operation():
    plan = search.Plan(3, (2, 3), operation="mixed", most_adds=1, most_deletes=2)
    assert search._kinds(plan, []) == "mixed" and search._kinds(plan, [(1, "add", 0, 1)]) == "delete"
    with pytest.raises(ValueError):
        search._kinds(plan, [(1, "add", 0, 1), (2, "delete", 0, 2), (3, "delete", 0, 3)])
