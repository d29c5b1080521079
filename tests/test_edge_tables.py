"""Long trajectories and ends of spectra in one task that holds edges and no matrix, against the dense ways."""

import random

import numpy as np
import pytest

from walkmoments.operators import blocks, search, solvers, spectral
from walkmoments.operators.graph import Graph


def drawn(n, m, seed):
    rng, found = random.Random(seed), set()
    while len(found) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            found.add((min(a, b), max(a, b)))
    return np.array(sorted(found))


def both_ways(monkeypatch, run):
    monkeypatch.setattr(search, "DENSE", 1000)
    want = run()
    monkeypatch.setattr(search, "DENSE", 10)
    return want, run()


@pytest.mark.parametrize("met", [1 << 22, 0])
@pytest.mark.parametrize("target", [None, {2: 0.2, 3: 0.01}])
def test_deletions_over_an_edge_table_take_the_dense_path(monkeypatch, met, target):
    pairs = drawn(40, 150, 31)
    monkeypatch.setattr(search, "MET", met)
    monkeypatch.setattr(search.SparseGraph, "__init__", None)
    want, found = both_ways(monkeypatch, lambda: search.run_small(pairs, 43, search.Plan(80, (2, 3), target, checkpoints=(0, 7))))
    assert found[0] == want[0] and all(abs(found[2][k] - want[2][k]) < 1e-13 for k in (2, 3))
    assert all((found[3][k] == want[3][k]).all() for k in (0, 7))


def test_random_deletions_keep_no_statistics(monkeypatch):
    pairs = drawn(40, 150, 32)
    monkeypatch.setattr(search.SparseGraph, "edit", None)
    want, found = both_ways(monkeypatch, lambda: search.run_small(pairs, 43, search.Plan(60, (2, 3), strategy="random", seed=3, checkpoints=(5,))))
    assert found[0] == want[0] and (found[3][5] == want[3][5]).all() and abs(found[2][3] - want[2][3]) < 1e-13


@pytest.mark.parametrize("target", [{2: 0.04, 3: 0.007}, {2: 0.5, 3: 0.07}])
def test_progressive_targets_list_no_pairs(monkeypatch, target):
    pairs, real = drawn(40, 150, 33), search.SparseGraph.pairs

    def refuse(g, present):
        assert present
        return real(g, present)

    monkeypatch.setattr(search.SparseGraph, "pairs", refuse)
    want, found = both_ways(monkeypatch, lambda: search.progressive(pairs, 43, target, 6, 3, 3))
    assert found == want and {e[1] for e in want} <= {"add", "delete"}


def test_many_steps_are_one_task(spark, monkeypatch):
    pairs = drawn(14, 30, 34)
    edges = spark.createDataFrame([tuple(map(int, p)) for p in pairs], "u long, v long")
    monkeypatch.setattr(search, "DENSE", 10)
    monkeypatch.setattr(search, "STEPS", 4)
    monkeypatch.setattr(search, "run_relational", None)
    assert search.sample_by_moments(edges, 14, budget=5).edits.count() == 5


def test_ends_of_a_spectrum_in_one_task(spark, monkeypatch):
    pairs = np.concatenate([drawn(90, 160, 35), [(i, j) for i in range(100, 108) for j in range(i + 1, 108)]])
    a = np.zeros((120, 120))
    a[pairs[:, 0], pairs[:, 1]] = a[pairs[:, 1], pairs[:, 0]] = 1
    s = np.divide(1, np.sqrt(a.sum(0)), out=np.zeros(120), where=a.sum(0) > 0)
    want = np.linalg.eigvalsh(a * s[:, None] * s)
    monkeypatch.setattr(solvers, "spectrum_ends", None)
    edges = spark.createDataFrame([tuple(map(int, p)) for p in pairs], "u long, v long")
    for widest in (256, 40):  # without and with a new beginning
        monkeypatch.setattr(blocks, "WIDEST", widest)
        row = spectral.spectrum_ends(Graph(edges, 120), 4).first()
        assert np.allclose(row.smallest, want[:4], atol=1e-7) and np.allclose(row.largest, want[-4:], atol=1e-7) and row.residual <= 1e-8
