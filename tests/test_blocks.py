"""Columns of walk powers and of inverses made block by block, against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkmoments.operators import blocks, deltas, graph, solvers, spectral, walks
from walkmoments.operators.graph import Graph

from .test_walks import dense, drawn, rows_of


@pytest.fixture
def many(monkeypatch):
    """Several blocks and pieces."""
    for name, value in (("NODES", 11), ("COLUMNS", 4), ("ROWS", 7)):
        monkeypatch.setattr(blocks, name, value)


def unused(*_, **__):
    raise AssertionError("the way by joins was taken")


def laplacian(n, rows):
    out = np.zeros((n, n))
    for u, v, w in rows:
        out[[u, v], [u, v]] += w
        out[[u, v], [v, u]] -= w
    return out


def test_resistances_without_states_of_the_solver(spark, many, monkeypatch):
    monkeypatch.setattr(solvers, "conjugate_gradients", unused)
    g, held = drawn(spark, 50, 120, 7)
    held = sorted(held) + [(60, 61), (61, 62), (60, 62)]  # a second component, ids without edges between
    rows = [(u, v, 1.0 + (u + v) % 3) for u, v in held]
    edges = spark.createDataFrame(rows, "u long, v long, w double")
    inverse = np.linalg.pinv(laplacian(63, rows), hermitian=True)
    comps = spectral.components(Graph(edges, 63))
    found = rows_of(spectral.resistances(edges, comps, dense_up_to=0))
    assert len(found) == len(rows)
    for u, v, w, r, leverage in found:
        assert abs(r - (inverse[u, u] + inverse[v, v] - 2 * inverse[u, v])) < 1e-9 and abs(leverage - w * r) < 1e-12


@pytest.mark.parametrize("gaussian", [False, True])
def test_projected_resistances_without_states_of_the_solver(spark, many, monkeypatch, gaussian):
    monkeypatch.setattr(solvers, "conjugate_gradients", unused)
    g, held = drawn(spark, 30, 90, 8)
    edges = g.edges.withColumn("w", 1.0 + (F.col("u") + F.col("v")) % 3)
    rows = rows_of(edges)
    inverse = np.linalg.pinv(laplacian(30, rows), hermitian=True)
    found = rows_of(solvers.projected_resistances(edges, 30, 1500, 3, gaussian))
    assert {r[:3] for r in found} == set(rows)
    for u, v, _, r in found:
        assert abs(r / (inverse[u, u] + inverse[v, v] - 2 * inverse[u, v]) - 1) < 0.25  # six standard deviations


def test_draws_are_centred_and_apart():
    key = np.arange(2000, dtype=np.uint64)
    for gaussian in (False, True):
        x = np.hstack([blocks.draws(key, first, 32, gaussian) for first in (0, 32, 64)])
        assert np.abs(np.corrcoef(x.T) - np.eye(96)).max() < 0.12 and abs(x.mean()) < 0.02 and abs(x.var() - 1) < 0.02


def test_all_additions_of_order_four_list_no_pairs(spark, many, monkeypatch):
    g, _ = drawn(spark, 40, 110, 9)
    g = Graph(g.edges, 44)  # isolated nodes too
    want = sorted(rows_of(deltas.walk_deltas(g, graph.complement(g), (2, 4, 5), adding=True)))
    monkeypatch.setattr(deltas, "complement", unused)
    found = sorted(rows_of(deltas.all_addition_deltas(g, (2, 4, 5))))
    assert [r[:2] for r in found] == [r[:2] for r in want] and len(found) == 44 * 43 // 2 - 110
    assert np.allclose([r[2:] for r in found], [r[2:] for r in want], atol=1e-14)


def test_order_eight_by_columns(spark, many):
    g, held = drawn(spark, 40, 110, 10)
    s = dense(40, held)
    found = {r[0]: r[2:] for r in rows_of(walks.walk_sums(g, 8, across=False))}
    assert found.keys() == {x for e in held for x in e}
    for u, w in found.items():
        assert np.allclose(w, [np.linalg.matrix_power(s, t)[u, u] for t in range(1, 9)], atol=1e-14)


def test_diffusion_makes_no_power(spark, many, monkeypatch):
    monkeypatch.setattr(spectral, "product", unused)
    g, held = drawn(spark, 40, 110, 11)
    a = np.eye(43)
    for u, v in held:
        a[u, v] = a[v, u] = 1
    t = a / np.sqrt(np.outer(a.sum(0), a.sum(0)))
    want = sum(np.linalg.matrix_power(t, k) for k in range(4)) / 3 + 0.05 * t
    found = {(r.i, r.j): r.w for r in spectral.markov_diffusion(Graph(g.edges, 43), least=0.01).collect()}
    assert found.keys() == {(int(i), int(j)) for i, j in np.argwhere(want >= 0.01)}
    assert all(abs(w - want[k]) < 1e-14 for k, w in found.items())
