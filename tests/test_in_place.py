"""Rows of quadratic results made in blocks or from gaps: no state of a solver, residual, wedge or pair is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkmoments.operators import blocks, solvers, spectral, stats
from walkmoments.operators.graph import Graph

from .test_blocks import unused
from .test_walks import drawn, rows_of


@pytest.fixture
def many(monkeypatch):
    for name, value in (("NODES", 11), ("COLUMNS", 4), ("ROWS", 7)):
        monkeypatch.setattr(blocks, name, value)


def looped(held, n):
    a = np.eye(n)
    for u, v in held:
        a[u, v] = a[v, u] = 1
    return a, a.sum(0)


def ppr(held, n):
    a, d = looped(held, n)
    return 0.2 * np.linalg.inv(np.eye(n) - 0.8 * a / np.sqrt(np.outer(d, d)))


def test_pagerank_rows_without_states_of_the_solver(spark, many, monkeypatch):
    monkeypatch.setattr(solvers, "conjugate_gradients", unused)
    g, held = drawn(spark, 40, 90, 21)
    want = ppr(held, 43)
    kept = np.where(want >= 5e-3, want, 0)
    found = {(r.i, r.j): r.w for r in spectral.ppr_diffusion(Graph(g.edges, 43), least=5e-3).collect()}
    shares = kept / kept.sum(1)[:, None]
    assert found.keys() == {(int(i), int(j)) for i, j in np.argwhere(kept)}
    assert all(abs(w - shares[at]) < 1e-12 for at, w in found.items())


def test_sparsified_pagerank_writes_only_what_is_kept(spark, many, monkeypatch):
    g, held = drawn(spark, 40, 90, 22)
    epsilons = (1e-5, 5e-3, 2e-2, 9e-1)
    want = sorted(rows_of(spectral.sparsify_to_degree(spectral.ppr_matrix(Graph(g.edges, 43)), 43, 9.0, epsilons)))
    monkeypatch.setattr(spectral, "ppr_matrix", unused)
    found = sorted(rows_of(spectral.sparsified_ppr(Graph(g.edges, 43), 9.0, epsilons=epsilons)))
    assert [r[:2] for r in found] == [r[:2] for r in want] and 43 < len(want) < 43 * 43
    assert np.allclose([r[2] for r in found], [r[2] for r in want], atol=1e-9)


def test_push_without_tables_of_residuals(spark, many, monkeypatch):
    g, _ = drawn(spark, 40, 90, 23)
    g = Graph(g.edges, 43)
    monkeypatch.setattr(blocks, "ARCS", 0)
    want = {r[:2]: r[2] for r in rows_of(spectral.ppr_push(g, epsilon=1e-3))}
    monkeypatch.setattr(blocks, "ARCS", 1 << 24)
    monkeypatch.setattr(solvers, "push_pagerank", unused)
    found = {r[:2]: r[2] for r in rows_of(spectral.ppr_push(g, epsilon=1e-3))}
    assert found.keys() == want.keys() and all(abs(w - want[at]) < 1e-14 for at, w in found.items())
    with pytest.raises(Exception, match="residuals are left"):
        spectral.ppr_push(g, epsilon=1e-3, rounds=2).count()


def test_masses_of_pairs_without_an_edge_make_no_wedge(spark, many, monkeypatch):
    g, held = drawn(spark, 40, 90, 24)
    g = Graph(g.edges, 43)
    a, d = looped(held, 43)
    a -= np.eye(43)
    m = (a / np.maximum(d - 1, 1)) @ a
    want = {(u, v): m[u, v] for u in range(43) for v in range(u + 1, 43) if m[u, v] and not a[u, v]}
    for arcs in (1 << 24, 0):
        monkeypatch.setattr(blocks, "ARCS", arcs)
        found = {r[:2]: r[2] for r in rows_of(stats.apart_mass(g))}
        assert found.keys() == want.keys() and all(abs(x - want[at]) < 1e-14 for at, x in found.items())
        if arcs:
            monkeypatch.setattr(stats, "pair_mass", unused)


@pytest.mark.parametrize("self_loop", [True, False])
def test_heat_kernel_joins_arcs_only(spark, self_loop):
    g, held = drawn(spark, 30, 60, 25)
    a, d = looped(held, 33)
    if not self_loop:
        a, d = a - np.eye(33), d - 1
    want = np.exp(5.0 * (a / np.maximum(d, 1) - 1))
    df = spectral.heat_kernel(Graph(g.edges, 33), self_loop=self_loop)
    found = rows_of(df)
    assert sorted(r[:2] for r in found) == [(i, j) for i in range(33) for j in range(33)]
    assert max(abs(w - want[i, j]) for i, j, w in found) < 1e-14
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, ((i" not in plan


def test_edges_to_leaves_are_not_solved(spark, monkeypatch):
    """A star, a path and a cycle with a tail whose least node is the tail's end."""
    star = [(0, v) for v in range(1, 9)]
    tail = [(20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (22, 25)]
    rows = [(u, v, 1.0 + (u + v) % 3) for u, v in star + tail]
    edges = spark.createDataFrame(rows, "u long, v long, w double")
    comps = spectral.components(Graph(edges, 26))
    want = sorted(rows_of(spectral.resistances(edges, comps)))
    seen, real = [], solvers.exact_resistances

    def noted(large, *more):
        seen.extend(tuple(r)[:2] for r in large.select("u", "v").collect())
        return real(large, *more)

    monkeypatch.setattr(solvers, "exact_resistances", noted)
    found = sorted(rows_of(spectral.resistances(edges, comps, dense_up_to=0)))
    assert sorted(seen) == [(22, 23), (22, 25), (23, 24), (24, 25)]
    assert [r[:3] for r in found] == [r[:3] for r in want] and np.allclose([r[3:] for r in found], [r[3:] for r in want], atol=1e-9)


@pytest.mark.parametrize("x, y", [(-1.0, 0.5), (0.3, 1.0)])
def test_directional_edit_lists_no_pairs(spark, many, monkeypatch, x, y):
    from walkmoments.operators import search
    from walkmoments.operators.moments import compute_moments

    g, _ = drawn(spark, 40, 90, 26)
    g = Graph(g.edges, 43).cached()
    m = compute_moments(g, (2, 3))
    want = [rows_of(search.directional(search.edit_candidates(g, kind), m, x, y).select("op", "u", "v", "gain")) for kind in ("add", "mixed")]
    monkeypatch.setattr(stats, "non_edge_mass", unused)
    assert rows_of(search.best_directional(g, m, x, y).select("op", "u", "v")) == [r[:3] for r in want[1]]
    monkeypatch.setattr(search, "edit_candidates", lambda graph, kind: search.delete_deltas(graph).limit(0).selectExpr("'delete' op", "1 op_rank", "*"))
    assert rows_of(search.best_directional(g, m, x, y).select("op", "u", "v")) == [r[:3] for r in want[0]]
