"""Work that must not grow with all pairs of nodes, or with wedges that cannot close."""

import random

import pytest
from pyspark.sql import functions as F

from walkmoments.operators import deltas, graph, sampling, search, stats
from walkmoments.operators.graph import Graph


def drawn(spark, n, m, seed):
    rng, found = random.Random(seed), set()
    while len(found) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            found.add((min(a, b), max(a, b)))
    return Graph(spark.createDataFrame(sorted(found), "u long, v long"), n), found


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_complement_makes_pairs_in_place(spark):
    g, held = drawn(spark, 70, 600, 1)
    want = [(u, v) for u in range(70) for v in range(u + 1, 70) if (u, v) not in held]
    found = graph.complement(g)
    assert sorted(rows_of(found)) == want
    assert "Join" not in plan_of(found)
    assert rows_of(graph.complement(Graph(g.edges.limit(0), 1))) == []
    assert len(rows_of(graph.complement(Graph(g.edges.limit(0), 5000)))) == 5000 * 4999 // 2  # runs of more than one piece


def test_first_non_edges(spark):
    g, held = drawn(spark, 9, 20, 2)
    want = [(u, v) for u in range(9) for v in range(u + 1, 9) if (u, v) not in held]
    for size in (1, 2, 7, 100):
        assert sorted(rows_of(graph.first_non_edges(g, size))) == want[:size]


def test_labels_go_to_the_pairs_and_pairs_never_to_the_driver(spark):
    g, held = drawn(spark, 60, 300, 3)
    nodes = g.nodes().select("id", (F.col("id") % 5).alias("label"))
    found = graph.addable(graph.complement(g), nodes, diff_label_only=True)
    assert sorted(rows_of(found)) == [(u, v) for u in range(60) for v in range(u + 1, 60) if (u, v) not in held and u % 5 != v % 5]
    assert "BuildLeft" not in plan_of(found)


def test_all_additions_as_by_candidates(spark):
    g, _ = drawn(spark, 40, 150, 4)
    g = Graph(g.edges, 43)  # isolated nodes too
    found, want = deltas.add_deltas(g), deltas.add_deltas(g, graph.complement(g).hint("merge"))
    assert "BuildLeft" not in plan_of(found) and "LeftAnti" not in plan_of(found)
    found, want = sorted(rows_of(found)), sorted(rows_of(want))
    assert [r[:2] for r in found] == [r[:2] for r in want] and len(found) == 43 * 42 // 2 - 150
    assert max(abs(a - b) for x, y in zip(found, want) for a, b in zip(x[2:], y[2:])) < 1e-14


def test_best_mixed_edit_as_by_all_pairs(spark):
    from walkmoments.operators.moments import compute_moments

    g, _ = drawn(spark, 30, 60, 5)
    m = compute_moments(g, (2, 3))
    want = search.best(search.scored(search.edit_candidates(g, "mixed"), m, m, search.relative_scale(m)), 1, "op_rank").select("op", "u", "v")
    assert rows_of(search.best_mixed(g).select("op", "u", "v")) == rows_of(want)


@pytest.mark.parametrize("seed", [0, 5])
def test_sampled_non_edges_come_from_their_hashes(spark, seed, monkeypatch):
    g, held = drawn(spark, 3000, 50, 6)
    every = [(((u * 73856093 + v * 19349663 + seed * 83492791) % 1000003), u, v) for u in range(3000) for v in range(u + 1, 3000)]
    held.add(min(every)[1:])  # the least is an edge
    g = Graph(spark.createDataFrame(sorted(held), "u long, v long"), 3000)
    want = sorted(p[1:] for p in sorted(p for p in every if p[1:] not in held)[:40])

    def refuse(_):
        raise AssertionError("the complement was listed")

    monkeypatch.setattr(sampling, "complement", refuse)
    assert sorted(rows_of(sampling.non_edges(g, 40, seed))) == want


def test_two_sides_make_no_wedges(spark):
    sides = [(u, 5 + v) for u in range(5) for v in range(200) if (u + v) % 3]
    g = Graph(spark.createDataFrame(sides, "u long, v long"), 205)
    tri = stats.triangles(g)
    assert rows_of(tri) == [] and "LeftSemi" in plan_of(tri)


def test_neighbour_lists_take_the_path_of_the_matrix(spark, monkeypatch):
    import numpy as np

    _, held = drawn(spark, 40, 120, 8)
    pairs = np.array(sorted(held))
    seen = set()
    for target in ({2: 0.1, 3: 0.02}, {2: 0.4, 3: 0.02}):
        plan = search.Plan(6, (2, 3), target, operation="mixed", candidate_limit=30, seed=9)
        monkeypatch.setattr(search, "DENSE", 1000)
        want = search.run_small(pairs, 42, plan)
        monkeypatch.setattr(search, "DENSE", 10)
        found = search.run_small(pairs, 42, plan)
        assert found[0] == want[0] and all(abs(found[2][k] - want[2][k]) < 1e-12 for k in (2, 3))
        seen |= {e[1] for e in found[0]}
    assert seen == {"add", "delete"}
    sparse, dense = search.SparseGraph(pairs, 42), search.SmallGraph(pairs, 42)
    assert (sparse.pairs(False) == dense.pairs(False)).all() and (sparse.pairs(True) == dense.pairs(True)).all()


def test_lazy_search_with_all_refreshed_holds_nothing_on_the_driver(spark, monkeypatch):
    g, _ = drawn(spark, 14, 30, 9)
    want = rows_of(search.sample_by_moments(g.edges, 14, budget=2).edits.orderBy("step"))
    monkeypatch.setattr(search, "DENSE", 10)

    def refuse(*_):
        raise AssertionError("one task took the graph")

    monkeypatch.setattr(search, "run_grouped", refuse)
    monkeypatch.setattr(search, "cut", refuse)  # the table of held scores
    assert rows_of(search.sample_by_moments(g.edges, 14, budget=2, strategy="lazy", top_k=30).edits.orderBy("step")) == want


def test_traces_equal_the_spectrum(spark):
    from walkmoments.operators import spectral

    g, _ = drawn(spark, 25, 70, 10)
    sizes = spark.createDataFrame([(0, 25)], "graph_id long, n long")
    want = spectral.spectrum(g.edges.select(F.lit(0).cast("long").alias("graph_id"), "u", "v"), sizes).select("m2", "m3", "m4").first()
    found = spectral.spectrum_traces(g).select("m2", "m3", "m4").first()
    assert max(abs(a - b) for a, b in zip(found, want)) < 1e-12


def test_direct_changes_near_an_edge(spark):
    g, _ = drawn(spark, 20, 45, 11)
    g = Graph(g.edges.unionByName(spark.createDataFrame([(20, 21), (0, 22)], "u long, v long")).cache(), 24)
    found, want = sorted(rows_of(deltas.direct_deltas_all(g, (2, 3)))), sorted(rows_of(deltas.delete_deltas(g)))
    assert [r[:2] for r in found] == [r[:2] for r in want] and len(want) == 47
    assert max(abs(a - b) for x, y in zip(found, want) for a, b in zip(x[2:], y[2:])) < 1e-14
    assert "MapInPandas" not in plan_of(deltas.direct_deltas_all(g, (2, 3)))


def test_pairs_of_parts_are_dealt_by_the_number_of_parts(spark, monkeypatch):
    from walkmoments.sources import graphs

    sf = "/root/testdata/sf0.001"
    want = sorted(rows_of(graphs.copurchase(spark, sf).edges))
    monkeypatch.setattr(graphs, "PARTS_OF_TASK", 9)
    g = graphs.copurchase(spark, sf)
    assert g.edges.rdd.getNumPartitions() == g.n // 9 + 1 and sorted(rows_of(g.edges)) == want
