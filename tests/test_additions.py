"""The search for the best addition against a list of all pairs."""

import random

import pytest

from walkmoments.operators import additions, moments, search, stats
from walkmoments.operators.additions import best_addition
from walkmoments.operators.graph import Graph


def drawn(n, m, seed):
    rng, found = random.Random(seed), set()
    while len(found) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            found.add((min(a, b), max(a, b)))
    return sorted(found)


CASES = {
    "ring": ([(i, i + 1) for i in range(39)] + [(0, 39)], 40, (0.95, 1.0), {}),
    "two stars and isolated nodes": ([(0, i) for i in range(2, 20)] + [(1, i) for i in range(20, 40)], 44, (0.99, 1.0), {}),
    "complete": ([(i, j) for i in range(6) for j in range(i + 1, 6)], 6, (1.0, 1.0), {}),
    "random by grids": (drawn(120, 300, 2), 130, (1.01, 0.9), {"direct": 0}),
    "no edges": ([], 5, (1.0, 1.0), {}),
    "one node": ([], 1, (1.0, 1.0), {}),
}


@pytest.mark.parametrize("name", CASES)
def test_best_of_all_pairs(spark, name):
    edges, n, factors, how = CASES[name]
    g = Graph(spark.createDataFrame(edges, "u long, v long").cache(), n)
    now = moments.compute_moments(g, (2, 3))
    scale, target = search.relative_scale(now), {k: f * now[k] for k, f in zip((2, 3), factors)}
    found = best_addition(g, now, target, scale, **how).collect()
    want = search.best(search.scored(search.edit_candidates(g, "add"), now, target, scale)).collect()
    assert [(r["u"], r["v"]) for r in found] == [(r["u"], r["v"]) for r in want]
    for r, w in zip(found, want):
        assert abs(r["delta_m2"] - w["delta_m2"]) + abs(r["delta_m3"] - w["delta_m3"]) < 1e-12
    spark.catalog.clearCache()


def test_left_out_pairs_and_one_order(spark):
    g = Graph(spark.createDataFrame(drawn(30, 60, 3), "u long, v long").cache(), 30)
    now = moments.compute_moments(g, (2, 3))
    scale, target = search.relative_scale(now), {2: now[2] * 1.01}
    first = best_addition(g, now, target, scale).select("u", "v").collect()
    skip = spark.createDataFrame([tuple(r) for r in first] * 2, "u long, v long")
    want = search.best(search.scored(search.edit_candidates(g, "add", skip=skip), now, target, scale)).first()
    found = best_addition(g, now, target, scale, skip).first()
    assert (found["u"], found["v"]) == (want["u"], want["v"]) != tuple(first[0])
    with pytest.raises(ValueError):
        best_addition(g, now, {4: 0.1}, scale)
    spark.catalog.clearCache()


def test_mixed_steps_take_the_path_of_all_pairs(spark):
    edges = spark.createDataFrame(drawn(12, 20, 4), "u long, v long")
    paths = [search.sample_by_moments(edges, 12, budget=2, operation="mixed", target={2: 0.3, 3: 0.05}, relational=way).edits.orderBy("step").select("op", "u", "v").collect() for way in (True, False)]
    assert paths[0] == paths[1] and {r["op"] for r in paths[0]} & {"add"}
    spark.catalog.clearCache()


@pytest.mark.parametrize("few, cells", [(1 << 15, 2048), (1, 2048), (1 << 15, 1)])
def test_few_nodes_open_wedges_and_few_pairs_shuffle_no_edge(spark, monkeypatch, few, cells):
    monkeypatch.setattr(additions, "FEW", few)
    monkeypatch.setattr(additions, "CELLS", cells)
    held = drawn(60, 150, 5)
    g = Graph(spark.createDataFrame(held, "u long, v long").cache(), 62)
    rows = additions.features(g)
    now = additions.moments_of(rows, g.n)
    assert all(abs(now[k] - m) < 1e-14 for k, m in moments.compute_moments(g, (2, 3)).items())
    target, scale = {2: 0.98 * now[2], 3: 1.05 * now[3]}, search.relative_scale(now)
    opened, alive = [], additions._Search.alive
    monkeypatch.setattr(additions._Search, "alive", lambda self: opened.append(alive(self)) or opened[0])
    counted, discard = [], additions.discard
    monkeypatch.setattr(additions, "discard", lambda df: (counted.append(df.count()) if opened and df is opened[0] else None) or discard(df))
    found = best_addition(g, now, target, scale, direct=0, rows=rows).collect()
    want = search.best(search.scored(search.edit_candidates(g, "add"), now, target, scale)).collect()
    assert [(r["u"], r["v"]) for r in found] == [(r["u"], r["v"]) for r in want]
    assert (counted[0] == g.n) if cells == 1 else (0 < counted[0] < g.n)
    pairs = spark.createDataFrame([p for p in ((i, j) for i in range(0, 62, 9) for j in range(i + 1, 62)) if p not in held], "u long, v long")
    one, two = ({(r.u, r.v): r.m for r in stats.pair_mass(g, pairs, few=way).collect()} for way in (True, False))
    assert one.keys() == two.keys() and one and all(abs(one[p] - two[p]) < 1e-14 for p in one)
    spark.catalog.clearCache()
