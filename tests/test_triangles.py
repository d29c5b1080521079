"""Triangles from lists, and walks that number no neighbours but their own."""

from itertools import combinations

from pyspark.sql import functions as F

from walkmoments.operators import sampling, stats
from walkmoments.operators.graph import Graph

from .test_walks import drawn, rows_of


def test_triangles_open_no_wedge_rows(spark):
    g, held = drawn(spark, 40, 230, 12)
    held |= {(u, 40) for u in range(40)}  # a hub
    g = Graph(spark.createDataFrame(sorted(held), "u long, v long"), 42)
    d = {x: sum(x in e for e in held) for x in range(41)}
    want = set()
    for t in combinations(range(41), 3):
        if all(e in held for e in combinations(t, 2)):
            a, b, c = sorted(t, key=lambda x: (d[x], x))
            want.add((a, b, c, d[a], d[b], d[c]))
    tri = stats.triangles(g)
    found = rows_of(tri)
    assert len(found) == len(want) > 100 and set(found) == want
    assert "array_intersect" in tri._jdf.queryExecution().executedPlan().toString()  # whole lists meet, not rows
    assert rows_of(stats.triangles(Graph(g.edges.limit(0), 5))) == []


def test_walks_number_no_neighbours_but_their_own(spark, monkeypatch):
    g, held = drawn(spark, 60, 150, 13)
    near = {x: sorted({a + b - x for a, b in held if x in (a, b)}) for x in range(60)}
    seed, starts, length = 3, 5, 4
    draws = [F.pmod(sampling.drawn(seed, F.col("id")), F.lit(60)).alias("at")] + [sampling.drawn(seed, F.col("id"), F.lit(k + 1)).alias(f"x{k}") for k in range(length)]
    seen = set()
    for row in spark.range(starts).select(*draws).collect():
        now = row["at"]
        seen.add(now)
        for k in range(length):
            if not near[now]:
                break
            now = near[now][row[f"x{k}"] % len(near[now])]
            seen.add(now)
    monkeypatch.setattr(sampling, "Window", None)  # no numbering of all arcs
    assert sorted(rows_of(sampling.walk_subgraph(g, starts, length, seed))) == sorted(e for e in held if set(e) <= seen)
