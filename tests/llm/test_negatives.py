import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkmoments.llm import negatives, registry

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, asks=lambda i: i % 100 == 0, scale=256):
    """rows (id, label, vector) -> the rows of the result, by all products."""
    out = []
    rows = [(i, y, [math.floor(scale * float(x)) for x in v]) for i, y, v in rows]
    for i, y, a in rows:
        if not asks(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, v)), j, z) for j, z, v in rows if j != i)
        for ps, p, _ in [s for s in scored if s[2] == y][:5]:
            fit = [(-s, j) for s, j, z in scored if z != y and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(i, p, r, j, -ps, s) for r, (s, j) in enumerate(fit[:10], 1)]
    return sorted(out)


def mined(df, asks=None, **options):
    asks = F.col("vec_id") % 100 == 0 if asks is None else asks
    return sorted(tuple(r) for r in negatives.mine(df, asks, **options).select(*COLUMNS).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    changed = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    got = registry.queries()["op13_hard_negatives"](spark, f"/root/testdata/{sf}")
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute(changed)


def test_many_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 3)
    monkeypatch.setattr(negatives, "TILE_ROWS", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 12))
    label = rng.integers(0, 4, 400)
    x = np.round(centre[label] * 3 + rng.normal(size=(400, 12)) * 6) / 8  # few values, hence ties
    rows = [(i, int(label[i]), x[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert mined(df, F.col("vec_id") % 10 == 0, block=7) == want
    assert mined(df, F.col("vec_id") % 10 == 0) == want


def test_ties_repeats_and_odd_rows(spark):
    rows = [(i, i % 2, [1.0, 0.5]) for i in range(40)] + [(i, 1 - i % 2, [0.5, 0.25 + (i % 3) / 64]) for i in range(40, 140)] + [(200, 0, [-1.0, -1.0]), (300, 5, [1.0, 1.0]), (400, 0, [0.0, 0.0])]
    odd = [(None, 1, [1.0, 1.0]), (500, None, [1.0, 1.0]), (600, 1, None), (700, 1, [None, 1.0]), (800, 1, [float("nan"), 1.0]), (900, 1, [float("inf"), 0.0]), (1000, 1, [1.0, 2.0, 3.0])]
    repeats = [(0, 0, [1.0, 0.5]), (0, 7, [1.0, 0.5]), (100, 3, [9.0, 9.0])]
    df = spark.createDataFrame([(i, y, v, "x", 1) for i, y, v in rows + odd + repeats], "vec_id long, label int, embedding array<double>, rank string, c int")
    assert mined(df) == brute(rows)
    assert mined(df.limit(0)) == []
    assert mined(df, F.lit(False)) == []


def test_intervals_hold_every_score_and_drop_pairs():
    rng = np.random.default_rng(9)
    c = rng.integers(-200, 201, (500, 16))
    a = negatives.Anchors(np.arange(20), np.zeros(20), c[:20], 9)
    exact = c[:20] @ c.T
    left = []

    def qualifies(low, high, who):
        if who is None:
            assert (low <= exact).all() and (exact <= high).all()
            fits = high >= 150_000
            left.append(int(fits.sum()))
            return fits
        left.append(len(who))
        return high >= 150_000

    who, row, score = negatives.sliced_scores(a, slice(0, 20), c, np.ones((20, 500), bool), qualifies)
    assert sorted(zip(who, row, score)) == sorted((i, j, exact[i, j]) for i, j in zip(*np.nonzero(exact >= 150_000)))
    assert left == sorted(left, reverse=True) and left[4] < 5000  # fewer at each plane


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [1e9, 1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError):
        negatives.mine(df, F.col("vec_id") == 0)
