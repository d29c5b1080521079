import numpy as np
from pyspark.sql import functions as F

from walkmoments.llm import ann


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = [(-(float(np.dot(x[n], x[m]))), int(ids[m])) for m in range(len(ids)) if ids[m] != i]
            out[int(i)] = sorted(s)[:k]
    return out


def test_small_table_is_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [r[1] for r in rows] == [i for _, i in want[q]]
        assert np.allclose([r[2] for r in rows], [-s for s, _ in want[q]], atol=1e-12)


def test_recall_where_ranges_are_small(spark, monkeypatch):
    monkeypatch.setattr(ann, "RANGE", 256)
    monkeypatch.setattr(ann, "MARGIN", 64)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    found = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    truth = {(q, i) for q, rows in want.items() for _, i in rows}
    assert len(found & truth) / len(truth) >= 0.9


def test_recall_where_ranges_follow_the_classes(spark, monkeypatch):
    monkeypatch.setattr(ann, "RANGE", 64)
    monkeypatch.setattr(ann, "MARGIN", 16)
    x = np.random.default_rng(5).normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    score = x[::20] @ x.T
    score[np.arange(1000), np.arange(0, 20000, 20)] = -2
    near = np.argpartition(score, 20000 - 20, axis=1)[:, -20:]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    truth = {(20 * q, int(i)) for q, ids in enumerate(near) for i in ids}
    assert len(found & truth) / len(truth) >= 0.9


def test_dense_group_is_exact(spark):
    rng = np.random.default_rng(6)
    for jitter, kind in [(0.001, "float"), (1e-6, "double")]:
        x = np.full((1, 64), 0.125) + rng.normal(size=(3000, 64)) * jitter / 8
        x = x.astype(np.float32).astype(np.float64) if kind == "float" else x
        rows = list(enumerate(x.tolist()))
        want = {q: [i for _, i in near] for q, near in brute(rows).items()}
        got = {}
        for r in ann.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want


def test_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 60)] + [(i, [float(i), -3.0]) for i in range(60, 100)]
    odd = [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [1.0, None]), (180, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (200, [float("inf"), 1.0]), (80, [99.0, 9.0]), (80, [80.0, -3.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, score string")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [i for _, i in v] for q, v in brute(rows).items()}
    assert got == want
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_neighbours_touch():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    order = cells[np.argsort(ann.hilbert_keys(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
