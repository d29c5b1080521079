import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.brute import components_by_all_pairs, shingle_set
from walkmoments.llm import ngram_join, shingles, sigtree


def family(seed):
    """Texts with near copies at all distances, copies, and short, empty and odd ones."""
    random.seed(seed)
    words = [f"w{k}" for k in range(300)]
    rows, texts = [], []
    for _ in range(12):
        base = random.choices(words, k=random.choice([3, 5, 9, 30, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(10):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                at = random.randrange(len(copy))
                copy[at : at + random.randint(0, 1)] = random.choices(words, k=random.randint(0, 1))
            texts.append(random.choice([" ", "\n", " \t"]).join(copy).upper() if random.random() < 0.2 else " ".join(copy))
    texts += [None, "", " \n", "one", "One", "ONE two", "é É", "É é", texts[3], texts[3]]
    rows = list(enumerate(texts))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,num,den", [(1, 4, 85, 100), (2, 5, 8, 10)])
def test_components_by_brute_force(spark, monkeypatch, seed, n, num, den):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)  # several blocks a group
    rows = family(seed)
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in rows], "doc_id long, text string, cid long, key string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, n, num, den).collect()}
    assert got == components_by_all_pairs(rows, n, num, den)


@pytest.mark.parametrize("seed,n,num,den", [(1, 4, 85, 100), (2, 5, 8, 10)])
def test_links_by_brute_force(spark, monkeypatch, seed, n, num, den):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = family(seed)
    sets = {i: shingle_set(t, n) for i, t in rows}
    want = {i: sum(bool(s) and j != i and den * len(s & o) >= num * len(s | o) for j, o in sets.items()) for i, s in sets.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.n_links for r in ngram_join.links(docs, n, num, den).collect()} == want


def test_table_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.read.parquet(f"{sf}/documents.parquet"), 4, 85, 100).collect()}
    assert got == components_by_all_pairs(rows, 4, 85, 100)


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "z"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(docs, 4, 85, 100).collect()), key=str)
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 1, None), (None, 0, None), (3, 0, 3)], key=str)
    assert ngram_join.join(docs.limit(0), 4, 85, 100).count() == 0


def test_hashing_in_pieces(monkeypatch):
    texts = [" ".join(f"w{(k * k) % 97}" for k in range(5000)).encode(), b"a  b\x0bc", b"", b"word"]
    whole = shingles.sets_of(texts, 4)
    monkeypatch.setattr(shingles, "PIECE", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.sets_of(texts, 4)))
    assert [len(s) for s in whole] == [len(shingle_set(t.decode(), 4)) for t in texts]


def test_blocking_and_bounds_lose_no_link():
    rng = np.random.default_rng(4)
    for num, den in ((85, 100), (8, 10)):
        for size in (2, 6, 7, 12, 40, 97, 200, 800, 3000):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                drop = int(rng.integers(0, max(1, len(a) // 8) + 1))
                add = rng.integers(0, 1 << 63, int(rng.integers(0, max(1, len(a) // 8) + 1)), dtype=np.uint64)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], add]))
                if not len(b) or not shingles.linked(a, b, num, den) or np.array_equal(a, b):
                    continue
                keys, off = shingles.segment_keys([a, b], num, den)
                assert set(keys[: off[1]].tolist()) & set(keys[off[1] :].tolist())
                maps = [sigtree.bitmap_of(a), sigtree.bitmap_of(b)]
                one = np.array([1, 2])
                found = sigtree.candidates(np.array([len(a), len(b)]), maps, one, one, np.array([2, 2]), num, den)
                assert len(found[0]) == 1
                assert sigtree.overlap_bound(len(a), maps[0], len(b), maps[1]) >= len(np.intersect1d(a, b))


def test_dual_traversal_equals_all_pairs():
    rng = np.random.default_rng(8)
    bases = [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64)) for _ in range(5)]
    sets = [np.unique(np.concatenate([rng.permutation(bases[k % 5])[: 60 - k % 7], rng.integers(0, 1 << 63, k % 4, dtype=np.uint64)])) for k in range(150)]
    comps = rng.integers(0, 40, 150)
    ids, sizes = np.arange(150), np.array([len(s) for s in sets])
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if comps[i] != comps[j] and shingles.linked(sets[i], sets[j], 85, 100)}
    for side in (np.full(150, 2), rng.integers(0, 2, 150)):
        a, b, _ = sigtree.candidates(sizes, [sigtree.bitmap_of(s) for s in sets], comps, ids, side, 85, 100)
        found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        assert {(i, j) for i, j in want if side[i] == 2 or side[i] != side[j]} <= found
        assert len(found) < 150 * 149 / 4


def test_dense_blocks_and_long_runs(spark, monkeypatch):
    """With one candidate a set at a time and three sets of a key held, results are the same."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "DENSE", 1)
    monkeypatch.setattr(ngram_join, "RUN", 3)
    monkeypatch.setattr(ngram_join, "SEEN", 2)
    rows = family(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, 4, 85, 100).collect()}
    want = components_by_all_pairs(rows, 4, 85, 100)
    assert got == want
    kept = ngram_join.keep_one(docs.withColumn("rid", spark.range(1).select("id").first().id + docs.doc_id), 4, 85, 100)
    first = {c for i, (n, c) in want.items() if n} | {i for i, (n, _) in want.items() if not n}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first) and kept.columns == ["doc_id", "text", "rid"]


def test_keep_one_of_equal_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (7, "A b c d e f"), (9, "a b c d e f"), (1, ""), (1, ""), (None, None), (2, "lone words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.keep_one(docs, 5, 8, 10).collect()), key=str)
    assert got == sorted([(7, "A b c d e f"), (1, ""), (1, ""), (None, None), (2, "lone words here")], key=str)
    assert ngram_join.keep_one(docs.limit(0), 5, 8, 10).count() == 0
