import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from walkmoments.llm import lexical, registry

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """docs (doc_id, text), items (item_id, text) -> rows by scoring every document."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked if df[t]}
        for i, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(r * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = registry.queries()["op12_wand_search"](spark, sf)
    assert found(got) == brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])


def test_many_shards_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 40)
    random.seed(4)
    words = [f"w{i}" for i in range(40)] + ["Éa", "漢字", "The"]
    docs = [(i, " ".join(random.choices(words, weights=[1 / (j + 1) for j in range(43)], k=random.randint(0, 30)))) for i in range(300)]
    docs += [(1000 - i, "w5 w6 same text") for i in range(60)]
    items = [(i, " ".join(random.choices(words, k=random.randint(0, 12)))) for i in range(20)] + [(90, "same same TEXT"), (91, "absent"), (92, None)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert found(lexical.search(df, asked)) == want
    assert found(lexical.search(df, asked, block=9)) == want


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a-b_C9 é!"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "x " * 60_000 + "needle"), (6, "--- ..."), (7, "C9")]
    items = [(1, "A c9"), (1, "z"), (2, "needle x x"), (None, "a"), (3, "É")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, n string, tids int")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    assert found(lexical.search(df, asked)) == brute(docs, [(1, "A c9"), (2, "needle x x"), (3, "É")])
    assert lexical.search(df.limit(0), asked).count() == 0
    assert lexical.search(df, asked.limit(0)).count() == 0


def test_documents_are_skipped():
    rows = [(i, 100, [0, 1] if i < 50 else [0], [1, 1] if i < 50 else [1]) for i in range(5000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
        names=["doc_id", "n", "tids", "tfs"],
    )
    import numpy as np

    shard, heap = lexical.Shard([batch], np.array([1, 4000]), 5000, 500_000), lexical.Heap(20)
    assert lexical.wand(shard, [(0, 1), (1, 1)], heap) <= 60
    assert [i for _, i in heap.held] == list(range(20))


def test_byte_terms_are_the_contract_terms():
    random.seed(8)
    for _ in range(300):
        text = "".join(random.choices([*map(chr, range(128)), "é", "漢", "😀", " ", "\u0085"], k=80))
        assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)
