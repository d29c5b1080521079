import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.llm.brute import quality_stats
from walkmoments.llm import quality

SF = "/root/testdata/sf0.001"


def stats_of(docs):
    return [(r.doc_id, tuple(r["__q_stats"])) for r in quality.with_stats(docs).select("doc_id", "__q_stats").collect()]


def test_stats_match_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: quality_stats(r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert dict(stats_of(docs)) == want
    monkeypatch.setattr(quality, "INDEX_BITS", 4)  # the way of very long word lists
    random.seed(5)
    texts = [" ".join(random.choices("ab c\nd", k=n)) for n in (0, 3, 15, 17, 40, 300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(stats_of(rows)) == {i: quality_stats(t) for i, t in enumerate(texts)}


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c a b c"), (5, "x " * 60), (5, "x " * 60), (6, "  \x0b a\n\na\na")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    got = stats_of(docs)
    assert [s for _, s in got] == [quality_stats(t) for _, t in rows]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stats = quality.with_stats(docs).select("doc_id", "__q_stats")
    rules = quality.fit(stats, empty)
    assert rules.rules == ()
    judged = quality.judge(stats, rules).collect()
    assert all(r.base_failed for r in judged)
    assert quality.judge(quality.with_stats(docs.limit(0)), rules).count() == 0


def test_learned_list_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = quality.with_stats(docs).select("doc_id", "__q_stats").cache()
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4)) == 0
    rules = quality.fit(stats, labels.filter(~held))
    assert rules.rules
    judged = quality.judge(stats, rules).filter(~F.col("base_failed")).join(labels.filter(held), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.6 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality.judge(quality.with_stats(docs), quality.DecisionList())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_covering_goes_on_past_a_rule_that_misses_its_precision():
    blank = dict.fromkeys(quality.FEATURES, 0)
    edges = {f: [0.1, 0.2, 0.3] for f in quality.FEATURES}
    groups = [  # bins, bad, good
        ({}, 0, 2000),
        ({"dup_line_ratio": 3}, 300, 0),
        ({"symbol_ratio": 3}, 400, 100),  # no threshold parts these: precision 0.8
        ({"exclaim_ratio": 3, "upper_ratio": 3}, 100, 0),
        ({"exclaim_ratio": 3}, 0, 60),
        ({"upper_ratio": 3}, 0, 60),
    ]
    cells = [blank | bins | {"fold": fold, "quality": q, "count": n} for bins, bad, good in groups for fold in range(3) for q, n in ((0, bad), (1, good)) if n]
    found = {frozenset(c.feature for c in rule) for rule in quality.learn(edges, cells).rules}
    assert frozenset({"dup_line_ratio"}) in found and frozenset({"exclaim_ratio", "upper_ratio"}) in found
    assert not any("symbol_ratio" in rule for rule in found)
    assert quality.learn(edges, [c for c in cells if c["quality"]]).rules == () == quality.learn(edges, []).rules
