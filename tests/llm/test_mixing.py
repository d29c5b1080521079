import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.llm.brute import WORD
from walkmoments.llm import mixing


def fill(total, caps, weights):
    """Share by weight, stop at caps, share the excess again until none is above."""
    share, done = {}, set()
    while len(done) < len(caps):
        left = total - sum(caps[k] for k in done)
        w = sum(weights[k] for k in caps if k not in done)
        share = {k: caps[k] if k in done else left * weights[k] / w for k in caps}
        over = {k for k in caps if k not in done and share[k] > caps[k]}
        if not over:
            break
        done |= over
        share = dict(caps)
    return share


def test_targets_and_whole_result(spark):
    sf = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs}
    by_source = {}
    for r in docs:
        by_source[r["source"]] = by_source.get(r["source"], 0) + sizes[r["doc_id"]]
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    want = fill(1.5 * sum(sizes.values()), {s: 2.0 * by_source[s] for s in names}, weights)
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    again = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source_of = {r["doc_id"]: r["source"] for r in docs}
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = source_of[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == by_source[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    longest = max(sizes.values())
    assert all(abs(taken[s] - want[s]) <= longest / 2 + 1 for s in names)
    assert sum(abs(taken[s] - want[s]) for s in names) < 0.05 * sum(want.values())
    repeated = mixing.repeat_to_targets(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("doc_id").count().collect()
    copies = {r.doc_id: r["count"] for r in repeated}
    assert all(copies.get(r.doc_id, 0) * r.size == r.taken for r in got)


def test_edge_rows(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (None, "d e", "y"), (5, "w " * 9, "z")] + [(9, "same row here", "y")] * 30
    docs = spark.createDataFrame([(i, t, s, 5) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    hot = [r for r in got if r.doc_id == 9]
    assert abs(sum(r.taken for r in got if r.doc_id in (None, 9)) - hot[0].target) <= 3
    assert all(r.target == 0 for r in got if r.doc_id in (2, 3))
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = docs.withColumn("copies", F.lit(9)).withColumn("certain", F.lit("z")).withColumn("target", F.lit(None))
    assert mixing.repeat_to_targets(clash).columns == clash.columns
    assert mixing.repeat_to_targets(clash).filter("certain = 'z' and copies = 9").count() > 0
    blank = mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert all(r.taken == 0 and r.target == 0 for r in blank)


def test_many_sources_and_a_very_long_text(spark):
    sizes = {f"h{k:05d}": 1 + k * 7919 % 50 for k in range(3000)} | {"long": 400_000, "empty": 0}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string").repartition(5)
    names = sorted(sizes, key=str.encode)
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    want = fill(1.5 * sum(sizes.values()), {s: 2.0 * sizes[s] for s in names}, weights)
    rows = mixing.sized(docs)
    plan = mixing.allocate(rows)
    got = {r["__m_key"][1:]: r.target for r in plan.collect()}
    assert set(got) == set(names) and all(abs(got[s] - want[s]) < 1e-6 * max(1.0, want[s]) for s in names)
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
    assert all(t in (0, n, 2 * n) for n, t in taken.values()) and len(taken) == 3002
