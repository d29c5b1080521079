import hashlib

import corpus_pipeline
from tests.llm.brute import WORD, base_spans, components_by_all_pairs, quality_stats
from walkmoments.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (900001, "", "en", None, 0), (900002, "w " * 49, "en", "src1", 98)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "secret scans", "mixing", "BPE"]

    good = stages["quality rules"](spark, docs, SF).cache()
    stats = quality.with_stats(docs).select("doc_id", "__q_stats")
    rules = quality.fit(stats, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r.doc_id for r in quality.judge(stats, rules).filter("kept").collect()}
    rows = good.collect()
    assert {r.doc_id for r in rows} == judged and good.columns == docs.columns
    for r in rows:
        n, _, _, _, repeat, *_ = quality_stats(r.text)
        assert n >= 50 and 100 * repeat <= 50 * n

    single = stages["near duplicates"](spark, good, SF).cache()
    comps = components_by_all_pairs([(r.doc_id, r.text) for r in rows], 5, 8, 10)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in comps.values()})

    clean = stages["secret scans"](spark, single, SF).cache()
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        old = before.pop(r.doc_id)
        assert (r.lang, r.source) == (old.lang, old.source) and r.n_chars == len(r.text)
        assert not base_spans(r.text) and (base_spans(old.text) or r.text == old.text)
    assert not before

    mixed = stages["mixing"](spark, clean, SF).cache()
    sizes = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in clean.collect()}
    total = sum(n for _, n in sizes.values())
    taken = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == docs.columns and max(map(taken.count, taken)) <= 2
    assert abs(sum(sizes[i][1] for i in taken) - 1.5 * total) < 0.1 * total

    last = stages["BPE"](spark, mixed, SF).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    own = bpe.RankBpe(bpe.default_vocabulary())
    assert len(last) == len(taken)
    for r in last[:50]:
        assert r.ids_sha256 == hashlib.sha256(own.encode(texts[r.doc_id])).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    ran = corpus_pipeline.run(spark, SF)
    assert ran.count() > 0 and ran.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_repeats_nulls_and_empty(spark):
    from walkmoments.llm import ngram_join

    text = " ".join(f"w{k}" for k in range(80))
    rows = [(5, text, "a"), (5, text, "b"), (3, text + " x", "c"), (None, text, "d"), (None, "q r s t u", "e"), (None, "q r s t u", "e"), (7, None, "f"), (7, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, comp string")
    got = sorted(map(tuple, ngram_join.keep_one(docs, 5, 8, 10).collect()), key=str)
    assert got == sorted([(3, text + " x", "c"), (None, "q r s t u", "e"), (7, None, "f"), (7, None, "f")], key=str)
    assert ngram_join.keep_one(docs.limit(0), 5, 8, 10).count() == 0
