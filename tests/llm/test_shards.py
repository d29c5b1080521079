import hashlib
import os
import time

import numpy as np
import pyarrow.parquet as pq

from walkmoments.llm import shards


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 7, 100, 4097, 65_537):
        got = shards.feistel(np.arange(size), size)
        assert np.array_equal(np.sort(got), np.arange(size))
    a = shards.feistel(np.arange(4097), 4097)
    assert not np.array_equal(a, shards.feistel(np.arange(4097), 4097, key=2)) and np.abs(np.diff(a)).mean() > 500


def test_shards_hold_every_document(spark, tmp_path):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rows += [{"doc_id": None, "text": None}, {"doc_id": -1, "text": ""}, {"doc_id": 5, "text": "same"}, {"doc_id": 5, "text": "same"}, {"doc_id": -2, "text": "long " * 20000}]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], 1) for r in rows], "doc_id long, text string, slot int").repartition(3)
    path = f"file://{tmp_path}/out"
    got = shards.write_shards(docs, path, shards.default_vocabulary(), length=64, per_shard=100).collect()
    total = len(got)
    assert sorted(r.slot for r in got) == sorted(r.sequence for r in got) == list(range(total))
    read = dict(shards.read_slots(path, 0, total))
    assert sorted(read) == list(range(total))
    files = sorted(f for f in os.listdir(f"{tmp_path}/out") if f.startswith("shard"))
    assert len(files) == -(-total // 100) and not [f for f in os.listdir(f"{tmp_path}/out") if f.startswith(".")]
    for r in got[:50]:
        with open(f"{tmp_path}/out/shard-{r.shard:08d}.bin", "rb") as f:
            f.seek(r.byte_offset)
            assert hashlib.sha256(f.read(16 + 128)).hexdigest() == r.record_sha256
    enc, end = shards.encoder(shards.default_vocabulary())
    stream = np.concatenate([read[r.slot] for r in sorted(got, key=lambda r: r.sequence)])
    cuts = np.flatnonzero(stream == end)
    texts = [enc.decode(x[x != end].tolist()) for x in np.split(stream, cuts + 1)][: len(cuts)]
    assert sorted(texts) == sorted(r["text"] or "" for r in rows)
    assert [s for s, _ in shards.read_slots(path, 150, 70)] == list(range(150, 220))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shards.write_shards(docs, f"file://{tmp_path}/none", shards.default_vocabulary()).count() == 0


def test_long_runs_and_second_actions(spark, tmp_path):
    texts = [" " * 1_000_000, "a" * 1_000_000, "x " + "\n" * 9000 + " y", "w" * 5000 + " tail " + "\u00e9" * 4097, "plain text"]
    for t in texts + [" " + "b" * 4097, "b" * 4096 + " c", ""]:
        assert "".join(shards.pieces(t)) == t
    assert list(shards.pieces("plain  text")) == ["plain  text"] and list(shards.pieces("a" + " " * 5000 + "b"))[-1] == " b"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    path = f"file://{tmp_path}/out"
    df = shards.write_shards(docs, path, shards.default_vocabulary(), length=64, per_shard=100)
    first = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, df.collect())) == first  # a second action meets the files of the first
    assert not [f for f in os.listdir(f"{tmp_path}/out") if f.startswith(".")]
    enc, end = shards.encoder(shards.default_vocabulary())
    read = dict(shards.read_slots(path, 0, len(first)))
    stream = np.concatenate([read[r[0]] for r in sorted(first, key=lambda r: r[3])])
    cuts = np.flatnonzero(stream == end)
    assert sorted(enc.decode(x[x != end].tolist()) for x in np.split(stream, cuts + 1)[: len(cuts)]) == sorted(texts)


def test_runs_just_below_the_limit_take_linear_time():
    text = ("x" * 4000 + " ") * 2500  # 10 MB
    start = time.perf_counter()
    assert list(shards.pieces(text)) == [text]
    assert time.perf_counter() - start < 5
