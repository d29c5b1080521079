import hashlib
import random

import numpy as np
import pytest

from walkmoments.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_vocabulary()
    return bpe.RankBpe(path), tokenizers.Tokenizer.from_file(path)


def test_same_ids_and_text_as_the_library(pair):
    own, lib = pair
    random.seed(7)
    alphabet = [*"abc '\"sstd \n\té漢1٣!?.\x1c\x85", "<|endoftext|>", "'ll", "   ", "token", " the"]
    for _ in range(500):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == lib.decode(ids, skip_special_tokens=False)


def test_long_words_merge_alike(pair):
    own, _ = pair
    random.seed(1)
    for word in (b"a" * 700, b"abcab" * 200, bytes(random.choices(b"etaoin", k=1500))):
        assert own.merge_long(word) == own.merge_short(word)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "x" * 20000), (4, "x" * 20000), (5, "<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.round_trip_digests(docs, bpe.default_vocabulary()).collect()
    assert len(got) == 6
    for r, (i, t) in zip(got, rows):
        assert r.doc_id == i and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[0].n_tokens == 0 and got[5].n_tokens == 1
    assert bpe.round_trip_digests(docs.limit(0), bpe.default_vocabulary()).count() == 0
    full = bpe.encode_texts(docs, bpe.default_vocabulary()).collect()
    assert [r.decoded for r in full] == [t or "" for _, t in rows]
