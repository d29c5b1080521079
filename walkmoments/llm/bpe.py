"""BPE encoding and decoding (operator 10), by contiguous rank arrays.

A text is cut into words by the tokenizer file's own pattern. Each distinct word is merged once
per worker: the word's part boundaries and the ranks of adjacent parts lie in two contiguous
arrays; the minimum rank is found by a scan, its boundary deleted and the two neighbouring ranks
refreshed. Words longer than ``SHORT`` bytes take a heap with linked parts, which merges in the
same order in n log n steps. Nothing is trained; the vocabulary file's path is a parameter.

Defined results: a null text counts as empty (no ids, empty decoded text); special tokens that
occur in a text are encoded as their own ids, as the tokenizers library does; very long texts
are encoded whole; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words up to so many bytes use the rank array.
SHORT = 512
#: A task keeps two generations of at most so many words each, about 50 MB a generation.
CACHE_WORDS = 300_000
NEVER = 1 << 30

# Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(spare)
            spare += 1
    return [symbols[b] for b in range(256)]


class RankBpe:
    """Encoder and decoder of one byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol_byte = {s: b for b, s in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(symbol_byte[c] for c in t) for t, i in vocab.items()}
        self.id_of = {b: i for i, b in self.token_bytes.items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[bytes(symbol_byte[c] for c in left), bytes(symbol_byte[c] for c in right)] = r
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(PATTERN).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else None
        self.size = max(self.token_bytes, default=-1) + 1
        self.table = [self.token_bytes.get(i, b"") for i in range(self.size)]
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge_short(self, word: bytes) -> list[int]:
        """Ids of one word: part boundaries and adjacent ranks in contiguous arrays."""
        rank = self.rank
        cuts = list(range(len(word) + 1))
        ranks = [rank.get((word[i : i + 1], word[i + 1 : i + 2]), NEVER) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            del cuts[i + 1], ranks[i]
            here = word[cuts[i] : cuts[i + 1]]
            if i < len(ranks):
                ranks[i] = rank.get((here, word[cuts[i + 1] : cuts[i + 2]]), NEVER)
            if i:
                ranks[i - 1] = rank.get((word[cuts[i - 1] : cuts[i]], here), NEVER)
        return [self.id_of[word[a:b]] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges in the same order for a long word, by a heap over linked parts."""
        n, rank = len(word), self.rank
        end = list(range(1, n + 1))  # end of the part that starts here; 0: merged away
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and (m := end[a]) < n and (r := rank.get((word[a:m], word[m : end[m]]))) is not None:
                heapq.heappush(heap, (r, a, m, end[m]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, m, z = heapq.heappop(heap)
            if end[a] != m or end[m] != z:
                continue
            end[a], end[m] = z, 0
            if z < n:
                before[z] = a
            offer(before[a])
            offer(a)
        return [self.id_of[word[a : end[a]]] for a in range(n) if end[a]]

    def pack(self, word: str) -> bytes:
        """Packed ids of a word that the young generation lacked; it is there afterwards, if short."""
        packed = self.cache.get(word) or self.old.get(word)
        if packed is None:
            raw = word.encode("utf-8")
            short = len(raw) <= SHORT
            packed = np.array(self.merge_short(raw) if short else self.merge_long(raw), dtype="<u4").tobytes()
            if not short:
                return packed
        if len(self.cache) >= CACHE_WORDS:
            self.cache, self.old = {}, self.cache
        self.cache[word] = packed
        return packed

    def forget(self) -> None:
        """Empties the word cache: workers outlive their tasks and share an executor's memory with other stages."""
        self.cache, self.old = {}, {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut_special is not None and any(s in text for s in self.special):
            parts = self.cut_special(text)
            return b"".join(self.encode_plain(p) if k % 2 == 0 else np.array([self.special[p]], "<u4").tobytes() for k, p in enumerate(parts))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        words = self.words(text)
        get = self.cache.get
        packed = [get(w) for w in words]
        if None in packed:
            packed = [p if p is not None else self.pack(w) for w, p in zip(words, packed)]
        return b"".join(packed)

    def decode(self, packed: bytes) -> str:
        table, size = self.table, self.size
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join([table[i] if i < size else b"" for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, RankBpe] = {}


def load(path: str) -> RankBpe:
    """One encoder per worker and file."""
    if path not in _loaded:
        _loaded[path] = RankBpe(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """id, ids (packed little-endian uint32), n_tokens and, if asked, the decoded text of every row."""
    schema = f"{id_col} long, ids binary, n_tokens long" + (", decoded string" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decode:
                    cols.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.split(" ")[0] for f in schema.split(", ")])
        bpe.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``.

    Encodes, decodes the ids again and hashes both inside one pass, so neither ids nor decoded
    texts leave the worker. No shuffle: the plan is a scan and one Arrow map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(vocabulary), hashlib.sha256
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                        pa.array([sha(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        bpe.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
