"""Token-ID / binary output (operator 8): training-order materialisation.

1. Each map task encodes its documents, ends each with the end token, and cuts the stream into
   sequences of LENGTH ids; only a task's last sequence is padded. The sequences are written once
   to the shared folder: from then on their numbering, by task and place, is fixed.
2. A keyed Feistel network with cycle-walking permutes the sequence numbers 0..M-1: every sequence
   gets a global slot, no two the same, computed from its number alone.
3. Slots are dealt by ranges; a task takes whole shards, fills records of a fixed stride and writes
   one file for each, under a name of its own that is renamed when complete. Slot s lies in shard
   ``s // per_shard`` at byte ``s % per_shard * stride``, so reading in training order is
   sequential and can resume at any slot.

Sequences are numbered by the map task that wrote them and their place in it: with the same key, input
files and split sizes a rerun gives the same order, another layout of the same rows another one. What
is written in step 1 holds for all later steps, so lost tasks and repeated actions write the same shards.

Record: number of real ids (uint32), zero (uint32), sequence number (int64), LENGTH ids (uint16),
padded with the end token; all little-endian. Ids must fit 16 bits.

Defined results: a null or empty text is a document of the end token alone; a null doc_id is kept
as such; repeated rows are encoded each; very long texts span as many sequences as they need; runs of
more than RUN blanks, or of more than RUN other characters, are encoded in pieces of RUN, as the library
fails on the former and takes quadratic time on the latter; an empty table writes no shard and gives no
row. More than MOST_TASKS map tasks raise an error. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import materialize, shared_dir

LENGTH, PER_SHARD, HEADER = 2048, 2048, 16
KEY = 0x5EED_0F_7A1
ROUNDS = 4
#: Offsets of so many map tasks may be broadcast (16 bytes each).
MOST_TASKS = 1 << 20
#: Shards that one task writes.
TASK_SHARDS = 4
#: Code points of blanks, or of other characters, beyond which a run is cut.
RUN = 4096
LONG_RUN = re.compile(rf"(?<!\s)\s{{{RUN + 1},}}|(?<!\S)\S{{{RUN + 1},}}")  # tried where a run begins only: linear


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict = {}


def encoder(path: str):
    """The library's encoder of a rank file, and the end token: the first free id."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _encoders[path]


def pieces(text: str) -> Iterator[str]:
    """``text`` in order, cut only inside long runs; a blank before a word stays with it."""
    at = 0
    for m in LONG_RUN.finditer(text):
        start, end = m.start(), m.end()
        if text[start].isspace():
            start, end = max(at, start), end - 1  # the last blank may belong to the word that follows
        elif start > at and text[start - 1].isspace():
            start -= 1
        if start > at:
            yield text[at:start]
        for k in range(start, end, RUN):
            yield text[k : min(k + RUN, end)]
        at = end
    if at < len(text):
        yield text[at:]


def feistel(index: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..size-1, applied to each number of ``index``.

    A balanced network over the least even number of bits that holds ``size``; results beyond the
    size are permuted again until they fall inside.
    """
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.PCG64([key, size])).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while len(far := np.flatnonzero(out >= np.uint64(size))):
        out[far] = once(out[far])
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """task, number (within the task), first_doc_id, n_tokens, ids (packed uint16) of every sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(vocabulary)
        if end > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        task, number = TaskContext.get().partitionId(), 0
        held = np.zeros(0, np.uint16)  # ids that don't fill a sequence yet
        held_doc = None

        def rows(first: list, sizes: list[int], packed: list[bytes]) -> pa.RecordBatch:
            n = len(first)
            return pa.RecordBatch.from_arrays(
                [pa.array([task] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()), pa.array(first, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())],
                names=["task", "number", "first_doc_id", "n_tokens", "ids"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                names = batch.column(0).to_pylist()
                parts, starts, owners = [held], [0], [held_doc]
                place = len(held)
                for name, text in zip(names, batch.column(1).to_pylist()):
                    ids = [i for part in pieces(text or "") for i in enc.encode_ordinary(part)]
                    ids.append(end)
                    parts.append(np.array(ids, np.uint16))
                    starts.append(place)
                    owners.append(name)
                    place += len(ids)
                stream = np.concatenate(parts)
                full = len(stream) // length
                firsts = np.searchsorted(starts, np.arange(full + 1) * length, side="right") - 1
                if full:
                    yield rows([owners[k] for k in firsts[:full]], [length] * full, [stream[k * length : (k + 1) * length].tobytes() for k in range(full)])
                    number += full
                held, held_doc = stream[full * length :].copy(), owners[firsts[full]]
        if len(held):
            padded = np.concatenate([held, np.full(length - len(held), end, np.uint16)])
            yield rows([held_doc], [len(held)], [padded.tobytes()])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "task int, number long, first_doc_id long, n_tokens int, ids binary")


def write_shards(docs: DataFrame, path: str, vocabulary: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Writes the shards and a manifest below ``path``; one row for each sequence, in any order.

    slot, shard, byte_offset, sequence, first_doc_id, n_tokens, record_sha256.
    """
    import pyarrow.fs as pafs

    kept = materialize(sequences(docs, vocabulary, length), "shard-sequences", "zstd")
    counts = kept.groupBy("task").count()
    tasks = counts.orderBy("task").collect()  # one row for each map task
    if len(tasks) > MOST_TASKS:
        raise ValueError(f"more than {MOST_TASKS} map tasks: read the documents with larger partitions")
    offsets, total = {}, 0
    for r in tasks:
        offsets[r["task"]] = total
        total += r["count"]
    shards = -(-total // per_shard)
    stride = HEADER + 2 * length
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    manifest = {"sequences": total, "length": length, "per_shard": per_shard, "shards": shards, "stride": stride, "header": HEADER, "key": key}
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    starts = docs.sparkSession.sparkContext.broadcast(offsets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                task, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                index = number + np.array([starts.value[t] for t in task.tolist()], np.int64)
                slot = feistel(index, total, key)
                doc = batch.column(2)
                head = np.zeros((len(slot), 4), np.int64)  # slot, sequence, ids, doc_id
                head[:, 0], head[:, 1], head[:, 2] = slot, index, batch.column(3).to_numpy()
                head[:, 3] = doc.fill_null(0).to_numpy()
                known = doc.is_valid().to_numpy(zero_copy_only=False)
                ids = batch.column(4).to_pylist()
                order = np.argsort(slot, kind="stable")
                shard = slot[order] // per_shard
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                out: list[list] = [[], [], [], []]
                for a, z in zip(cuts, np.append(cuts[1:], len(order))):
                    rows = order[a:z]
                    out[0].append(int(shard[a]))
                    out[1].append(head[rows].tobytes())
                    out[2].append(known[rows].tobytes())
                    out[3].append(press(b"".join([ids[k] for k in rows])))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["shard", "head", "known", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        store, folder = pafs.FileSystem.from_uri(path)
        files: dict[int, np.ndarray] = {}
        filled: dict[int, int] = {}

        def done(shard: int) -> None:
            temporary = f"{folder}/.{shard:08d}-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(memoryview(files.pop(shard)).cast("B"))
            put(store, temporary, f"{folder}/shard-{shard:08d}.bin")

        for batch in batches:
            for shard, head, known, ids in zip(*[c.to_pylist() for c in batch.columns]):
                rows = min(per_shard, total - shard * per_shard)
                if shard not in files:
                    files[shard], filled[shard] = np.zeros((rows, stride), np.uint8), 0
                h = np.frombuffer(head, np.int64).reshape(-1, 4)
                at = h[:, 0] - shard * per_shard
                body = files[shard]
                body[at, 0:4] = h[:, 2].astype("<u4").view(np.uint8).reshape(-1, 4)
                body[at, 8:16] = h[:, 1].astype("<i8").view(np.uint8).reshape(-1, 8)
                body[at, HEADER:] = np.frombuffer(unpress(ids), np.uint8).reshape(-1, 2 * length)
                digests = [hashlib.sha256(body[k].tobytes()).hexdigest() for k in at]
                mask = ~np.frombuffer(known, bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[:, 0]),
                        pa.array(np.full(len(h), shard, np.int32)),
                        pa.array(at * stride),
                        pa.array(h[:, 1]),
                        pa.array(h[:, 3], mask=mask),
                        pa.array(h[:, 2].astype(np.int32)),
                        pa.array(digests),
                    ],
                    names=["slot", "shard", "byte_offset", "sequence", "first_doc_id", "n_tokens", "record_sha256"],
                )
                filled[shard] += len(h)
                if filled[shard] == rows:
                    done(shard)
        if files:
            raise RuntimeError(f"shards left incomplete: {sorted(files)}")

    schema = "slot long, shard int, byte_offset long, sequence long, first_doc_id long, n_tokens int, record_sha256 string"
    placed = kept.mapInArrow(place, "shard int, head binary, known binary, ids binary")
    dealt = placed.repartitionById(max(1, -(-shards // TASK_SHARDS)), F.floor(F.col("shard") / TASK_SHARDS).cast("int"))  # a range of shards each
    return dealt.mapInArrow(fill, schema)


def put(store, temporary: str, name: str) -> None:
    """Give a complete file its name. Where another attempt was first, its equal file stays: not every store renames onto a name."""
    import pyarrow.fs as pafs

    if store.get_file_info(name).type == pafs.FileType.NotFound:
        try:
            store.move(temporary, name)
            return
        except OSError:
            if store.get_file_info(name).type == pafs.FileType.NotFound:
                raise
    if store.get_file_info(temporary).type != pafs.FileType.NotFound:
        store.delete_file(temporary)


def read_slots(path: str, first: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, real ids) from slot ``first`` on, by sequential reads."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        m = json.loads(f.read())
    end = min(first + count, m["sequences"])
    while first < end:
        shard, place = divmod(first, m["per_shard"])
        with fs.open_input_file(os.path.join(base, f"shard-{shard:08d}.bin")) as f:
            f.seek(place * m["stride"])
            for _ in range(min(end - first, m["per_shard"] - place)):
                record = f.read(m["stride"])
                n = int(np.frombuffer(record[:4], "<u4")[0])
                yield first, np.frombuffer(record[m["header"] :], "<u2")[:n]
                first += 1


def shard_folder(docs: DataFrame) -> str:
    base = shared_dir(docs.sparkSession)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + os.path.abspath(base)}/shards-{uuid.uuid4().hex}"
