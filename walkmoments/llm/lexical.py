"""Ranked lexical search (operator 12): WAND over document shards.

Documents are split into terms once: bytes outside ASCII letters and digits and multi-byte characters part
them, and A-Z are lowered. What is written are postings only, for each document its number of terms and how
often it holds each term that an item asks for. Counts over that table give N, L and each term's documents,
hence its integer weight.

A task reads the postings as shards of at most SHARD_DOCS documents and SHARD_POSTINGS postings, in
ascending order of doc_id within a shard. A term's list holds its documents, its exact contributions and
their maximum. For each item WAND keeps one cursor a term, sorted by document: maxima are added up until they
reach the bar, the k-th best score so far, and the cursor where that happens is the pivot. If the first
cursor stands on the pivot's document, that is scored, else the cursors before it skip to that document; what
lies between cannot reach the bar. The bar and heap of an item go on through all shards of a task. Documents
that could equal the bar are scored too, so ties are exact. The tasks' heaps are merged by Spark.

Items are the stated query set, taken in blocks of at most BLOCK_TERMS terms, each against all documents; only
one block's terms, their weights and maxima are on the driver and in the tasks at a time.

Defined results: a null or empty text has no terms and is not counted in N; documents with a null doc_id are
counted and rank after others of the same score; rows that repeat are documents of their own; an item without
a term that any document holds gives no rows; a null item text is empty; items without item_id take no part,
and several rows of one item_id count as one, the one with the least text; very long texts are read whole, a
document is never cut; equal scores rank by doc_id; an empty table of either kind gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, text_or_empty

SHARD_DOCS, SHARD_POSTINGS, BLOCK_TERMS = 16_384, 1_000_000, 1 << 18
#: Every byte of a text becomes itself, its lower case or a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Stands for a missing doc_id: after all others.
NO_ID = (1 << 63) - 1
END = 1 << 62


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the text), tids and tfs of the asked terms, for every document with a term."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, tids, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = sorted(Counter(map(number.get, words)).items(), key=lambda x: -1 if x[0] is None else x[0])
                if found[0][0] is None:
                    del found[0]
                ids.append(doc_id)
                counts.append(len(words))
                tids += [t for t, _ in found]
                tfs += [n for _, n in found]
                ends.append(len(tids))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (tids, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), *lists], names=["doc_id", "n", "tids", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, tids array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Postings by term of some documents, in ascending order of doc_id."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        rows = pa.Table.from_batches(batches)
        ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order].tolist()
        m = 75 + 25 * rows.column("n").to_numpy() * n_docs // n_terms
        tids, tfs, whose = [], [], []
        for batch, start in zip(batches, np.cumsum([0] + [b.num_rows for b in batches])):
            tids.append(batch.column(2).flatten().to_numpy())
            tfs.append(batch.column(3).flatten().to_numpy().astype(np.int64))
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            whose.append(start + np.repeat(np.arange(batch.num_rows), lengths))
        tid, tf, row = np.concatenate(tids), np.concatenate(tfs), np.concatenate(whose)
        impact = weights[tid] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
        by_term = np.lexsort((place[row], tid))
        self.docs, self.impacts, tid = place[row][by_term], impact[by_term], tid[by_term]
        self.starts = np.searchsorted(tid, np.arange(len(weights) + 1))
        self.lists: dict[int, tuple[list, list, int]] = {}

    def term(self, t: int) -> tuple[list, list, int]:
        """Documents, contributions and the greatest of them; the documents end with END."""
        found = self.lists.get(t)
        if found is None:
            a, b = self.starts[t], self.starts[t + 1]
            impacts = self.impacts[a:b]
            found = self.lists[t] = ([*self.docs[a:b].tolist(), END], impacts.tolist(), int(impacts.max(initial=0)))
        return found


class Heap:
    """The k best (score, doc_id), greater scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.bar, self.held = k, 1, []  # only scores above 0 count

    def offer(self, score: int, doc_id: int) -> None:
        entry = (-score, doc_id)
        if len(self.held) == self.k:
            if entry >= self.held[-1]:
                return
            self.held.pop()
        self.held.insert(bisect_left(self.held, entry), entry)
        if len(self.held) == self.k:
            self.bar = -self.held[-1][0]


def wand(shard: Shard, item: list[tuple[int, int]], heap: Heap) -> int:
    """Offers the documents that can reach the heap's bar; returns how many were scored. ``item``: (term, repeats)."""
    cursors = []
    for t, repeats in item:
        docs, impacts, most = shard.term(t)
        if most:
            cursors.append([docs[0], t, 0, repeats * most, repeats, docs, impacts])
    cursors.sort()
    ids, scored = shard.ids, 0
    while True:
        bound, bar, pivot = 0, heap.bar, None
        for c in cursors:
            bound += c[3]
            if bound >= bar:
                pivot = c[0]
                break
        if pivot is None or pivot == END:
            return scored
        if cursors[0][0] == pivot:
            total = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                at = c[2]
                total += c[4] * c[6][at]
                c[2] = at + 1
                c[0] = c[5][at + 1]
            scored += 1
            if total >= bar:
                heap.offer(total, ids[pivot])
        else:
            for c in cursors:
                if c[0] >= pivot:
                    break
                c[2] = at = bisect_left(c[5], pivot, c[2] + 1)
                c[0] = c[5][at]
        cursors.sort()


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of postings together, up to SHARD_DOCS documents and SHARD_POSTINGS postings."""
    held: list[pa.RecordBatch] = []
    docs = size = 0
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            ends = whole.column(2).offsets.to_numpy()
            room = int(np.searchsorted(ends, ends[at] + SHARD_POSTINGS - size, side="right")) - 1 - at
            n = max(1 if not held else 0, min(room, SHARD_DOCS - docs, whole.num_rows - at))
            if n:
                part = whole.slice(at, n)
                held.append(part)
                at, docs, size = at + n, docs + n, size + int(ends[at + n] - ends[at])
            if at < whole.num_rows:
                yield held
                held, docs, size = [], 0, 0
    if held:
        yield held


def ranked(found: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, items: list[tuple[int, list[tuple[int, int]]]], k: int) -> DataFrame:
    """item_id, doc_id, score, rank from postings; ``items``: (item_id, [(term, repeats)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in items]
        for part in shards_of(batches):
            shard = Shard(part, weights, n_docs, n_terms)
            for (_, terms), heap in zip(items, heaps):
                wand(shard, terms, heap)
        rows = [(item_id, doc_id, -minus) for (item_id, _), heap in zip(items, heaps) for minus, doc_id in heap.held]
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    best = found.mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def item_blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, Counter]]]:
    """Items with the counts of their terms, in blocks of at most ``size`` terms in all (a longer item stands alone)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).filter("item_id is not null")
    part: list[tuple[int, Counter]] = []
    held = 0
    for row in rows.groupBy("item_id").agg(F.min("text").alias("text")).toLocalIterator():
        terms = Counter(terms_of(row["text"].encode()))
        if part and held + len(terms) > size:
            yield part
            part, held = [], 0
        if terms:
            part.append((row["item_id"], terms))
            held += len(terms)
    if part:
        yield part


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text)."""
    spark, parts = docs.sparkSession, []
    schema = "item_id long, rank int, doc_id long, score long"
    for part in item_blocks(items, block):
        terms = sorted({t for _, found in part for t in found})
        number = {t: i for i, t in enumerate(terms)}
        with arrow_batches(spark):
            found = materialize(postings(docs, terms), "search-postings")
            sums = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
            if not sums["docs"]:
                break
            held = found.select(F.explode("tids").alias("tid")).groupBy("tid").count().collect()  # at most ``block`` rows
            weights = np.zeros(len(terms), np.int64)
            for r in held:
                weights[r["tid"]] = weight(sums["docs"], r["count"])
            asked = [(i, [(number[t], n) for t, n in sorted(x.items())]) for i, x in part]
            parts.append(materialize(ranked(found, weights, sums["docs"], sums["terms"], asked, k), "search-block"))
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[p._shared_path for p in parts])
