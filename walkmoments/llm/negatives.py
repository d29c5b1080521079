"""Hard-negative mining (operator 13): bit-sliced integer products.

Components become integers, floor(scale * x); shifted by 2 ** (planes - 1) they are unsigned numbers of
``planes`` bits. A row's score with an anchor is the sum over bit planes of 2 ** p times the anchor's
product with the plane, less a constant of the anchor. Planes are taken most significant first. What the
planes below p can still add lies between (2 ** p - 1) times the sum of the anchor's negative and of its
positive components, so every plane halves a pair's score interval, and a pair is dropped as soon as its
interval cannot qualify. While many pairs of a tile are left a plane is one product of matrices, later the
remaining pairs are listed. All sums are whole numbers below 2 ** 53 and hence exact in doubles.

Anchors are the stated query set. They are taken in blocks of BLOCK, each against all rows in two passes:
the first keeps the best positives of each anchor (a pair qualifies while its upper end reaches the k-th
best lower end met so far), the second the best negatives of each anchor and positive, whose scores lie
between two parts of the positive's score. A task holds one tile of pairs and the lists of one block,
whatever its number of rows; its lists are merged by Spark. Only one block of anchors and its positives are
on the driver at a time. Work grows with anchors times rows, as the result does by its definition.

Defined results: rows with a null id, a null label, a null vector, a null or non-finite component, or
another length than most take no part; a zero or empty vector does; several rows of one id count as one,
the one with the least vector, then label; equal scores rank by id; an anchor without positives, and a
positive without negatives in its range (any of a score below 0), give no row; an empty table gives an
empty table; texts are not read, nor other columns, whatever their names. Integer vectors whose scores
could reach 2 ** 53 raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Anchors of a block; anchors and rows of a tile of pairs; pairs of a tile are listed below this share.
BLOCK, TILE_ANCHORS, TILE_ROWS, LISTED = 4096, 256, 2048, 0.125
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90


def integer_rows(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, c (array of long) of the rows that take part, one for each id, written."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~bad)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("m")).select("vec_id", "m.label", "m.v")
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))
    rows = materialize(rows.select("vec_id", "label", whole.alias("c")), "negatives-rows")
    lengths = rows.groupBy(F.size("c").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("c") == (lengths["n"] if lengths else -1))


@dataclass
class Anchors:
    """One block of anchors: ids, labels, integer vectors, and the number of bit planes of any row."""

    ids: np.ndarray
    labels: np.ndarray
    c: np.ndarray
    planes: int

    def __post_init__(self) -> None:
        # a plane's product is at most the sum of the components' sizes: exact in single precision below 2 ** 24
        self.kind = np.float32 if np.abs(self.c).sum(1).max(initial=0) < 1 << 24 else np.float64
        self.start = -float(1 << (self.planes - 1)) * self.c.sum(1)
        self.negative = np.minimum(self.c, 0).sum(1).astype(float)
        self.positive = np.maximum(self.c, 0).sum(1).astype(float)


def plane(c: np.ndarray, planes: int, p: int) -> np.ndarray:
    """Bit ``p`` of the shifted components, 0 or 1."""
    return ((c + (1 << (planes - 1))) >> p) & 1


def sliced_scores(
    a: Anchors, chosen: slice, c: np.ndarray, alive: np.ndarray, qualifies: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (place in ``chosen``), row and exact score of the pairs of one tile that stay to the last plane.

    ``qualifies(low, high, who)`` judges intervals: arrays (anchors, rows) with ``who`` None, or lists of
    pairs whose anchors are ``who``. ``alive`` marks the pairs that take part at all.
    """
    mine = a.c[chosen]
    score = np.repeat(a.start[chosen, None], len(c), axis=1)
    negative, positive = a.negative[chosen], a.positive[chosen]
    dense = mine.astype(a.kind)
    p = a.planes
    while p and np.count_nonzero(alive) > LISTED * alive.size:
        p -= 1
        score += float(1 << p) * (dense @ plane(c, a.planes, p).astype(a.kind).T)
        rest = float((1 << p) - 1)
        alive &= qualifies(score + (rest * negative)[:, None], score + (rest * positive)[:, None], None)
    who, row = np.nonzero(alive)
    listed = score[who, row]
    while p and len(who):
        p -= 1
        bits = plane(c, a.planes, p)
        step = max(1, (1 << 22) // max(1, mine.shape[1]))  # products held at a time
        for s in range(0, len(who), step):
            listed[s : s + step] += float(1 << p) * np.einsum("ij,ij->i", mine[who[s : s + step]], bits[row[s : s + step]])
        rest = float((1 << p) - 1)
        keep = qualifies(listed + rest * negative[who], listed + rest * positive[who], who)
        who, row, listed = who[keep], row[keep], listed[keep]
    return who, row, listed


class Best:
    """The first k (score, id) of each of many lists, higher scores first, ties by smaller id."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.who, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.bar = np.full(lists, -np.inf)  # the k-th score of a full list

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.bar[who]
        if not keep.any():
            return
        who, score, ids = np.concatenate([self.who, who[keep]]), np.concatenate([self.score, score[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        self.who, self.score, self.ids = who[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        self.bar[self.who[last]] = self.score[last]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(at, TILE_ROWS)
            c = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), c


def _chosen(n: int) -> list[slice]:
    return [slice(at, min(at + TILE_ANCHORS, n)) for at in range(0, n, TILE_ANCHORS)]


def positives_of(rows: DataFrame, a: Anchors, k: int = POSITIVES) -> DataFrame:
    """anchor_id, rank, positive_id, positive_score: the first k other rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(a.ids), k)
        for ids, labels, c in _tiles(batches):
            for chosen in _chosen(len(a.ids)):
                alive = (a.labels[chosen, None] == labels) & (a.ids[chosen, None] != ids)

                def qualifies(low: np.ndarray, high: np.ndarray, who: np.ndarray | None, alive: np.ndarray = alive, chosen: slice = chosen) -> np.ndarray:
                    bar = best.bar[chosen]
                    if who is not None:
                        return high >= bar[who]
                    if low.shape[1] > k:  # the k-th lower end of the tile's own pairs
                        lows = np.where(alive, low, -np.inf)
                        bar = np.maximum(bar, np.partition(lows, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
                    return high >= bar[:, None]

                who, row, score = sliced_scores(a, chosen, c, alive, qualifies)
                best.add(who + chosen.start, score, ids[row])
        yield pa.RecordBatch.from_arrays([pa.array(a.ids[best.who]), pa.array(best.ids), pa.array(best.score.astype(np.int64))], names=["anchor_id", "positive_id", "positive_score"])

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def negatives_of(rows: DataFrame, a: Anchors, positives: list, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; ``positives``: rows of :func:`positives_of`."""
    at = {int(i): n for n, i in enumerate(a.ids)}
    places = 1 + max((r["rank"] for r in positives), default=0)
    # integer ends of each range of scores; an unused place has an empty one
    least, most = np.full((len(a.ids), places), np.inf), np.full((len(a.ids), places), -np.inf)
    ids, scores = np.zeros((len(a.ids), places), np.int64), np.zeros((len(a.ids), places), np.int64)
    for r in positives:
        n, j, s = at[r["anchor_id"]], r["rank"] - 1, r["positive_score"]
        least[n, j], most[n, j], ids[n, j], scores[n, j] = -(-low * s // 100), high * s // 100, r["positive_id"], s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(a.ids) * places, k)
        for row_ids, labels, c in _tiles(batches):
            for chosen in _chosen(len(a.ids)):
                lo, hi = least[chosen], most[chosen]
                floor = np.maximum(lo, best.bar.reshape(-1, places)[chosen])
                floor = np.where(lo > hi, np.inf, floor)
                lowest, highest = floor.min(1), hi.max(1)

                def qualifies(
                    low: np.ndarray, high: np.ndarray, who: np.ndarray | None, floor: np.ndarray = floor, hi: np.ndarray = hi, lowest: np.ndarray = lowest, highest: np.ndarray = highest
                ) -> np.ndarray:
                    if who is None:
                        return (high >= lowest[:, None]) & (low <= highest[:, None])
                    return ((high[:, None] >= floor[who]) & (low[:, None] <= hi[who])).any(1)

                alive = (a.labels[chosen, None] != labels) & (lowest <= highest)[:, None]
                who, row, score = sliced_scores(a, chosen, c, alive, qualifies)
                for j in range(places):
                    keep = (score >= lo[who, j]) & (score <= hi[who, j])
                    best.add((who[keep] + chosen.start) * places + j, score[keep], row_ids[row[keep]])
        n, j = best.who // places, best.who % places
        columns = [a.ids[n], ids[n, j], best.ids, scores[n, j], best.score.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def anchor_blocks(asked: DataFrame, planes: int, size: int) -> Iterator[Anchors]:
    """Blocks of at most ``size`` anchors; the driver holds one block and one partition's rest at a time."""
    part: list = []

    def block(found: list) -> Anchors:
        numbers = [np.array([r[n] for r in found], np.int64) for n in ("vec_id", "label")]
        return Anchors(*numbers, np.array([r["c"] for r in found], np.int64).reshape(len(found), -1), planes)

    for row in asked.toLocalIterator():
        part.append(row)
        if len(part) == size:
            yield block(part)
            part = []
    if part:
        yield block(part)


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` chooses rows by vec_id; ``label`` is a column over ``vectors``, by default its label.
    """
    rows = integer_rows(vectors, F.col("label") if label is None else label)
    size = rows.agg(F.max(F.array_max(F.transform("c", lambda x: F.abs(x)))).alias("m"), F.max(F.size("c")).alias("d")).first()
    planes = int(size["m"] or 0).bit_length() + 1
    if (size["d"] or 0) << (2 * planes) >= 1 << 53:
        raise ValueError("scores of these vectors could reach 2 ** 53; take a smaller scale")
    parts = []
    for a in anchor_blocks(rows.filter(anchors), planes, block):
        known = positives_of(rows, a, positives).collect()  # at most ``block`` anchors, ``positives`` rows each
        parts.append(materialize(negatives_of(rows, a, known, negatives), "negatives-block"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return rows.sparkSession.read.schema(parts[0].schema).parquet(*[p._shared_path for p in parts])
