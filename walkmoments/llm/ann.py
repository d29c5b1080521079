"""Approximate nearest neighbours (operator 1): shifted space-filling curves.

Nearness is the largest inner product. Vectors are scaled by the greatest norm and given one more
coordinate that makes them unit length, queries are unit vectors with 0 there, so the nearest in
angle has the largest product whatever the norms. Each of CURVES orderings projects them on DIMS
random axes, shifts the cube and takes Hilbert keys. Keys are ranked by prefix sums over blocks of
their leading bits; ranks are cut into ranges, each with a margin of places of its neighbours on
either side: RANGE and MARGIN places in small tables, in larger ones 1 / SHARE of the classes and a
quarter of that, so that the part of a table that a query meets does not fall as the table grows. Inside a range every query is scored against every vector in double precision, on copies without
rounding. Whatever comes within the rounding error of a matrix product of the (k + 1)-th best is
added up anew in the order of the final scores, and the k + 1 first by score and id go on (one may
be the query itself); so do the first k + 1 of the curves' merged lists. Nothing that ranks among the
k nearest of those met is lost.

Equal vectors are one class, which holds its k + 1 least ids; a task sees a class once, however
many rows share it. Up to RANGE classes every query meets all. Up to SHARE * RANGE classes the work
grows in proportion to the rows, beyond that with queries times classes: vectors of many nearly
independent dimensions keep their recall in no smaller part of the table.

Defined results: rows without id, and vectors that are null, zero, of another length than most, or
hold null or non-finite components, take no part; several rows of one id count as the one with the
least vector; equal scores rank by id; a query that finds no candidate gives no row; an empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_prefix, materialize

CURVES, DIMS, BITS = 16, 6, 10
RANGE, MARGIN = 4096, 1024
#: Larger tables have ranges of this part of their classes.
SHARE = 24
SEED = 77
#: Leading key bits that make the blocks of the ranking.
BLOCK_BITS = 12


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer cell (rows, dims) on the Hilbert curve of ``bits`` bits an axis.

    Gray-code rotation from the top bit down, after Skilling's transpose form (2004).
    """
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    bit = 1 << (bits - 1)
    q = bit
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(len(x)):
            on = (x[i] & np.uint64(q)) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = bit
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << np.uint64(1)) | (((x[i] ^ turn) >> np.uint64(b)) & np.uint64(1))
    return key


def axes(length: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes and shift of one curve, the same on every worker."""
    rng = np.random.Generator(np.random.PCG64([SEED, curve, length]))
    dims = min(DIMS, length)
    return np.linalg.qr(rng.normal(size=(length, length)))[0][:, :dims], rng.uniform(0, 0.5, dims)


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    basis, shift = axes(unit.shape[1], curve)
    spread = 1 / (1 + np.exp(-1.702 * np.sqrt(unit.shape[1]) * (unit @ basis)))  # about uniform in (0, 1)
    return hilbert_keys(((spread * 0.5 + shift) * (1 << BITS)).astype(np.int64), BITS)


def valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part, one for each id."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = materialize(rows, "ann-rows")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else -1))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """cid (least id), ids (k + 1 least ids, sorted), v, norm of each distinct vector."""
    by_id = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("__r", F.row_number().over(by_id)).filter(F.col("__r") <= k + 1)  # cut before the shuffle, too
    one = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return one.select(F.get("ids", F.lit(0)).alias("cid"), "ids", "v", norm.alias("norm"))


def spans(classes: int) -> tuple[int, int]:
    """Places of a range and of its margin on either side, for so many classes."""
    return max(RANGE, -(-classes // SHARE)), max(MARGIN, -(-classes // (4 * SHARE)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """The vectors of a binary column, without copying a value at a time."""
    from_, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset :], column.buffers()[2]
    return np.frombuffer(data, np.uint8)[from_[0] : from_[len(column)]].view(kind).reshape(len(column), -1)


def ranked_keys(classes: DataFrame, greatest: float) -> DataFrame:
    """curve, cid, kind (0 vector, 1 query), place: ranks on every curve; queries stand beside vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                cid, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                v = _matrix(batch.column(1))
                length = np.linalg.norm(v, axis=1)
                inside = v / greatest
                data = np.hstack([inside, np.sqrt(np.maximum(0, 1 - (inside**2).sum(1)))[:, None]])
                query = np.hstack([v / length[:, None], np.zeros((len(v), 1))])[asks]
                both, ids = np.vstack([data, query]), np.concatenate([cid, cid[asks]])
                kind = np.repeat(np.array([0, 1], np.int32), [len(data), len(query)])
                for c in range(CURVES):
                    keys = curve_keys(both, c).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(ids), pa.array(kind), pa.array(keys)], names=["curve", "cid", "kind", "key"])

    keyed = classes.select("cid", "v", "asks").mapInArrow(run, "curve int, cid long, kind int, key long").withColumn("one", F.lit(1).cast("long"))
    block = F.shiftright("key", max(0, DIMS * BITS - BLOCK_BITS))
    return block_prefix(keyed, ["curve"], block, [F.col("key"), F.col("cid"), F.col("kind")], "one", "place").select("curve", "cid", "kind", "place")


def shortlists(places: DataFrame, classes: DataFrame, width: int, margin: int, k: int, single: bool) -> DataFrame:
    """qid, cid pairs of classes, the first k + 1 of each query by score and cid over all curves.

    ``single``: the components are single-precision numbers, of which 4 bytes are copies without rounding.
    """
    kind_of = np.float32 if single else np.float64

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1)).astype(kind_of)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in v], pa.binary())], names=["cid", "copy"])

    small = classes.select("cid", "v").mapInArrow(copies, "cid long, copy binary")
    own, inside = F.floor(F.col("place") / width), F.pmod("place", F.lit(width))
    seen = F.when(F.col("kind") == 1, F.array(own))
    seen = seen.when(inside < margin, F.array(own, own - 1)).when(inside >= width - margin, F.array(own, own + 1)).otherwise(F.array(own))
    rows = places.select("curve", "cid", "kind", F.explode(seen).alias("range"))
    # ranges without a query are not sent
    asked = places.filter("kind = 1").select("curve", own.alias("range")).distinct()
    rows = rows.join(asked, ["curve", "range"], "left_semi").join(small, "cid").select("curve", "range", "kind", "cid", "copy")

    def score(t: pa.Table) -> pa.Table:
        """One range: at most width + 2 * margin vectors, and the queries among its own places."""
        kind, cid = t.column("kind").to_numpy(), t.column("cid").to_numpy()
        m = np.concatenate([_numbers(c, kind_of) for c in t.column("copy").chunks if len(c)])
        q, d = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(q) and len(d):
            d = d[np.argsort(cid[d])]
            vectors = m[d].astype(np.float64)
            best = min(k + 1, len(d))
            # twice the error bound n * u * |q| * |d| of each of two sums of n products
            error = 2 * (m.shape[1] + 1) * np.finfo(np.float64).eps * np.sqrt((vectors**2).sum(1).max())
            step = max(1, (1 << 22) // len(d))  # scores held at a time
            for s in range(0, len(q), step):
                part = q[s : s + step]
                asking = m[part].astype(np.float64)
                got = asking @ vectors.T
                least = np.partition(got, len(d) - best, axis=1)[:, len(d) - best] - error * np.sqrt((asking**2).sum(1))
                who, at = np.nonzero(~(got < least[:, None]))  # also where an overflow makes no number
                exact = np.zeros(len(who))
                for j in range(m.shape[1]):
                    exact += asking[who, j] * vectors[at, j]
                order = np.lexsort((at, -exact, who))
                first = np.searchsorted(who, np.arange(len(part)))
                order = order[np.arange(len(who)) - first[who] < best]
                out[0].append(cid[part][who[order]])
                out[1].append(cid[d][at[order]])
                out[2].append(exact[order])
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["qid", "cid", "near"])

    # a grouped map demands that a range's rows meet; a bare repartition may be optimised away
    found = rows.groupBy("curve", "range").applyInArrow(score, "qid long, cid long, near double").groupBy("qid", "cid").agg(F.max("near").alias("near"))
    order = Window.partitionBy("qid").orderBy(F.desc("near"), "cid")
    return found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k + 1).select("qid", "cid")


def search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``queries`` (of vec_id) chooses."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = valid_rows(vectors)
    classes = classes_of(rows, k)
    asked = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "v")
    asks = asked.select("v").distinct().withColumn("__a", F.lit(True))
    classes = materialize(classes.join(asks, "v", "left").withColumn("asks", F.coalesce("__a", F.lit(False))).drop("__a"), "ann-classes")
    size = classes.agg(F.max("norm").alias("greatest"), F.count("*").alias("n")).first()
    near = shortlists(ranked_keys(classes, float(size["greatest"] or 1.0)), classes, *spans(size["n"]), k, single)
    left, right = classes.select(F.col("cid").alias("qid"), F.col("v").alias("qv")), classes.select("cid", "v", "ids")
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = near.join(left, "qid").join(right, "cid").select("qid", "ids", product.alias("score"))
    each = scored.select("qid", "score", F.explode("ids").alias("vec_id"))
    nearest_first = [F.desc("score"), F.col("vec_id")]
    listed = each.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy(*nearest_first))).filter(F.col("__r") <= k + 1)
    whose = asked.join(classes.select(F.col("cid").alias("qid"), "v"), "v").select("query_id", "qid")
    final = listed.drop("__r").join(whose, "qid").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest_first))
    return final.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
