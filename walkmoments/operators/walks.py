"""Entries of walk powers at nodes and edges, summed block by block, so that S^3 and higher powers are written nowhere.

With c_t(u, k) the sum over walks of t steps from u to k of the product of 1 / d of the nodes between, S^t_uk is
c_t(u, k) / sqrt(d_u d_k), and c_(t+1)(u, l) the sum of c_t(u, k) / d_k over the neighbours k of l.

Nodes u are dealt to blocks and bring their neighbours' neighbour lists, so c_2 is at hand; nodes l are dealt to
other blocks and bring their own lists. A pair of blocks makes c_3 of each u on its own l, one u at a time, and adds
up what these l are worth in S^t_uu (t up to 6) and S^t_uv of neighbours (t up to 5). Up to t = 4 with neighbours, c_3
is asked for only where c_2 is not 0, and read off these nodes' own lists: no work grows with all nodes for each u.
Sums over the blocks of l are exact. S^7_uu and S^8_uu come from whole columns (blocks.diagonals), where a task can hold all lists.

Shuffled: the lists of neighbours' neighbours once for each block of l (as many entries as S^2 has terms), all lists
once for each block of u, of which there are at most ``SOURCES``. A task holds one block of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .graph import Graph
from .lineage import cut

#: Nodes u of a block at least, blocks of them at most; arcs of a block of l at most, and of a graph where S^7 or S^8 is asked for.
NODES, SOURCES, ARCS, ARCS_WHOLE = 512, 96, 1 << 22, 1 << 24
#: Orders of S^t_uu that blocks can add up, those that need all lists in one block, orders of S^t_uv.
DIAGONAL, WHOLE, ACROSS = 6, 8, 5


def lists(arcs: DataFrame) -> DataFrame:
    """id, near: every node's neighbours as longs, degree * 2^32 + id."""
    deg = arcs.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("d"))
    code = F.shiftleft(F.col("d"), 32) + F.col("dst")
    return arcs.join(deg, "dst").groupBy(F.col("src").alias("id")).agg(F.collect_list(code).alias("near"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    each = column.combine_chunks()
    each = each if isinstance(each, pa.ListArray) else pa.concat_arrays(each.chunks)
    return each.flatten().to_numpy(zero_copy_only=False), np.diff(each.offsets.to_numpy())


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start .. start + length - 1 of each range, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def _summed(n: int, top: int, across: bool):
    """What a pair of blocks adds: rows u, v, w1..w<top>; v = u on the diagonal, else a neighbour beyond u."""
    names = [f"w{t}" for t in range(1, top + 1)]
    pulled = across and top == 4

    def work(near: pa.Table, far: pa.Table) -> pa.Table:
        if near.num_rows == 0:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in names}})
        own = near["bk"][0].as_py() == 0  # what c_1 and c_2 alone say is added once
        order = np.argsort(near["u"].to_numpy(), kind="stable")
        us, vs = near["u"].to_numpy()[order], near["v"].to_numpy()[order]
        codes, size = _flat(near["near"])
        first = (np.cumsum(size) - size)[order]
        size = size[order]
        ids, degree = codes & 0xFFFFFFFF, (codes >> 32).astype(float)
        # lists of the far block by their neighbour m: the l of each m, as places in the block
        held = np.zeros(0, np.int64)
        at, inverse = np.zeros(n + 1, np.int64), np.zeros(0)
        place = np.full(n, -1, np.int32)
        if far.num_rows:
            ends, count = _flat(far["list"])
            held = far["l"].to_numpy()
            place[held] = np.arange(len(held))
            ends = (ends & 0xFFFFFFFF).astype(np.int32)
            if pulled:
                own_at = np.r_[0, np.cumsum(count)]
            else:
                at[1:] = np.cumsum(np.bincount(ends, minlength=n))
                near_of = np.repeat(np.arange(len(held), dtype=np.int32), count)[np.argsort(ends, kind="stable")]
            inverse = 1.0 / count
        c2 = np.zeros(n)
        rows_u, rows_v, values = [], [], []
        starts = np.flatnonzero(np.r_[True, us[1:] != us[:-1]])
        for begin, end in zip(starts, np.r_[starts[1:], len(us)]):
            u, v, long = us[begin], vs[begin:end], size[begin:end]
            d, dv = float(end - begin), long.astype(float)
            flat = _ranges(first[begin:end], long)
            segment = np.cumsum(long) - long
            m = ids[flat]
            support, back = np.unique(m, return_inverse=True)
            two = np.bincount(back, weights=np.repeat(1.0 / dv, long))
            dm = np.empty(len(support))
            dm[back] = degree[flat]
            share = two / dm
            c2[support] = two
            diagonal, pairs = np.zeros(top + 1), np.zeros((top + 1, len(v)))
            if own:
                pairs[1] = 1.0
                pairs[2:3] = c2[v]
                if top > 2:
                    pairs[3] = np.add.reduceat(share[back], segment)
                for t, x in ((2, (1.0 / dv).sum()), (3, (c2[v] / dv).sum()), (4, (two * share).sum())):
                    if t <= top:
                        diagonal[t] = x
            c2[support] = 0.0
            if len(held) and pulled:
                where = place[support]
                here = np.flatnonzero(where >= 0)
                where = where[here]
                if len(where):
                    length = own_at[where + 1] - own_at[where]
                    c2[support] = share
                    c3 = np.zeros(len(support))
                    c3[here] = np.add.reduceat(c2[ends[_ranges(own_at[where], length)]], np.cumsum(length) - length) * inverse[where]
                    c2[support] = 0.0
                    pairs[4] = np.add.reduceat(c3[back], segment)
            elif len(held):
                length = at[support + 1] - at[support]
                near_far = near_of[_ranges(at[support], length)]
                three = np.bincount(near_far, weights=np.repeat(share, length), minlength=len(held))
                shared = three * inverse
                if across:
                    where = place[support]
                    c3 = np.where(where >= 0, shared[where], 0.0)
                    pairs[4:5] = np.add.reduceat(c3[back], segment)
                    if top > 4:
                        four = np.bincount(np.repeat(np.arange(len(support)), length), weights=shared[near_far], minlength=len(support)) / dm
                        pairs[5] = np.add.reduceat(four[back], segment)
                if top > 4:
                    where = place[support]
                    here = where >= 0
                    diagonal[5] = (two[here] * shared[where[here]]).sum()
                if top > 5:
                    diagonal[6] = (three * shared).sum()
            rows_u.append([u])
            rows_v.append([u])
            values.append((diagonal[1:] / d)[:, None])
            if across:
                beyond = v > u
                rows_u.append(np.full(beyond.sum(), u))
                rows_v.append(v[beyond])
                values.append(pairs[1:, beyond] / np.sqrt(d * dv[beyond]))
        whole = np.concatenate(values, axis=1)
        return pa.table({"u": np.concatenate(rows_u), "v": np.concatenate(rows_v), **{c: whole[k] for k, c in enumerate(names)}})

    return work


def walk_sums(graph: Graph, top: int, sources: DataFrame | None = None, across: bool = True) -> DataFrame | None:
    """u, v, w1..w<top>: S^t_uu (v = u) and, with ``across``, S^t_uv of the neighbours v > u, for every u with neighbours (of ``sources``, i).

    None where the orders are beyond what blocks add up, so that another way must be taken.
    """
    if top > (ACROSS if across else WHOLE):
        return None
    arcs = cut(graph.arcs())
    count = arcs.count()
    if graph.n >= 1 << 31 or (top > DIAGONAL and count > ARCS_WHOLE):
        return None
    if top > DIAGONAL:
        found = blocks.diagonals(cut(blocks.near_lists(arcs)), graph.n, top)
        return found if sources is None else found.join(sources.select(F.col("i").alias("u")), "u", "left_semi")
    meets = top > (3 if across else 4)  # else c_2 says it all
    far_blocks = -(-max(count, 1) // ARCS) if meets and top <= DIAGONAL else 1
    near_blocks = max(1, min(SOURCES, graph.n // NODES))
    near = cut(lists(arcs))
    deal = F.sequence(F.lit(0), F.lit(far_blocks - 1))
    ways = arcs.select(F.col("src").alias("u"), F.col("dst").alias("id"))
    if sources is not None:
        ways = ways.join(sources.select(F.col("i").alias("u")), "u", "left_semi")
    left = ways.join(near, "id").select(F.pmod("u", F.lit(near_blocks)).cast("int").alias("bi"), F.explode(deal).alias("bk"), "u", F.col("id").alias("v"), "near")
    right = near.select(F.explode(F.sequence(F.lit(0), F.lit(near_blocks - 1))).alias("bi"), F.pmod("id", F.lit(far_blocks)).cast("int").alias("bk"), F.col("id").alias("l"), F.col("near").alias("list"))
    if not meets:
        right = right.limit(0)
    names = [f"w{t}" for t in range(1, top + 1)]
    found = left.groupBy("bi", "bk").cogroup(right.groupBy("bi", "bk")).applyInArrow(_summed(graph.n, top, across), ", ".join(["u long", "v long", *[f"{c} double" for c in names]]))
    if far_blocks == 1:
        return found
    return found.groupBy("u", "v").agg(*[F.sum(c).alias(c) for c in names])
