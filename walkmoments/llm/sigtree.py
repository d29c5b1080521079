"""Signature trees: OR-combined token bitmaps with size ranges, and their dual traversal.

A leaf is one set: its size, and a bitmap in which every member sets one bit. Its slack is its size
less its set bits, the members that a bitmap hides. An inner node ORs its children's bitmaps and
keeps their least and greatest size, greatest slack and range of component numbers. For any sets
below two nodes, at most ``bits in common + the smaller slack`` members are shared, and linked sets
need ``num / (num + den)`` of their sizes' sum; pairs of nodes that can't reach it, whose sizes are
too far apart, or whose sets all lie in one component, are not descended.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

FAN = 8
#: Bytes of bitmaps compared at once.
SLICE = 1 << 25


def bitmap_of(members: np.ndarray) -> bytes:
    """Four to eight bits a member, a power of two, at least 64."""
    width = 64
    while width < 4 * len(members):
        width *= 2
    bits = np.zeros(width, bool)
    bits[(mix(members ^ np.uint64(0x632BE59BD9B4E019)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bitmap: bytes, width: int) -> np.ndarray:
    """The bitmap as it is with ``width`` bits: positions are taken modulo the width."""
    words = np.frombuffer(bitmap, np.uint64)
    return np.bitwise_or.reduce(words.reshape(-1, width // 64), axis=0)


def overlap_bound(m: int, x: bytes, n: int, y: bytes) -> int:
    """The most members that sets of ``m`` and ``n`` members with these bitmaps can share."""
    width = 8 * min(len(x), len(y))
    a, b = fold(x, width), fold(y, width)
    slack = min(m - int(np.bitwise_count(a).sum()), n - int(np.bitwise_count(b).sum()))
    return int(np.bitwise_count(a & b).sum()) + slack


class Tree:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray, comps: np.ndarray, ids: np.ndarray):
        order = np.lexsort((bits[:, 0], sizes, comps))
        self.ids = ids[order]
        held = np.bitwise_count(bits).sum(1).astype(np.int64)
        level = {"bits": bits[order], "low": sizes[order], "high": sizes[order], "slack": (sizes - held)[order], "c0": comps[order], "c1": comps[order]}
        self.levels = [level]
        while len(level["low"]) > 1:
            level = self.above(level)
            self.levels.append(level)

    @staticmethod
    def above(level: dict) -> dict:
        at = np.arange(0, len(level["low"]), FAN)
        kinds = {"bits": np.bitwise_or, "low": np.minimum, "high": np.maximum, "slack": np.maximum, "c0": np.minimum, "c1": np.maximum}
        return {k: f.reduceat(level[k], at, axis=0) for k, f in kinds.items()}

    def raised(self, height: int) -> list[dict]:
        levels = list(self.levels)
        while len(levels) < height:
            levels.append(self.above(levels[-1]))
        return levels


def _alive(p: dict, q: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs may hold a link, and the greatest overlap for those."""
    ok = ~((p["c0"][i] == p["c1"][i]) & (q["c0"][j] == q["c1"][j]) & (p["c0"][i] == q["c0"][j]))
    ok &= (den * p["high"][i] >= num * q["low"][j]) & (den * q["high"][j] >= num * p["low"][i])
    at = np.flatnonzero(ok)
    bound = np.zeros(len(i), np.int64)
    step = max(1, SLICE // (8 * p["bits"].shape[1]))
    for s in range(0, len(at), step):
        k = at[s : s + step]
        shared = np.bitwise_count(p["bits"][i[k]] & q["bits"][j[k]]).sum(1, dtype=np.int64)
        bound[k] = shared + np.minimum(p["slack"][i[k]], q["slack"][j[k]])
    return ok & ((num + den) * bound >= num * (p["low"][i] + q["low"][j])), bound


def dual(x: Tree, y: Tree | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (a, b) of set pairs that may link, and their overlap bound in thousandths of the need.

    ``y`` None: the tree against itself, each pair once.
    """
    other = x if y is None else y
    height = max(len(x.levels), len(other.levels))
    xs, ys = x.raised(height), other.raised(height)
    i = j = np.zeros(1, np.int64)
    bound = np.zeros(1, np.int64)
    for depth in range(height - 1, -1, -1):
        p, q = xs[depth], ys[depth]
        ok, bound = _alive(p, q, i, j, num, den)
        if y is None and depth == 0:
            ok &= i < j
        i, j, bound = i[ok], j[ok], bound[ok]
        if depth == 0 or not len(i):
            break
        below_x, below_y = len(xs[depth - 1]["low"]), len(ys[depth - 1]["low"])
        step = np.arange(FAN)
        ci = (i[:, None, None] * FAN + step[:, None]).repeat(FAN, 2).reshape(-1)
        cj = (j[:, None, None] * FAN + step).repeat(FAN, 1).reshape(-1)
        keep = (ci < below_x) & (cj < below_y)
        if y is None:
            keep &= ci <= cj
        i, j = ci[keep], cj[keep]
    if not len(i):
        none = np.zeros(0, np.int64)
        return none, none, none
    need = num * (xs[0]["low"][i] + ys[0]["low"][j])
    return x.ids[i], other.ids[j], bound * 1000 * (num + den) // np.maximum(need, 1)


def candidates(sizes: np.ndarray, bitmaps: list[bytes], comps: np.ndarray, ids: np.ndarray, side: np.ndarray, num: int, den: int):
    """Candidate pairs of one group: rows of side 0 against side 1, or side 2 among themselves."""
    width = 8 * min(map(len, bitmaps))
    bits = np.stack([fold(b, width) for b in bitmaps])

    def tree(rows: np.ndarray) -> Tree:
        return Tree(sizes[rows], bits[rows], comps[rows], ids[rows])

    alone = np.flatnonzero(side == 2)
    if len(alone):
        return dual(tree(alone), None, num, den)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        none = np.zeros(0, np.int64)
        return none, none, none
    return dual(tree(left), tree(right), num, den)
