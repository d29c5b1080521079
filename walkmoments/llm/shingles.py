"""Word shingles as sorted 64-bit hashes, and the segment keys that near sets must share.

Words are maximal runs of other characters than space and tab to carriage return, A-Z lower-cased.
A document's set holds the distinct hashes of its n-word shingles; with fewer words the whole
sequence is its one shingle; without words the set is empty. Everything works on bytes by numpy.

Segments: two sets with intersection / union of at least ``num / den`` differ in few members, at
most ``spread`` of them for sets up to a given size. If members are dealt by hash into more
segments than that, some segments hold exactly the same members in both. Equality of one segment's
content is therefore a complete blocking key, far more selective than a single shared shingle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
#: Growth of size classes.
RATIO = 1.5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word in ``raw`` (one piece)."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _pieces(texts: list[bytes]):
    """Runs of whole texts of about PIECE bytes, each as (bytes, text number of the first, lengths)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < PIECE):
            size += len(texts[end]) + 1
            end += 1
        yield at, texts[at:end]
        at = end


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of one very long text, piece by piece, cut between words."""
    found, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
        found.append(word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    count = max(len(words) - n + 1, 0)
    out = np.full(count, np.uint64(n * 0x2545F4914F6CDD1D & (1 << 64) - 1))
    for k in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + count])
    return out


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, group in _pieces(texts):
        if len(group) == 1 and len(group[0]) > PIECE:
            words, owner = _long_words(group[0]), None
        else:
            words, starts = word_hashes(b" ".join(group))
            edges = np.cumsum([len(t) + 1 for t in group])
            owner = np.searchsorted(edges, starts, side="right")
        if owner is None:
            owner = np.zeros(len(words), np.int64)
        first = np.searchsorted(owner, np.arange(len(group) + 1))
        runs = _combine(words, n)
        for k in range(len(group)):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= n:
                out.append(np.unique(runs[a : b - n + 1]))
            else:
                out.append(_combine(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def spread(total: int, num: int, den: int) -> int:
    """Most members that two sets of ``total`` members together can have apart when they link."""
    if total < 2:
        return 0
    low = max(2, total - 2 * (num + den))
    return max(s - 2 * -(-num * s // (num + den)) for s in range(low, total + 1))


@lru_cache(None)
def class_bounds() -> tuple[int, ...]:
    """Least sizes of the size classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return tuple(out)


@lru_cache(None)
def class_segments(c: int, num: int, den: int) -> tuple[int, int]:
    """Segments of class c, and how many of them linked sets share at least."""
    d = spread(2 * (class_bounds()[c + 1] - 1), num, den)
    if d == 0:
        return 0, 0  # only equal sets link
    margin = -(-d // 4)
    return d + 1 + margin, 1 + margin


def classes_of(size: int, num: int, den: int) -> list[int]:
    """The class of a set, and the next one if a partner can lie there."""
    bounds = class_bounds()
    c = int(np.searchsorted(bounds, size, side="right")) - 1
    return [c, c + 1] if den * size >= num * bounds[c + 1] else [c]


def segment_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets, concatenated, and their offsets.

    Linked sets share a key. Empty segments, and those of one member, are left out as far as the
    shared segments allow; the rule depends on a segment's content alone, so both sets agree.
    """
    jobs = [(k, c, *class_segments(c, num, den)) for k, s in enumerate(sets) if len(s) for c in classes_of(len(s), num, den)]
    jobs = [j for j in jobs if j[2]]
    offsets = np.zeros(len(sets) + 1, np.int64)
    if not jobs:
        return np.zeros(0, np.uint64), offsets
    base = np.concatenate([[0], np.cumsum([j[2] for j in jobs])])
    members = np.concatenate([sets[j[0]] for j in jobs])
    sizes = np.array([len(sets[j[0]]) for j in jobs])
    count = np.repeat(np.array([j[2] for j in jobs], np.uint64), sizes)
    scrambled = mix(members ^ np.uint64(0xA24BAED4963EE407))
    segment = (((scrambled >> np.uint64(32)) * count) >> np.uint64(32)).astype(np.int64) + np.repeat(base[:-1], sizes)
    content = mix(members + np.uint64(0x9E6C63D0876A9A47))
    bins = int(base[-1])
    half = np.uint64(0xFFFFFFFF)
    low = np.bincount(segment, (content & half).astype(np.float64), bins)
    high = np.bincount(segment, (content >> np.uint64(32)).astype(np.float64), bins)
    held = np.bincount(segment, minlength=bins)
    # halves add up exactly in doubles below two million members a segment
    total = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
    which = np.repeat(np.arange(len(jobs)), [j[2] for j in jobs])
    number = np.arange(bins) - base[which]
    cls = np.array([j[1] for j in jobs], np.uint64)[which]
    keys = mix(total + mix(cls * np.uint64(0xC2B2AE3D27D4EB4F) + number.astype(np.uint64) * np.uint64(0x165667B19E3779F9)))
    spare = np.array([j[3] - 1 for j in jobs])
    none = np.bincount(which, held == 0, len(jobs))
    single = np.bincount(which, held == 1, len(jobs))
    least = np.where(none + single <= spare, 2, np.where(none <= spare, 1, 0))
    keep = held >= least[which]
    owner = np.array([j[0] for j in jobs])[which][keep]
    offsets[1:] = np.cumsum(np.bincount(owner, minlength=len(sets)))
    return keys[keep], offsets


def identity(members: np.ndarray) -> int:
    """A 64-bit number of the set, as a signed long."""
    return int(mix(np.array([np.add.reduce(mix(members + np.uint64(0x51ED270B9F8D1F2B)), dtype=np.uint64) + np.uint64(len(members))], np.uint64)).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union of two sorted sets."""
    n = len(a) + len(b)
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (n - common)
