"""Column expressions: closed forms of moment changes, scores and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy(x: Column, digits: int = 12) -> Column:
    """Rounded without negative zero, so that sums in any order compare equal."""
    return F.round(x, digits) + F.lit(0.0)


def inverse(d: Column) -> Column:
    """1 / d, and 0 for a node without neighbours."""
    return F.when(d > 0, 1.0 / d).otherwise(F.lit(0.0))


def _gap(d: Column) -> Column:
    """d (d - 1), or 1 where that vanishes: the numerators are 0 there."""
    return F.when(d > 1, d * (d - 1.0)).otherwise(F.lit(1.0))


def delete_m2(du: Column, dv: Column, wu: Column, wv: Column, n: float) -> Column:
    return (2.0 / n) * ((wu - 1.0 / dv) / _gap(du) + (wv - 1.0 / du) / _gap(dv) - 1.0 / (du * dv))


def delete_m3(du: Column, dv: Column, hu: Column, hv: Column, m: Column, n: float) -> Column:
    return (6.0 / n) * ((hu - m / dv) / _gap(du) + (hv - m / du) / _gap(dv) - m / (du * dv))


def _loss(x: Column, d: Column) -> Column:
    return F.when(d > 0, x / (d * (d + 1.0))).otherwise(F.lit(0.0))


def add_m2(du: Column, dv: Column, wu: Column, wv: Column, n: float) -> Column:
    return (2.0 / n) * (1.0 / ((du + 1.0) * (dv + 1.0)) - _loss(wu, du) - _loss(wv, dv))


def add_m3(du: Column, dv: Column, hu: Column, hv: Column, m: Column, n: float) -> Column:
    return (6.0 / n) * (m / ((du + 1.0) * (dv + 1.0)) - _loss(hu, du) - _loss(hv, dv))


def target_distance(moments: dict[int, Column], target: dict[int, float], scale: dict[int, float], origin: dict[int, float] | None = None, euclidean: bool = False) -> Column:
    """Sum over orders of squared scaled differences; relative to ``origin`` if given; its root if euclidean."""
    out = F.lit(0.0)
    for k, m in moments.items():
        base = origin[k] if origin else 0.0
        gap = (m - F.lit(base)) / F.lit(scale[k]) - F.lit((target[k] - base) / scale[k])
        out = out + gap * gap
    return F.sqrt(out) if euclidean else out


def direction_class(x: Column, y: Column, directions: int) -> Column:
    """Sector of the angle of (x, y), sectors centred on multiples of 2 pi / directions."""
    turn = 2 * math.pi
    angle = F.atan2(y, x)
    angle = F.when(angle < 0, angle + turn).otherwise(angle)
    return F.pmod(F.floor(angle * directions / turn + 0.5), F.lit(directions)).cast("int")


def relative(delta: Column, moment: float) -> Column:
    return delta / F.lit(max(abs(moment), 1e-12))


def with_determinant_deltas(rows: DataFrame, top: int, n: float) -> DataFrame:
    """Adds delta_m1..delta_m<top> of one edge edit from its 2 x 2 walk matrices, columns h<t>_<0..3>, t < top.

    Changes of power traces follow from D(z) = det(I - sum z^j H_(j-1)) by Newton's identity:
    p_k = -k d_k - sum of d_j p_(k-j). Plain column arithmetic, a column for each term.
    """
    def h(t: int, k: int) -> Column:
        return F.col(f"h{t}_{k}")

    d = {}
    for j in range(1, top + 1):
        value = -(h(j - 1, 0) + h(j - 1, 3))
        for a in range(1, j):
            value = value + h(a - 1, 0) * h(j - a - 1, 3) - h(a - 1, 1) * h(j - a - 1, 2)
        d[f"d_{j}"] = value
    rows = rows.withColumns(d)
    for k in range(1, top + 1):
        value = -k * F.col(f"d_{k}")
        for j in range(1, k):
            value = value - F.col(f"d_{j}") * F.col(f"p_{k - j}")
        rows = rows.withColumn(f"p_{k}", value)
    return rows.withColumns({f"delta_m{k}": F.col(f"p_{k}") / n for k in range(1, top + 1)})


def integer_hash(u: Column, v: Column, seed: int = 0) -> Column:
    """The same in [0, 1000003) on every engine: for sampling that SQL must reproduce."""
    return F.pmod(u.cast("long") * 73856093 + v.cast("long") * 19349663 + F.lit(seed).cast("long") * 83492791, F.lit(1000003).cast("long"))


def drawn(seed: int, *cols: Column) -> Column:
    """60 bits of an MD5 sum of the seed and the values, as a long: random choices that every engine can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
