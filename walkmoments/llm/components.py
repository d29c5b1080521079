"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

ROUNDS = 60


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """One step over arcs (u, v): every neighbour in reach is tied to the least of the neighbourhood."""
    if large:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = arcs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = both.join(least, "u")
    if large:
        return tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def at_rest(arcs: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: each component is a star around its least id."""
    ends = arcs.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(arcs.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def _labels(arcs: DataFrame) -> DataFrame:
    tops = arcs.select(F.col("v").alias("cid")).distinct()
    return arcs.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(tops.select("cid", F.col("cid").alias("comp")))


def components(edges: DataFrame) -> DataFrame:
    """cid, comp (least id of the component) for every id in ``edges`` (a, b), written.

    Every step is a few aggregations and joins on narrow rows; each round's arcs are written to the
    shared folder and deleted after the next. Nothing is collected but whether the arcs rest.
    """
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    for _ in range(ROUNDS):
        new = materialize(_star(_star(arcs, True), False), "cc")
        drop_table(arcs)
        arcs = new
        if at_rest(arcs):
            break
    else:
        raise RuntimeError("components did not converge")
    out = materialize(_labels(arcs), "cc-labels")
    drop_table(arcs)
    return out


def roots(pointers: DataFrame) -> DataFrame:
    """cid, comp for every id in ``pointers`` (a, b): one b < a for each a. Written.

    Pointers are replaced by their target's until they rest on roots, so the steps follow the
    logarithm of the longest chain.
    """
    arcs = pointers.select(F.col("a").alias("u"), F.col("b").alias("v"))
    for _ in range(ROUNDS):
        if at_rest(arcs):
            break
        next_ = arcs.select(F.col("u").alias("v"), F.col("v").alias("w"))
        new = materialize(arcs.join(next_, "v", "left").select("u", F.coalesce("w", "v").alias("v")), "cc")
        drop_table(arcs)
        arcs = new
    else:
        raise RuntimeError("pointers did not come to rest")
    out = materialize(_labels(arcs), "cc-labels")
    drop_table(arcs)
    return out
