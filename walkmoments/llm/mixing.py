"""Mixing sources to target weights (operator 6, native): Pareto order sampling.

Sizes are words. Sources share a total by weight; a share stops at ``most`` times its source's
size and the excess is shared again. Inside a source, classes of size (powers of two) share the
source's target by a mildly rising weight, which gives every document its expected copies:
the whole part is certain, and for the rest, the inclusion probability p, documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with u hashed from the row. The first documents in that order
whose words fill the remaining target are taken once more. Only sums by source and class, and
prefix sums over blocks of the rank, are shuffled beside one narrow row per document.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; sources without words have target 0; rows that repeat wholly tie, and as many of
them are taken as fit; very long texts count whole, and one larger than its source's target may be left
out or overshoot it by at most half its size; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, block_prefix, materialize, range_prefix, text_or_empty, unit_hash

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 20
#: Blocks of the rank's logarithm in [-RANGE, RANGE).
BLOCKS, RANGE = 1 << 14, 40.0


def water_fill(parts: DataFrame, group: list[str], cap: str, weight: str, total: str, out: str) -> DataFrame:
    """Adds ``out`` = min(cap, level * weight), the level such that each group's sum is its total.

    Closed form of stopping at caps and sharing the excess by weight until none is above: in order
    of cap / weight a part is capped while an even share of what is left reaches its cap. Totals
    beyond the sum of caps give the caps; a weight of 0 gives 0. One row per part is windowed.
    """
    order = Window.partitionBy(*group).orderBy(F.col("__ratio"), F.col(cap), F.col(weight))
    rows = parts.withColumn("__ratio", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(-1.0)))
    used = F.when(F.col(weight) > 0, F.col(cap)).otherwise(F.lit(0.0))
    before = F.coalesce(F.sum(used).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(F.col(weight)).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("__level", F.when(left > 0, (F.col(total) - before) / left).otherwise(F.lit(0.0)))
    free = F.col("__level") < F.col("__ratio")
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("__first", F.first(F.when(free, F.col("__level")), ignorenulls=True).over(everyone))
    level = F.col("__first") * F.col(weight)
    share = F.when(F.col(weight) <= 0, F.lit(0.0)).when(F.col("__first").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), level))
    return rows.withColumn(out, F.greatest(share, F.lit(0.0))).drop("__ratio", "__level", "__first")


def fill_level(sources: DataFrame, cap: str, weight: str, share: float) -> float | None:
    """The level of :func:`water_fill` for one group that is the whole table and shares ``share`` of source_size; None if all are capped.

    Rows of one ratio are summed first; the level is that of the least ratio above its own level.
    """
    whole = sources.agg(F.sum("source_size"), F.sum(weight)).first()
    if not whole[1]:
        return None
    total, weights = F.lit(float(whole[0]) * float(share)), F.lit(float(whole[1]))
    levels = sources.filter(F.col(weight) > 0).groupBy((F.col(cap) / F.col(weight)).alias("__ratio")).agg(F.sum(cap).alias("__c"), F.sum(weight).alias("__v"))
    levels = range_prefix(levels, "__ratio", {"__cs": "__c", "__vs": "__v"})
    level = (total - F.col("__cs")) / (weights - F.col("__vs"))
    return levels.filter(level < F.col("__ratio")).agg(F.min_by(level, "__ratio")).first()[0]


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, in the sources' order by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def sized(docs: DataFrame) -> DataFrame:
    """Adds __m_key, __m_size, __m_class and __m_u, which depend on the row's own values alone."""
    text = text_or_empty()
    return (
        docs.withColumn("__m_key", source_key(F.col("source").cast("string")))
        .withColumn("__m_size", size_of(text))
        .withColumn("__m_class", F.floor(F.log2(F.col("__m_size").cast("double") + 0.5)).cast("int"))
        .withColumn("__m_u", unit_hash(F.lit(SEED), F.col("doc_id"), text))
    )


def class_weight(c: Column) -> Column:
    """Longer documents count a little more: 1 for one word, 2 for 256 words, 3 for 65,536."""
    return 1.0 + F.greatest(c, F.lit(0)).cast("double") / 8.0


def allocate(rows: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source and class: __m_key, __m_class, source_size, target, copies (expected per document).

    ``rows`` has __m_key, __m_class and __m_size. Sources may be many: their places in order and the
    level come from prefix sums over ranges, so no task holds them all.
    """
    classes = rows.groupBy("__m_key", "__m_class").agg(F.sum("__m_size").alias("__m_words"))
    sources = classes.groupBy("__m_key").agg(F.sum("__m_words").alias("source_size"), F.lit(1).cast("long").alias("__n"))
    sources = range_prefix(sources, "__m_key", {"__place": "__n"})
    turn = F.pmod(F.col("__place"), F.lit(len(weights)))
    weight = F.lit(float(weights[0]))
    for k, w in enumerate(weights[1:], 1):
        weight = F.when(turn == k, F.lit(float(w))).otherwise(weight)
    sources = materialize(
        sources.select("__m_key", "source_size", weight.alias("__w"), (F.col("source_size") * F.lit(float(most))).alias("__cap")), "mix-sources"
    )
    level = fill_level(sources, "__cap", "__w", share)
    filled = F.col("__cap") if level is None else F.least(F.col("__cap"), F.lit(level) * F.col("__w"))
    target = F.greatest(F.when(F.col("__w") > 0, filled).otherwise(F.lit(0.0)), F.lit(0.0))
    sources = sources.select("__m_key", "source_size", target.alias("target"))
    parts = (
        classes.join(sources, "__m_key")
        .withColumn("__cap", F.col("__m_words") * F.lit(float(most)))
        .withColumn("__w", F.col("__m_words") * class_weight(F.col("__m_class")))
    )
    parts = water_fill(parts, ["__m_key"], "__cap", "__w", "target", "__share")
    copies = F.when(F.col("__m_words") > 0, F.least(F.lit(float(most)), F.col("__share") / F.col("__m_words"))).otherwise(F.lit(0.0))
    return parts.select("__m_key", "__m_class", "source_size", "target", copies.alias("copies"))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds certain (whole copies), __m_p (the rest) and __m_rank, the Pareto order."""
    p, u = F.col("__m_p"), F.col("__m_u")
    return (
        rows.withColumn("certain", F.floor("copies").cast("long"))
        .withColumn("__m_p", F.col("copies") - F.col("certain"))
        .withColumn("__m_rank", F.when(p > 0, (u / (1.0 - u)) / (p / (1.0 - p))))
    )


def select_words(rows: DataFrame) -> DataFrame:
    """Adds extra (0 or 1) to rows with __m_key, __m_size, certain, __m_p, __m_rank.

    Of a source's documents with a rest, the first in rank order are taken whose midpoint, in
    cumulated words, lies below the source's remaining target. Prefix sums go by blocks of the
    rank's logarithm, so no source is sorted in one task.
    """
    open_rows = rows.filter((F.col("__m_p") > 0) & (F.col("__m_size") > 0))
    rest = open_rows.groupBy("__m_key").agg(F.sum(F.col("__m_p") * F.col("__m_size")).alias("__m_rest"))
    spread = F.log(F.col("__m_rank")) * F.lit(BLOCKS / (2 * RANGE)) + F.lit(BLOCKS / 2.0)
    block = F.least(F.greatest(F.floor(spread), F.lit(0)), F.lit(BLOCKS - 1)).cast("int")
    placed = block_prefix(open_rows, ["__m_key"], block, [F.col("__m_rank"), F.col("doc_id"), F.col("__m_size")], "__m_size", "__m_before")
    taken = placed.join(rest, "__m_key").withColumn("extra", (F.col("__m_before") + F.col("__m_size") / 2.0 < F.col("__m_rest")).cast("long")).drop("__m_before", "__m_rest")
    others = rows.filter(~((F.col("__m_p") > 0) & (F.col("__m_size") > 0))).withColumn("extra", F.lit(0).cast("long"))
    return taken.select(*others.columns).unionByName(others)


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    rows = materialize(sized(docs.select("doc_id", "text", "source")).select("doc_id", "__m_key", "__m_size", "__m_class", "__m_u"), "mix-sizes")
    plan = allocate(rows, share, most, weights)
    placed = ranked(rows.join(plan, ["__m_key", "__m_class"]))
    out = select_words(placed)
    taken = (F.col("certain") + F.col("extra")) * F.col("__m_size")
    return out.select("doc_id", F.col("__m_size").alias("size"), "source_size", "target", taken.alias("taken"))


def repeat_to_targets(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (0, 1 or 2 times), columns unchanged.

    The ranks at which sources stop are found on narrow rows; texts are then filtered and repeated
    in place against one small row per source and class, so no text is shuffled. Rows that repeat
    wholly stand or fall together here.
    """
    columns = docs.columns
    rows = materialize(sized(docs.select("doc_id", "text", "source")).select("doc_id", "__m_key", "__m_size", "__m_class", "__m_u"), "mix-sizes")
    plan = materialize(allocate(rows, share, most, weights), "mix-plan")
    last = select_words(ranked(rows.join(plan, ["__m_key", "__m_class"]))).filter("extra = 1").groupBy("__m_key").agg(F.max("__m_rank").alias("__m_last"))
    cuts = materialize(plan.join(last, "__m_key", "left").select("__m_key", "__m_class", "copies", "__m_last"), "mix-cuts")
    narrow = sized(docs.select("doc_id", "text", "source", F.struct(*columns).alias("__m_row")))
    placed = ranked(narrow.drop("doc_id", "text", "source").join(cuts, ["__m_key", "__m_class"]))
    extra = F.coalesce((F.col("__m_rank") <= F.col("__m_last")) & (F.col("__m_size") > 0), F.lit(False)).cast("int")
    times = F.when(F.col("__m_size") > 0, F.col("certain").cast("int") + extra).otherwise(F.lit(0))
    return placed.select("__m_row", F.explode(F.array_repeat(F.lit(0), times)).alias("__m_copy")).select(*[F.col("__m_row")[c].alias(c) for c in columns])
