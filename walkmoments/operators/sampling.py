"""Seeded sampling. Choices hash (seed, row), so they don't depend on partitions or reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import drawn, integer_hash
from .graph import Graph, complement, simple_edges
from .lineage import cut, discard, written


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) from the seed and the row."""
    return (drawn(seed, *[F.col(c) for c in cols]).cast("double") + 0.5) / float(1 << 60)


def subsample(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` rows (u, v) without replacement, all of them if fewer: a bounded top-k by hash."""
    return rows.withColumn("__h", integer_hash(F.col("u"), F.col("v"), seed)).orderBy("__h", "u", "v").limit(size).drop("__h")


def hashed_below(graph: Graph, top: int, seed: int) -> DataFrame:
    """u, v of all pairs u < v whose hash (functions.integer_hash) is below ``top``: n * top rows, not n^2.

    The hash is linear in v modulo a prime, so each u and hash has one residue of v.
    """
    a, b, c, p = 73856093, 19349663, 83492791, 1000003
    last = F.lit(graph.n - 1).cast("long")
    rows = graph.nodes().select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top - 1).cast("long"))).alias("h"))
    residue = F.pmod(F.pmod(F.col("h") - F.col("u") * a - seed * c, F.lit(p).cast("long")) * pow(b, -1, p), F.lit(p).cast("long"))
    rows = rows.select("u", residue.alias("r")).filter(F.col("r") <= last)
    return rows.select("u", F.explode(F.sequence("r", last, F.lit(p).cast("long"))).alias("v")).filter("u < v")


def non_edges(graph: Graph, size: int, seed: int) -> DataFrame:
    """``size`` distinct non-edges, those with the least hashes; a negative size means all.

    Pairs with the least hashes are made from the hashes, twice as many when too few of them are free; all pairs are
    hashed only where these are fewer.
    """
    if size < 0:
        return complement(graph)
    total = graph.n * (graph.n - 1) // 2
    top = 2 * size * 1000003 // max(total, 1) + 2
    while graph.n * top < total:
        found = written(hashed_below(graph, top, seed).join(graph.edges, ["u", "v"], "left_anti"), "non-edges")
        if found.count() >= size:
            return subsample(found, size, seed)
        discard(found)
        top *= 2
    return subsample(complement(graph), size, seed)


def rank_of_draw(draw: Column, seed: int, total: int) -> Column:
    """A number in 0..total - 1 from 60 bits of an MD5 sum, the same on every engine."""
    return F.pmod(drawn(seed, draw), F.lit(total).cast("long"))


def unranked(rows: DataFrame, rank: str) -> DataFrame:
    """Adds u < v of the pair with the given rank: rank = v (v - 1) / 2 + u, settled exactly after the root in doubles."""
    k = F.col(rank)
    near = F.floor((1.0 + F.sqrt(1.0 + 8.0 * k.cast("double"))) / 2.0)
    rows = rows.withColumn("v", near)
    below = F.expr("v * (v - 1) div 2")
    rows = rows.withColumn("v", F.when(below > k, F.col("v") - 1).when(F.expr("v * (v + 1) div 2") <= k, F.col("v") + 1).otherwise(F.col("v")))
    return rows.withColumn("u", k - F.expr("v * (v - 1) div 2"))


def ranked_non_edges(graph: Graph, size: int, seed: int) -> DataFrame:
    """``size`` distinct non-edges, uniformly, without making the complement; all, if there are fewer or ``size`` is negative.

    Numbered draws are ranks of pairs, unranked in closed form; repeated draws and edges drop out, and the first
    ``size`` that stay are taken, so that more draws never change a result. Draws double until there are enough:
    the cost follows the sample, not n^2. Where more than half of all pairs are edges, or more than half of the
    non-edges are asked for, the complement is no larger than what is read or returned, and is hashed instead.
    """
    total, edges = graph.n * (graph.n - 1) // 2, graph.edges.count()
    free = total - edges
    if size < 0 or size >= free:
        return complement(graph).select("u", "v")
    if 2 * edges > total or 2 * size > free:
        return subsample(complement(graph), size, seed).select("u", "v")
    draws = 64 + int(1.25 * size * total / free)
    while True:
        rows = graph.spark.range(draws).select(rank_of_draw(F.col("id"), seed, total).alias("rank"), F.col("id").alias("draw"))
        found = cut(unranked(rows.groupBy("rank").agg(F.min("draw").alias("draw")), "rank").select("u", "v", "draw").join(graph.edges, ["u", "v"], "left_anti"))
        if found.count() >= size:
            return found.orderBy("draw").limit(size).select("u", "v")
        draws *= 2


def random_deletions(graph: Graph, budget: int, seed: int) -> DataFrame:
    """step, u, v: edges in an order hashed from the seed, the first ``budget`` of them."""
    rows = subsample(graph.edges, budget, seed)
    order = Window.orderBy("__h", "u", "v")  # at most ``budget`` rows
    return rows.withColumn("__h", integer_hash(F.col("u"), F.col("v"), seed)).withColumn("step", F.row_number().over(order)).select("step", "u", "v")


def random_walk_deletions(graph: Graph, budget: int, seed: int, walkers: int = 1) -> DataFrame:
    """step, u, v: walkers delete the edges that they pass and start anew, at any node with edges, when stuck.

    In a round every walker picks one of its node's remaining edges, the one with the least hash of (seed, round,
    walker, end); a walker whose node has none takes a remaining arc, the stuck ones in turn those with the least
    hashes of (seed, round, arc). Of walkers that pick one edge the first passes it, the others stay. Steps count
    by round, then walker; the last round is cut at ``budget``, and all ends when no edge is left. With one walker
    this is the sequential walk. A round is three jobs whatever the graph and the number of walkers; deletion marks
    are tables by round, joined by key.
    """
    spark = graph.spark
    arcs = written(graph.arcs(), "walk-arcs")
    state = spark.range(walkers).select(F.col("id").alias("walker"), F.lit(None).cast("long").alias("now"))
    marks: list[DataFrame] = []
    made = turn = 0

    def marked() -> DataFrame:
        return spark.read.schema(marks[0].schema).parquet(*[m._written_at for m in marks])

    while made < budget:
        turn += 1
        left = arcs
        if marks:
            gone = marked()
            gone = gone.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(gone.select(F.col("v").alias("src"), F.col("u").alias("dst")))
            left = arcs.join(gone, ["src", "dst"], "left_anti")
        key = drawn(seed, F.lit(turn), F.col("walker"), F.col("dst"))
        near = state.filter("now is not null").join(left, F.col("now") == F.col("src")).groupBy("walker").agg(F.min(F.struct(key.alias("k"), "src", "dst")).alias("p"))
        picked = written(state.select("walker", "now").join(near, "walker", "left").select("walker", "now", "p.src", "p.dst"), "walk-picks")
        stuck = picked.filter("src is null").select("walker", F.row_number().over(Window.orderBy("walker")).alias("r"))  # at most ``walkers`` rows
        anew = left.withColumn("k", drawn(seed, F.lit(turn), F.col("src"), F.col("dst"))).orderBy("k", "src", "dst").limit(walkers)
        anew = anew.select("src", "dst", F.row_number().over(Window.orderBy("k", "src", "dst")).alias("r"))
        every = picked.filter("src is not null").select("walker", "src", "dst").unionByName(stuck.join(anew, "r").select("walker", "src", "dst"))
        first = every.withColumn("u", F.least("src", "dst")).withColumn("v", F.greatest("src", "dst"))
        first = first.withColumn("f", F.row_number().over(Window.partitionBy("u", "v").orderBy("walker"))).filter("f = 1")
        first = first.withColumn("step", F.row_number().over(Window.orderBy("walker")) + made).filter(F.col("step") <= budget)
        passed = written(first.select("step", "u", "v", "walker", F.col("dst").alias("to")), "walk-marks")
        count = passed.count()
        if not count:
            break
        marks.append(passed)
        made += count
        state = written(picked.select("walker", "now").join(passed.select("walker", "to"), "walker", "left").select("walker", F.coalesce("to", "now").alias("now")), "walk-state")
    if not marks:
        return spark.createDataFrame([], "step int, u long, v long")
    return marked().select("step", "u", "v")


def nested_pools(pools: DataFrame, ratios: list[float], repeats: int, seed: int) -> DataFrame:
    """direction, repeat, ratio, u, v: per direction and repeat one order, of which each ratio takes a prefix.

    ``pools`` has direction, u, v. Prefixes of one order are nested; sizes are ceil(ratio * pool).
    """
    reps = pools.withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    key = F.pmod(integer_hash(F.col("u"), F.col("v"), seed) * 31 + F.col("repeat") * 104729 + F.col("direction") * 1299709, F.lit(1000003))
    group = Window.partitionBy("direction", "repeat")
    rows = reps.withColumn("__h", key).withColumn("__r", F.row_number().over(group.orderBy("__h", "u", "v"))).withColumn("__n", F.count("*").over(group))
    wanted = rows.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return wanted.filter(F.col("__r") <= F.ceil(F.round(F.col("ratio") * F.col("__n"), 9))).select("direction", "repeat", "ratio", "u", "v")


def weighted_without_replacement(rows: DataFrame, size: int, seed: int, weight: str = "prob") -> DataFrame:
    """Exactly ``size`` distinct rows (all, if no more) with the given weights: exponential keys, bounded top-k."""
    safe = F.greatest(F.col(weight), F.lit(0.0)) + F.lit(1e-15)
    return rows.withColumn("__k", -F.log(uniform(seed, "u", "v")) / safe).orderBy("__k", "u", "v").limit(size).drop("__k")


def weighted_with_replacement(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """u, v, weight, count: ``draws`` independent draws by ``prob``, re-weighted by count * w / (draws * prob).

    Each draw is a hashed number looked up in the cumulative probabilities; probabilities are summed
    over 1024 hash blocks first, so no task orders all rows.
    """
    blocks = 1024
    keyed = rows.withColumn("__b", F.pmod(integer_hash(F.col("u"), F.col("v")), F.lit(blocks)))
    total = keyed.groupBy("__b").agg(F.sum("prob").alias("__p"))
    edge = Window.orderBy("__b")  # 1024 rows
    total = total.withColumn("__hi", F.sum("__p").over(edge)).withColumn("__lo", F.col("__hi") - F.col("__p"))
    spark = rows.sparkSession
    scale = total.agg(F.max("__hi").alias("__all"))
    shots = spark.range(draws).select(uniform(seed, "id").alias("__x"), "id").join(F.broadcast(scale)).withColumn("__x", F.col("__x") * F.col("__all"))
    hit = shots.join(F.broadcast(total), (F.col("__x") > F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
    inner = Window.partitionBy("__b").orderBy("u", "v")
    spans = keyed.join(F.broadcast(total.select("__b", "__lo")), "__b").withColumn("__to", F.col("__lo") + F.sum("prob").over(inner))
    spans = spans.withColumn("__from", F.coalesce(F.lag("__to").over(inner), F.col("__lo")))
    found = hit.select("__b", "__x").join(spans, "__b").filter((F.col("__x") > F.col("__from")) & (F.col("__x") <= F.col("__to")))
    counts = found.groupBy("u", "v", "w", "prob").agg(F.count("*").alias("count"))
    return counts.select("u", "v", (F.col("count") * F.col("w") / (draws * F.col("prob"))).alias("weight"), "count")


def walk_subgraph(graph: Graph, starts: int, length: int, seed: int) -> DataFrame:
    """Edges among the nodes that seeded random walks visit.

    A step numbers the neighbours of the nodes where walks are, and no others; the edges are only read.
    """
    near = graph.arcs()
    state = graph.spark.range(starts).select("id", F.pmod(drawn(seed, F.col("id")), F.lit(graph.n)).cast("long").alias("now"))
    seen = state.select("now")
    for k in range(length):
        pick = F.pmod(drawn(seed, F.col("id"), F.lit(k + 1)), F.col("d")).cast("int")
        here = near.join(F.broadcast(state.select(F.col("now").alias("src")).distinct()), "src", "left_semi")
        sides = here.groupBy(F.col("src").alias("now")).agg(F.count("*").alias("d"), F.sort_array(F.collect_list("dst")).alias("near"))
        state = cut(state.join(sides, "now").select("id", F.element_at("near", pick + 1).alias("now")))
        seen = seen.unionByName(state.select("now"))
    ids = cut(seen.select(F.col("now").alias("id")).distinct())
    return graph.edges.join(F.broadcast(ids.withColumnRenamed("id", "u")), "u", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "v")), "v", "left_semi").select("u", "v")


def perturbed(graph: Graph, add_ratio: float, drop_rate: float, seed: int, size: int) -> DataFrame:
    """Edges after a Bernoulli drop and ``add_ratio * size`` random pairs, repeats collapsed."""
    kept = graph.edges.filter(uniform(seed, "u", "v") >= drop_rate)
    fresh = graph.spark.range(int(add_ratio * size)).select(
        *[F.pmod(drawn(seed, F.col("id"), F.lit(k)), F.lit(graph.n)).alias(end) for k, end in ((1, "u"), (2, "v"))]
    )
    return simple_edges(kept.unionByName(fresh))


def split_nodes(graph: Graph, seed: int) -> DataFrame:
    """id, part: a tenth trains, eight tenths test, the rest validates, in hashed order.

    Ranks come from counts per hash block, so no task orders all nodes.
    """
    blocks = 256
    rows = graph.nodes().withColumn("__h", integer_hash(F.col("id"), F.col("id"), seed)).withColumn("__b", F.floor(F.col("__h") * blocks / 1000003))
    sums = rows.groupBy("__b").count()
    before = sums.withColumn("__o", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(F.broadcast(before.select("__b", "__o")), "__b")
    rank = F.col("__o") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", "id")) - 1
    one, eight = int(graph.n * 0.1), int(graph.n * 0.8)
    return placed.withColumn("__r", rank).select("id", F.when(F.col("__r") < one, "train").when(F.col("__r") < one + eight, "test").otherwise("valid").alias("part"))


def drop_nodes(graph: Graph, rate: float, seed: int) -> DataFrame:
    """Edges among the nodes that a Bernoulli drop leaves."""
    from .graph import induced

    return induced(graph.edges, graph.nodes().filter(uniform(seed, "id") >= rate))


def drop_arcs_by_weight(arcs: DataFrame, rate: float, seed: int, most: float = 0.7) -> DataFrame:
    """Arcs (src, dst, w) kept where a hashed number is not below w / mean(w) * rate, at most ``most``."""
    mean = arcs.agg(F.avg("w").alias("__mean"))
    chance = F.least(F.lit(most), F.col("w") / F.col("__mean") * rate)
    return arcs.join(F.broadcast(mean)).filter(uniform(seed, "src", "dst") >= chance).select("src", "dst", "w")


def drop_features(features: DataFrame, rate: float, seed: int) -> DataFrame:
    """Rows (id, feature, x) of the features that a Bernoulli drop of whole columns leaves."""
    return features.filter(uniform(seed, "feature") >= rate)


def random_nodes(graph: Graph, size: int, seed: int) -> DataFrame:
    return graph.nodes().orderBy(drawn(seed, F.col("id")), "id").limit(size)
