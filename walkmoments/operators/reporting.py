"""Experiment tables: grouped summaries, pairing with controls, shards and budgets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIG = ("dataset", "method", "remove_ratio", "orders", "backend", "strategy", "top_k", "normalization")


def summarize(rows: DataFrame, keys=CONFIG, metrics=None) -> DataFrame:
    """Per configuration: count, mean and population deviation; null where a metric lacks a value in any row."""
    numeric = [c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint", "smallint") and c not in keys]
    out = [F.count("*").alias("count")]
    for m in metrics or numeric:
        whole = F.count(m) == F.count("*")
        out += [F.when(whole, F.avg(m)).alias(f"{m}_mean"), F.when(whole, F.stddev_pop(m)).alias(f"{m}_std")]
    return rows.groupBy(*keys).agg(*out)


def paired(rows: DataFrame, controls: DataFrame, on: list[str], metric: str, order: str) -> DataFrame:
    """Rows joined with the last control (by ``order``) of their key, and the difference; rows without one go."""
    last = controls.groupBy(*on).agg(F.max_by(metric, order).alias("control"))
    return rows.join(last, on).withColumn("difference", F.col(metric) - F.col("control"))


def interval(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """keys, count, mean, std (population) and 1.96 std / sqrt(count)."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    return out.withColumn("ci95", 1.96 * F.col("std") / F.sqrt("count"))


def best_point(rows: DataFrame, point: str, metric: str) -> DataFrame:
    """point, mean, std per point, and whether its mean is the greatest (least point on ties)."""
    sums = rows.groupBy(point).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    top = sums.agg(F.max(F.struct(F.col("mean"), (-F.col(point)).alias("p"))).alias("t")).select((-F.col("t.p")).alias("best"))
    return sums.join(F.broadcast(top)).withColumn("is_best", F.col(point) == F.col("best")).drop("best")


def coordinate_mean(rows: DataFrame, metric: str, digits: int = 12) -> DataFrame:
    return rows.groupBy(F.round("m2", digits).alias("m2"), F.round("m3", digits).alias("m3")).agg(F.avg(metric).alias("mean"))


def merged_shards(shards: list[DataFrame], key: list[str], expected: DataFrame) -> DataFrame:
    """The union of shards; raises on repeated keys, and on keys that are missing or unexpected."""
    whole = shards[0]
    for s in shards[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    counts = whole.groupBy(*key).agg(F.count("*").alias("n"))
    checked = counts.join(expected.select(*key, F.lit(True).alias("e")).distinct(), key, "full")
    bad = checked.agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra")).first()
    for name in ("twice", "missing", "extra"):
        if bad[name]:
            raise ValueError(f"{bad[name]} keys are {name}")
    return whole


def class_stats(classified: DataFrame, kept: DataFrame, directions: int) -> DataFrame:
    """direction, edges, kept, mean_rel_m2, mean_rel_m3 for every direction, empty ones included."""
    spark = classified.sparkSession
    sums = classified.groupBy("direction").agg(F.count("*").alias("edges"), F.avg("rel_m2").alias("mean_rel_m2"), F.avg("rel_m3").alias("mean_rel_m3"))
    left = classified.join(kept.select("u", "v"), ["u", "v"], "left_semi").groupBy("direction").agg(F.count("*").alias("kept"))
    base = spark.range(directions).select(F.col("id").cast("int").alias("direction"))
    zero = F.lit(0).cast("long")
    rows = base.join(sums, "direction", "left").join(left, "direction", "left")
    return rows.select("direction", F.coalesce("edges", zero).alias("edges"), F.coalesce("kept", zero).alias("kept"), "mean_rel_m2", "mean_rel_m3")


def edit_stats(edits: DataFrame) -> DataFrame:
    """Mean and deviation over runs of added, deleted and one-sided edits."""
    runs = edits.groupBy("run_id").agg(F.count_if(F.col("op") == "add").alias("added"), F.count_if(F.col("op") == "delete").alias("deleted"))
    runs = runs.withColumn("uneven", F.abs(F.col("added") - F.col("deleted")))
    return runs.agg(*[f(c).alias(f"{c}_{name}") for c in ("added", "deleted", "uneven") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def budgets(pool: int, ratios: list[float]) -> list[int]:
    """ceil(ratio * pool) for each ratio."""
    return [min(pool, math.ceil(round(r * pool, 9))) for r in ratios]


def checkpoint_steps(edges: int, most: float, step: float) -> list[int]:
    """Distinct deletion counts at multiples of ``step`` up to ``most`` of the edges; halves round to even."""
    count = round(most / step)
    return sorted({round(edges * min(most, step * k)) for k in range(count + 1)})


def snapshot_id(direction: int, ratio: float, budget: int, repeat: int) -> str:
    return f"dir{direction:02d}_ratio{round(ratio * 1_000_000):06d}_bud{budget:05d}_rep{repeat:02d}"


def pending(jobs: DataFrame, done: DataFrame, key: list[str], shard: int, shards: int) -> DataFrame:
    """Jobs of one shard (row index modulo shards) that have no result yet."""
    return jobs.filter(F.pmod("row_index", F.lit(shards)) == shard).join(done.select(*key), key, "left_anti")
