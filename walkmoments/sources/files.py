"""Edge lists, result tables and snapshots as files."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, pair, simple_edges
from . import store


def _rows(spark: SparkSession, path: str, comma: bool) -> DataFrame:
    """first and second field of every line but comments and blank lines; gz is read as it is."""
    line = F.trim(F.col("value"))
    text = spark.read.text(path).filter(~line.startswith("#") & (line != ""))
    parts = F.split(line, r"\s*,\s*" if comma else r"\s+")
    return text.select(F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """u, v as the file has them: commas for .csv, else white space; one header line may be there.

    Lines that aren't two integers are an error, but for one such line (the header).
    """
    rows = _rows(spark, path, path.endswith(".csv")).select(F.expr("try_cast(a as bigint)").alias("u"), F.expr("try_cast(b as bigint)").alias("v"))
    bad = rows.filter("u is null or v is null").limit(2).count()
    if bad > 1:
        raise ValueError(f"{path} holds lines that are no edges")
    return rows.filter("u is not null and v is not null")


def read_relabelled(spark: SparkSession, path: str) -> Graph:
    """Lenient reading of a raw edge list (also .gz): loops and repeats go, ids become 0..n-1 in order.

    Dense ranks come from a range-partitioned order of the distinct ids: counts of each range, then
    places within it.
    """
    from pyspark.sql import Window

    raw = _rows(spark, path, False).select(F.expr("try_cast(a as bigint)").alias("u"), F.expr("try_cast(b as bigint)").alias("v")).filter("u is not null and v is not null and u <> v")
    ids = raw.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    blocks = 256
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        raise ValueError(f"{path} holds no edges")
    width = (high - low) // blocks + 1
    keyed = ids.withColumn("b", F.floor((F.col("id") - low) / width))
    before = keyed.groupBy("b").count().withColumn("o", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = keyed.join(F.broadcast(before.select("b", "o")), "b").select("id", (F.col("o") + F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1).alias("new"))
    rows = raw.join(named.select(F.col("id").alias("u"), F.col("new").alias("x")), "u").join(named.select(F.col("id").alias("v"), F.col("new").alias("y")), "v")
    edges = simple_edges(rows.select(F.col("x").alias("u"), F.col("y").alias("v")))
    return Graph(edges, ids.count())


def write_deltas(deltas: DataFrame, path: str) -> int:
    """One CSV file u,v,delta_m<k>... in edge order, at any URI; returns the number of rows.

    Rows are sorted in ranges by all tasks; one task, as one file needs, streams the ranges in order into a
    staged file that takes the target's place by a rename. Nothing comes to the driver.
    """
    seen, staged = Observation(), store.staging(path)
    # counted behind the sort, whose sampling reads the rows before it twice
    rows = deltas.orderBy("u", "v").coalesce(1).observe(seen, F.count(F.lit(1)).alias("n"))
    try:
        rows.write.csv(staged, header=True)
        store.commit(store.only_part(staged, ".csv"), path)
    finally:
        store.remove(staged)
    return seen.get["n"]


def write_rows(rows: list[dict], path: str, columns: list[str] | None = None, append: bool = False) -> None:
    """CSV of a few dict rows at any URI: given columns, or all in order of first sight; nothing for no rows.

    The file is replaced whole. ``append`` keeps what is there, under a lock; a header is written only to a new file.
    """
    if not rows and columns is None:
        return
    names = columns or list(dict.fromkeys(k for r in rows for k in r))

    def text(header: bool) -> str:
        out = io.StringIO(newline="")
        table = csv.DictWriter(out, names)
        if header:
            table.writeheader()
        table.writerows(rows)
        return out.getvalue()

    if not append:
        store.write_text(text(True), path)
        return
    with store.locked(path):
        before = store.read_text(path) if store.exists(path) else None
        store.write_text(text(True) if before is None else before + text(False), path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings."""
    if not store.exists(path):
        raise FileNotFoundError(path)
    return spark.read.csv(path, header=True)


def write_json(value, path: str) -> None:
    """Replaces the file at any URI; what JSON lacks is written as text."""
    store.write_text(json.dumps(value, indent=2, sort_keys=True, default=str), path)


def write_snapshots(snapshots: DataFrame, moments: DataFrame, path: str) -> None:
    """Edges by step, and their moments, as Parquet."""
    snapshots.write.mode("overwrite").partitionBy("step").parquet(f"{path}/edges")
    moments.write.mode("overwrite").parquet(f"{path}/moments")


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/moments")


def read_collection(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """graph_id, u, v relabelled to 0.. within each graph, and graph_id, n; graphs without edges go."""
    from pyspark.sql import Window

    edges = rows.select("graph_id", *pair(F.col("u"), F.col("v"))).filter("u <> v").distinct()
    ids = edges.select("graph_id", F.explode(F.array("u", "v")).alias("id")).distinct()
    named = ids.withColumn("new", F.row_number().over(Window.partitionBy("graph_id").orderBy("id")).cast("long") - 1)
    one, two = named.select("graph_id", F.col("id").alias("u"), F.col("new").alias("x")), named.select("graph_id", F.col("id").alias("v"), F.col("new").alias("y"))
    found = edges.join(one, ["graph_id", "u"]).join(two, ["graph_id", "v"]).select("graph_id", F.col("x").alias("u"), F.col("y").alias("v"))
    return found, ids.groupBy("graph_id").agg(F.count("*").alias("n"))
