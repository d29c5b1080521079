"""An extension: a stream of edge edits, whose graph and moments are brought up to date each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph, pair
from ..operators.moments import moment_rows


def latest_edges(edits: DataFrame) -> DataFrame:
    """The edges that the last edit of each pair (by seq) leaves, from rows op, u, v, seq."""
    rows = edits.select("op", *pair(F.col("u"), F.col("v")), "seq").filter("u <> v")
    return rows.groupBy("u", "v").agg(F.max_by("op", "seq").alias("op")).filter("op = 'add'").select("u", "v")


def follow(edits: DataFrame, n: int, folder: str, orders=(2, 3)):
    """Writes edits to ``folder``/log and, per batch, moments to ``folder``/moments (batch, k, m).

    Batches may come again after a failure: each overwrites its own partition, so results are exact.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        graph = Graph(latest_edges(spark.read.parquet(f"{folder}/log")), n)
        moment_rows(graph, orders).write.mode("overwrite").parquet(f"{folder}/moments/batch={number}")

    return edits.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
