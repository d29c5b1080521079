"""Graphs derived from the star-schema tables, synthetic graphs, and the dataset registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph, simple_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def handover(spark: SparkSession, sf_dir: str) -> Graph:
    """Users whose purchases follow each other; n is the greatest user id plus one."""
    events = table(spark, sf_dir, "events")
    n = events.agg(F.max("user_id")).first()[0] + 1
    return Graph(simple_edges(handover_pairs(events)), int(n))


def handover_pairs(events: DataFrame) -> DataFrame:
    """u, v for every purchase and the next one by time.

    The next row of the whole table: time buckets (days) are windowed apart, and each bucket's last
    row is joined to the next bucket's first, so no task sorts the whole table.
    """
    rows = events.filter("event_type = 'purchase'").select("ts", "event_id", F.col("user_id").cast("long").alias("a"), F.to_date("ts").alias("day"))
    order = Window.partitionBy("day").orderBy("ts", "event_id")
    inner = rows.withColumn("b", F.lead("a").over(order))
    key = F.struct("ts", "event_id", "a")
    days = rows.groupBy("day").agg(F.min(key).alias("first"), F.max(key).alias("last"))  # one row a day
    across = days.withColumn("next", F.lead("first").over(Window.orderBy("day"))).select(F.col("last.a").alias("a"), F.col("next.a").alias("b"))
    return inner.select("a", "b").unionByName(across).filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))


#: Parts for which one task more pairs the lines of orders, and one more tells the pairs apart.
PARTS_OF_TASK = 1 << 15


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts ordered together in urgent orders; n counts all parts.

    An order's lines are few bytes and its pairs many, so both are dealt to a number of tasks that follows the parts:
    what a task sorts and holds is the same at every size, while parts have about as many lines each.
    """
    n = table(spark, sf_dir, "part").count()
    tasks = n // PARTS_OF_TASK + 1
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("p")).repartition(tasks, "l_orderkey")
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey")).repartition(tasks, "l_orderkey")
    lines = lines.join(urgent, "l_orderkey", "left_semi")
    pairs = lines.withColumnRenamed("p", "u").join(lines.withColumnRenamed("p", "v"), "l_orderkey").filter("u < v")
    return Graph(pairs.select("u", "v").repartition(tasks, "u", "v").distinct(), n)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Bipartite: suppliers and, behind them, parts."""
    suppliers = table(spark, sf_dir, "supplier").count()
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("u"), (F.col("l_partkey") + suppliers).cast("long").alias("v")).distinct()
    return Graph(edges, suppliers + table(spark, sf_dir, "part").count())


def stars(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and their customers."""
    customers = table(spark, sf_dir, "customer")
    edges = customers.select(F.col("c_nationkey").cast("long").alias("u"), (F.col("c_custkey") + 25).cast("long").alias("v"))
    return Graph(edges, customers.count() + 25)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations that trade; n is 25."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("u"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("v"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").join(customer, "c_custkey").join(supplier, "l_suppkey")
    return Graph(simple_edges(rows.select("u", "v")), 25)


REGISTRY: dict[str, Callable[[SparkSession, str], Graph]] = {"handover": handover, "copurchase": copurchase, "supply": supply, "stars": stars, "trade": trade}
ALIASES = {"users": "handover", "parts": "copurchase", "supplierpart": "supply", "nationcustomer": "stars", "nations": "trade"}


def dataset_name(name: str) -> str:
    """The registered name of ``name``, whatever its case, underscores and hyphens."""
    key = name.lower().replace("_", "").replace("-", "")
    key = ALIASES.get(key, key)
    if key not in REGISTRY:
        raise ValueError(f"unknown graph {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return key


def load(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    return REGISTRY[dataset_name(name)](spark, sf_dir)


def _pairs(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    return simple_edges(spark.createDataFrame(rows, "u long, v long"))


# Edges of the two small graphs.
HOUSE = [(0, 1), (1, 2), (2, 3), (0, 3), (2, 4), (3, 4)]
BULL = [(0, 1), (1, 2), (0, 2), (0, 3), (1, 4)]


def synthetic(spark: SparkSession, kind: str, n: int) -> Graph:
    """Standard graphs, generated in Spark. friendship has 20 blades and tree 15 parents whatever n."""
    ids, u = spark.range(n), F.col("id").alias("u")
    if kind == "complete":
        last = F.lit(n - 1).cast("long")
        return Graph(spark.range(n - 1).select(u, F.explode(F.sequence(F.col("id") + 1, last)).alias("v")), n)
    if kind == "path":
        return Graph(spark.range(n - 1).select(u, (F.col("id") + 1).alias("v")), n)
    if kind == "cycle":
        return Graph(simple_edges(ids.select(u, F.pmod(F.col("id") + 1, F.lit(n)).alias("v"))), n)
    if kind == "star":
        return Graph(spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")), n)
    if kind == "lollipop":
        half = n // 2
        tail = spark.range(half - 1, n - 1).select(u, (F.col("id") + 1).alias("v"))
        return Graph(synthetic(spark, "complete", half).edges.unionByName(tail), n)
    if kind == "friendship":
        blades = spark.range(20).select((2 * F.col("id") + 1).alias("x"), (2 * F.col("id") + 2).alias("y"))
        zero = F.lit(0).cast("long").alias("u")
        edges = blades.select(zero, F.col("x").alias("v")).unionByName(blades.select(zero, F.col("y").alias("v"))).unionByName(blades.select(F.col("x").alias("u"), F.col("y").alias("v")))
        return Graph(edges, 41)
    if kind == "tree":
        parents = spark.range(15)
        return Graph(parents.select(u, F.explode(F.array(2 * F.col("id") + 1, 2 * F.col("id") + 2)).alias("v")), 31)
    if kind == "house":
        return Graph(_pairs(spark, HOUSE), 5)
    if kind == "bull":
        return Graph(_pairs(spark, BULL), 5)
    raise ValueError(f"unknown synthetic graph {kind!r}")
