"""Shared helpers: shared-folder tables, defined whitespace, prefix sums."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The only characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A row filter has so many bits a row, and at most 2 ** FILTER_BITS: 2 ** (FILTER_BITS - 6) longs are broadcast, whatever the input.
ROW_BITS, FILTER_BITS = 8, 25

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that setting is missing on a local master (tests on one machine) a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="walkmoments-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialize(df: DataFrame, label: str = "table", compression: str = "lz4") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here.

    The table survives lost executors, is column-pruned on reading and is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path  # for drop_table
    return out


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Actions inside send Python workers batches of about ``size`` bytes; the session's own setting returns after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing will read again."""
    path = getattr(df, "_shared_path", None)
    if path is None:
        return
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    df._shared_path = None


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def filter_of(numbers: DataFrame, rows: int, name: str = "rid") -> tuple[DataFrame, int]:
    """A bit for each of the ``rows`` hashed numbers: __f_word, __f_bits, and the shift that gives a number's word.

    Join ``F.broadcast`` of it on the word and test :func:`hit`. No number is missed; more numbers
    than bits only let more of the others pass.
    """
    width = min(FILTER_BITS, max(12, (ROW_BITS * max(rows, 1)).bit_length()))
    words = numbers.groupBy(F.shiftrightunsigned(name, 70 - width).alias("__f_word")).agg(F.bit_or(_bit(F.col(name))).alias("__f_bits"))
    return words, 70 - width


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))


def hit(number: Column) -> Column:
    return F.coalesce(F.col("__f_bits").bitwiseAND(_bit(number)) != 0, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the values alone, alike on every run and partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def block_prefix(df: DataFrame, keys: list[str], block: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row, within ``keys``, in order of (block, order).

    Hot keys are split: sums by (key, block) are pre-aggregated map-side, prefixed over the few
    blocks, and only one block's rows are sorted together. ``block`` must follow ``order``; keys
    and block must not be null.
    """
    zero = F.lit(0).cast("long")
    with_block = df.withColumn("__b", block)
    sums = with_block.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    over_blocks = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(over_blocks), zero)).drop("__s")
    in_block = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = with_block.withColumn("__w", F.coalesce(F.sum(value).over(in_block), zero))
    return within.join(before, [*keys, "__b"]).withColumn(out, F.col("__before") + F.col("__w")).drop("__b", "__before", "__w")


def range_prefix(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each out: value of ``sums``, the sum of value over all rows before a row in ``order``.

    ``order`` must be unique and not null. Rows are dealt by ranges and written once with the number
    of their range; ranges are summed and prefixed (one row a range), and a task sorts one range.
    """
    dealt = materialize(df.repartitionByRange(order).withColumn("__b", F.spark_partition_id()), "ranges")
    over_ranges = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    in_range = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__b").agg(*[F.sum(v).alias(f"__s_{k}") for k, v in sums.items()])
    before = parts.select("__b", *[F.sum(f"__s_{k}").over(over_ranges).alias(f"__s_{k}") for k in sums])
    out = dealt
    for k, v in sums.items():
        out = out.withColumn(k, F.sum(v).over(in_range))
    out = out.join(F.broadcast(before), "__b")  # one row a range
    for k, v in sums.items():
        zero = F.lit(0).cast(df.schema[v].dataType)
        out = out.withColumn(k, F.coalesce(F.col(f"__s_{k}"), zero) + F.coalesce(F.col(k), zero))
    return out.drop("__b", *[f"__s_{k}" for k in sums])
