"""Scans, numbering, sorts, search, histograms: what the other operators build on.

A running sum over a whole table has two steps: sums within ranges of the order, which are computed
side by side, and the sums of the ranges before, a small table of one row a range. So no task has to
take all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Steps


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds _p, the number of the range that a row is in; ranges follow the order.

    Stored, as the ranges' bounds come from a sample that another run of the plan may draw differently.
    """
    return Steps(df.sparkSession, "ranges").keep("rows", df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running_sum(df: DataFrame, *order, value: str = "v") -> DataFrame:
    """Adds `before` (the sum of all rows earlier in the order) and `upto` (that and the row's own). The order should be total."""
    order = _columns(order or ("i",))
    parts = _ranges(df, order)
    sums = parts.groupBy("_p").agg(F.sum(value).alias("_s"))
    base = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("_in", within).join(F.broadcast(base), "_p")  # a row for each partition
    return out.select(*df.columns, (F.col("_base") + F.col("_in") - F.col(value)).alias("before"), (F.col("_base") + F.col("_in")).alias("upto"))


def exclusive_sum(df: DataFrame, *order, value: str = "v") -> DataFrame:
    return running_sum(df, *order, value=value).drop("upto")


def inclusive_sum(df: DataFrame, *order, value: str = "v") -> DataFrame:
    return running_sum(df, *order, value=value).drop("before")


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds `place`, the row's number in the order, from 0."""
    return exclusive_sum(df.withColumn("_one", F.lit(1).cast("long")), *order, value="_one").withColumnRenamed("before", "place").drop("_one")


def histogram(df: DataFrame, value: str = "v") -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def reverse_map(df: DataFrame, label: str = "label", member: str = "i") -> DataFrame:
    return df.groupBy(label).agg(F.sort_array(F.collect_list(member)).alias("members"))


def permute(df: DataFrame, order: DataFrame) -> DataFrame:
    """order (i, p): the entry at i goes to p."""
    return df.join(order, "i").select(F.col("p").alias("i"), *[c for c in df.columns if c != "i"])


def permute_blocks(df: DataFrame, order: DataFrame, size: int) -> DataFrame:
    """The same for a vector of blocks: order is of the blocks."""
    parts = df.withColumn("_b", F.floor(F.col("i") / size).cast("long")).join(order.select(F.col("i").alias("_b"), "p"), "_b")
    return parts.select((F.col("p") * size + F.pmod("i", F.lit(size))).alias("i"), *[c for c in df.columns if c != "i"])


def bound(keys: DataFrame, sorted_values: DataFrame, upper: bool = False) -> DataFrame:
    """key, at: how many of the values are below the key (upper: not above it). One sort of both together, no pairs."""
    both = keys.select(F.col("key").alias("x"), F.lit(0 if not upper else 1).alias("side"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("ask")).unionByName(
        sorted_values.groupBy(F.col("v").alias("x")).agg(F.count("*").alias("n")).select("x", F.lit(0 if upper else 1).alias("side"), "n", F.lit(False).alias("ask"))
    )
    out = running_sum(both, "x", "side", value="n")
    return out.where("ask").select(F.col("x").alias("key"), F.col("before").alias("at"))


def differences(df: DataFrame) -> DataFrame:
    """The next entry less this one, by i; the last has none."""
    pairs = df.join(df.select((F.col("i") - 1).alias("i"), F.col("v").alias("next")), "i")
    return pairs.select("i", (F.col("next") - F.col("v")).alias("v"))


def identical(a: DataFrame, b: DataFrame, eps: float, relative: bool = False) -> DataFrame:
    """One row: whether the vectors have the same indices and, within eps, the same values."""
    both = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), [c for c in a.columns if c != "v"], "full")
    gap = F.abs(F.col("x") - F.col("y"))
    near = gap <= (F.lit(eps) * F.greatest(F.abs("x"), F.abs("y")) if relative else F.lit(eps))
    return both.agg(F.coalesce(F.bool_and(F.coalesce(near, F.lit(False))), F.lit(True)).alias("same"))


def mark_duplicates(df: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Adds `again`: whether the same pair stands earlier."""
    return df.withColumn("again", F.row_number().over(Window.partitionBy(key, value).orderBy("i")) > 1)


def fill_zeros_forward(df: DataFrame, groups: Column) -> DataFrame:
    """Zeros take the last value before them that isn't zero, within a group of rows."""
    last = F.last(F.when(F.col("v") != 0, F.col("v")), ignorenulls=True).over(Window.partitionBy(groups).orderBy("i"))
    return df.withColumn("v", F.coalesce(last, F.lit(0.0)))
