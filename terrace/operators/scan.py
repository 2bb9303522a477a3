"""Prefix sums over whole tables, offsets and run-length ranges.

A window without a partition key runs in one task. These scans deal rows out by
ranges of the whole order, sum each range, and add to each the sum of all before:
the one unpartitioned window sees a row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.lineage import cut


def exclusive_scan(df: DataFrame, order: list[str], value: str, out: str, cap: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows before in ``order``; with a cap, ``overflowed`` marks what exceeds it.

    ``order`` must identify rows, by columns of any type that sorts. Ranges are
    cut by a sample of the whole order, so a first column with one frequent value
    is cut as well, and are fixed by a checkpoint before sums are made of them.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    out_df = ranged.join(F.broadcast(offsets), "_range").withColumn(out, total)
    if cap is not None:
        out_df = out_df.withColumn("overflowed", F.col(out) + F.col(value) > cap).withColumn(out, F.least(F.lit(cap), F.col(out)))
    return out_df.drop("_range", "_before")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows numbered from 0 in ``order``, which must identify them."""
    return exclusive_scan(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")


def offsets_of(df: DataFrame, key: str, out_offset: str = "offset", out_count: str = "n") -> DataFrame:
    """``(key, n, offset)``: where each key's rows begin if all rows lie end to end by key."""
    counts = df.groupBy(key).agg(F.count("*").alias(out_count))
    return exclusive_scan(counts, [key], out_count, out_offset)


def runs(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``(key, first, last)``: the half-open range of places that each key has in rows sorted by key."""
    return offsets_of(df, key).select(key, F.col("offset").alias("first"), (F.col("offset") + F.col("n")).alias("last"))
