"""Top rows, best candidates, quotas and strides, with ties always decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.scan import numbered


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark drops rows beyond before they are shuffled."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)


def best(df: DataFrame, by: list[str], keys: list[Column], ordinal: str, take: list[str]) -> DataFrame:
    """Each group's row with the largest tuple of ``keys``, the smallest ordinal on ties: one aggregate, no sort."""
    top = F.struct(*(k.alias(f"_{i}") for i, k in enumerate(keys)), (-F.col(ordinal)).alias("_t"))
    return df.groupBy(*by).agg(F.max_by(F.struct(*take), top).alias("_b")).select(*by, "_b.*")


def latest_valid(df: DataFrame, by: list[str], order: str, valid: Column, take: list[str]) -> DataFrame:
    """The newest row that is valid, and how many newer ones were rejected."""
    ok = df.withColumn("_ok", valid)
    last = ok.where("_ok").groupBy(*by).agg(F.max(F.struct(order, *take)).alias("_b"))
    bad = ok.where("_ok is null or not _ok").select(*by, F.col(order).alias("_at"))
    newer = F.count_if(F.col("_at") > F.col("_b")[order])
    counted = last.join(bad, by, "left").groupBy(*by).agg(F.first("_b").alias("_b"), newer.cast("long").alias("rejected"))
    return counted.select(*by, "_b.*", "rejected")


def quotas(df: DataFrame, kind: str, order: list[Column], limits: dict[str, int], slots: dict[str, int]) -> DataFrame:
    """The first rows of each kind up to its limit, each with ``base``: the slots that all before it take.

    Kinds follow each other as in ``limits``; at most the sum of limits is left
    for the running sum, whatever the input.
    """
    limit, place, need = F.lit(0), F.lit(len(limits)), F.lit(0)
    for i, (name, n) in enumerate(limits.items()):
        limit = F.when(F.col(kind) == name, n).otherwise(limit)
        place = F.when(F.col(kind) == name, i).otherwise(place)
        need = F.when(F.col(kind) == name, slots[name]).otherwise(need)
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    few = df.where(F.col(kind).isin(*limits)).withColumn("rank", rank).where(F.col("rank") <= limit)
    line = Window.orderBy("_place", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return few.withColumn("_place", place).withColumn("_need", need).withColumn("base", F.coalesce(F.sum("_need").over(line), F.lit(0)).cast("long")).drop("_place", "_need")


def stride(df: DataFrame, order: list[str], step: int, first: int = 0, most: int | None = None) -> DataFrame:
    """Every ``step``-th row in order from the ``first``; rows are numbered without one task seeing all."""
    rows = numbered(df, order, "_n").where(F.pmod(F.col("_n") - first, F.lit(step)) == 0).where(F.col("_n") >= first)
    if most is not None:
        rows = rows.where((F.col("_n") - first) / step < most)
    return rows.drop("_n")
