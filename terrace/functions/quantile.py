"""Five definitions of a quantile, each by the index it takes in sorted values.

``exact`` works on arrays of one group's values. ``ranked`` gives the same
definitions over groups of any size: values are ranked within groups, and only
the one or two ranks that count are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("upper_median", "linear", "truncated", "ceil_rank", "rounded")


def position(n: Column, q: float, kind: str) -> Column:
    """The 0-based place among ``n`` sorted values; fractional for ``linear``."""
    if kind == "upper_median":
        return F.floor(n / 2).cast("double")
    if kind == "linear":
        return q * (n - 1)
    if kind == "truncated":
        return F.least(n - 1, F.floor(q * (n - 1))).cast("double")
    if kind == "ceil_rank":
        return F.greatest(F.lit(0.0), F.ceil(q * n) - 1).cast("double")
    if kind == "rounded":
        return F.bround((n - 1) * q).cast("double")
    raise ValueError(f"no quantile is called {kind}; known are {', '.join(KINDS)}")


def exact(values: Column, q: float, kind: str) -> Column:
    """The quantile of an array; null if it is empty."""
    ordered = F.sort_array(values)
    place = position(F.size(values), q, kind)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    at = F.get(ordered, low) + (F.get(ordered, high) - F.get(ordered, low)) * (place - low)
    return F.when(F.size(values) > 0, at)


def linear(value: Column, q: float) -> Column:
    """Aggregate of the linear definition; counts per distinct value are combined before the shuffle."""
    return F.percentile(value, F.lit(q))


def ranked(df: DataFrame, by: list[str], value: str, q: float, kind: str, out: str) -> DataFrame:
    """``(*by, out)`` over groups of any size.

    Equal values of a group are counted first, so a group shrinks to its distinct
    values. These are dealt out by ranges of group and value; a running sum over
    the ranges, a row for each group in each, names the one or two in which a
    group's place lies, and values are put in order within these alone.
    """
    from terrace.operators.lineage import cut

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    line = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
    placed = (
        sums.withColumn("_before", F.sum("_in").over(line) - F.col("_in"))
        .withColumn("_place", position(F.sum("_in").over(group), q, kind))
        .where((F.col("_before") <= F.ceil("_place")) & (F.col("_before") + F.col("_in") > F.floor("_place")))
    )
    held_in = placed.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_range").alias("_at"), "_before", "_place")
    same = F.col("_range") == F.col("_at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.join(held_in, same).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def held(place: Column) -> Column:
        return (F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)

    low, high = F.floor("_place"), F.ceil("_place")
    ends = near.groupBy(*by).agg(
        F.max(F.when(held(low), F.col(value))).alias("_low"),
        F.max(F.when(held(high), F.col(value))).alias("_high"),
        F.first(F.col("_place") - low).alias("_part"),
    )
    return ends.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(out))
