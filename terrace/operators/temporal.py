"""Joins on time: the nearest row within a tolerance, and values between two rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, tolerance: float, out: str = "matched") -> DataFrame:
    """``left`` with the nearest right row of its key: ``matched_at`` and ``matched``; null beyond the tolerance.

    A tie between an earlier and a later row goes to the later, and among rows of
    one time to the smallest value. Both sides go through windows, so no pairs are
    made. A window is a key and a bucket of time as wide as the tolerance, into
    which the right rows of the buckets before and after it come too: all that
    can match. So a key with very many rows is spread over its buckets.
    """
    best = right.groupBy(*by, at).agg(F.min(value).alias("_v"))
    bucket = F.floor(F.col(at) / (tolerance or 1.0))
    around = F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket")
    both = left.select(*by, at, bucket.alias("_bucket"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(best.schema["_v"].dataType).alias("_v")).unionByName(
        best.select(*by, at, around, F.lit(None).cast(f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in left.schema)}>").alias("_row"), "_v")
    )
    hit = F.when(F.col("_row").isNull(), F.struct(F.col(at).alias("at"), F.col("_v").alias("v")))
    order = Window.partitionBy(*by, "_bucket").orderBy(at)
    # a right row of the same time counts as later, so ranges, not rows
    earlier = F.last(hit, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    later = F.first(hit, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("_e", earlier).withColumn("_l", later).where("_row is not null")
    before = F.col(at) - F.col("_e.at")
    after = F.col("_l.at") - F.col(at)
    pick = F.when(F.col("_l").isNotNull() & (F.col("_e").isNull() | (after <= before)), F.col("_l")).otherwise(F.col("_e"))
    near = F.when(F.abs(pick["at"] - F.col(at)) <= tolerance, pick)
    return seen.select("_row.*", near["at"].alias(f"{out}_at"), near["v"].alias(out))


def interpolated(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, out: str = "value_at") -> DataFrame:
    """``left`` with the right value between the rows before and after it, linear in time; the end's value outside."""
    points = right.groupBy(*by, at).agg(F.max(value).alias("_v"))
    kind = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in left.schema) + ">"
    both = left.select(*by, at, F.struct(*left.columns).alias("_row"), F.lit(None).cast("double").alias("_v")).unionByName(
        points.select(*by, at, F.lit(None).cast(kind).alias("_row"), F.col("_v").cast("double"))
    )
    hit = F.when(F.col("_row").isNull(), F.struct(F.col(at).alias("at"), F.col("_v").alias("v")))
    order = Window.partitionBy(*by).orderBy(at)
    seen = (
        both.withColumn("_e", F.last(hit, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("_l", F.first(hit, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)))
        .where("_row is not null")
    )
    span = F.col("_l.at") - F.col("_e.at")
    part = F.when(span > 0, (F.col(at) - F.col("_e.at")) / F.nullif(span, F.lit(0).cast(span_type(left, at)))).otherwise(0.0)
    between = F.col("_e.v") + (F.col("_l.v") - F.col("_e.v")) * part
    return seen.select("_row.*", F.coalesce(between, F.col("_e.v"), F.col("_l.v")).alias(out))


def span_type(df: DataFrame, at: str):
    return df.schema[at].dataType


def out_of_order(df: DataFrame, by: list[str], ordinal: str, at: str) -> DataFrame:
    """Rows whose ordinal isn't above, or whose time is below, that of the row before: ``(*by, ordinal, code)``."""
    order = Window.partitionBy(*by).orderBy("_arrival")
    seen = df.withColumn("_o", F.lag(ordinal).over(order)).withColumn("_t", F.lag(at).over(order))
    code = F.when(F.col(ordinal) <= F.col("_o"), "ordinal-order").when(F.col(at) < F.col("_t"), "time-order")
    return seen.withColumn("code", code).where("code is not null").select(*by, ordinal, "code")
