"""Fusion of a stream of observations into a versioned keyed table, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.fold import ordered_rows, saturating_step, usable
from terrace.operators.tables import Versions


def fused(state: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str], value: str, weight: str, most: float) -> DataFrame:
    """``(*keys, mean, weight, observations)`` after a batch: each key's fold goes on from where it stood.

    Rows that are no observation (``usable``) are left out, as in the batch fold.
    """
    rows = ordered_rows(usable(batch, value, weight), keys, order, {"s": F.col(value).cast("double"), "w": F.col(weight).cast("double")})
    if state is None:
        start = rows.select(*keys, "rows", F.lit(0.0).alias("v"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("n"))
    else:
        before = state.select(*keys, F.col("mean").alias("v"), F.col("weight").alias("w"), F.col("observations").alias("n"))
        start = before.join(rows, keys, "full_outer").fillna({"v": 0.0, "w": 0.0, "n": 0})

    first = F.struct(F.col("v"), F.col("w"), F.col("n").cast("long").alias("n"))
    done = start.select(*keys, F.when(F.col("rows").isNull(), first).otherwise(F.aggregate("rows", first, saturating_step(most))).alias("a"))
    return done.select(*keys, F.col("a.v").alias("mean"), F.col("a.w").alias("weight"), F.col("a.n").alias("observations"))


def publisher(versions: Versions, **fold) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: publishes version ``batch_id``; a batch that comes again is not fused twice."""

    def run(batch: DataFrame, batch_id: int) -> None:
        latest = versions.latest()
        if batch_id <= latest:
            return
        state = versions.read(latest) if latest >= 0 else None
        versions.publish(fused(state, batch, **fold), latest)

    return run
