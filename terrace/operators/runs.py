"""What runs leave behind: counters, peaks, totals, and which of them is the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that working on an image takes for each of its pixels (a fixed value).
BYTES_PER_PIXEL = 16


def newly_observed(old: DataFrame, new: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """One row ``(newly)``: how many keys have weight in ``new`` and had none in ``old``."""
    before = old.where(F.col(weight) > 0).select(*keys)
    return new.where(F.col(weight) > 0).join(before, keys, "left_anti").agg(F.count("*").alias("newly"))


def peaks(frames: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """The largest value of each counter over a run's frames, warm-up and all."""
    return frames.groupBy(*by).agg(*(F.max(c).alias(c) for c in counters))


def totals(images: DataFrame) -> DataFrame:
    """``(images, source_bytes, working_bytes)`` of rows ``(bytes, width, height)``; zeroes without images."""
    pixels = F.col("width").cast("long") * F.col("height")
    sums = images.agg(F.count("*").alias("images"), F.sum("bytes").alias("s"), F.sum(pixels * BYTES_PER_PIXEL).alias("w"))
    return sums.select("images", F.coalesce("s", F.lit(0)).cast("long").alias("source_bytes"), F.coalesce("w", F.lit(0)).cast("long").alias("working_bytes"))


def latest(files: DataFrame, dataset: str, run: str, file: str, record: str = "run.json") -> DataFrame:
    """``(dataset, latest, runs)``: the last run by name that has its record; datasets without one have no row."""
    return files.where(F.col(file) == record).groupBy(dataset).agg(F.max(run).alias("latest"), F.countDistinct(run).alias("runs"))


def pressed(frames: DataFrame, pending: str, most: int) -> DataFrame:
    """Adds ``dropped``: frames that come while ``most`` or more are pending are not written."""
    return frames.withColumn("dropped", F.coalesce(F.col(pending) >= most, F.lit(False)))


def counters(frames: DataFrame, by: list[str], dropped: Column, failed: Column, rejected: Column) -> DataFrame:
    """``(*by, accepted, dropped, failed, rejected)``: each frame counts once, for the first of these that holds of it."""
    state = F.when(dropped, "dropped").when(failed, "failed").when(rejected, "rejected").otherwise("accepted")
    sums = frames.withColumn("_state", state).groupBy(*by)
    return sums.agg(*(F.count_if(F.col("_state") == s).alias(s) for s in ("accepted", "dropped", "failed", "rejected")))


def reasons(rows: DataFrame, why: dict[str, Column], otherwise: str = "used") -> DataFrame:
    """``(reason, n)``: rows by the first reason that holds of them, ``otherwise`` where none does."""
    reason = F.lit(otherwise)
    for name, holds in reversed(why.items()):
        reason = F.when(holds, name).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(*by, mean, deviation, rmse, n)``: mean, population deviation and root mean square; nulls count in ``n`` alone."""
    square = F.avg(F.col(value) * F.col(value))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.sqrt(square).alias("rmse"), F.count("*").alias("n"))


def stops(rows: DataFrame, by: list[str], value: str, floor: float = 1e-6) -> DataFrame:
    """``(*by, spread)``: how many times the largest value is the double of the smallest, both raised by ``floor``."""
    ratio = (F.max(value) + F.lit(floor)) / (F.min(value) + F.lit(floor))
    return rows.groupBy(*by).agg(F.log2(ratio).alias("spread"))
