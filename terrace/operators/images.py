"""Images as rows ``(image, x, y, value)``: statistics, fingerprints and stencils."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.lineage import cut


def pixels_of(df: DataFrame, image: str, values: str, width: int) -> DataFrame:
    """An array of row-major values as pixels."""
    out = df.select(F.col(image).alias("image"), F.posexplode(values).alias("_i", "value"))
    return out.select("image", (F.col("_i") % width).cast("int").alias("x"), F.floor(F.col("_i") / width).cast("int").alias("y"), F.col("value").cast("double").alias("value"))


def statistics(pixels: DataFrame) -> DataFrame:
    """Mean and population deviation of each image."""
    return pixels.groupBy("image").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def fingerprint(pixels: DataFrame, width: int, height: int, cells: int) -> DataFrame:
    """``(image, cx, cy, value)``: means of a grid of cells, rounded down."""
    cx, cy = F.floor(F.col("x") * cells / width).cast("int"), F.floor(F.col("y") * cells / height).cast("int")
    return pixels.groupBy("image", cx.alias("cx"), cy.alias("cy")).agg(F.floor(F.sum("value") / F.count("*")).alias("value"))


def laplacian_energy(pixels: DataFrame) -> DataFrame:
    """Mean square of four times a pixel less its four neighbours, over pixels that have all four."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    beside = pixels.withColumn("_w", F.lag("value").over(row)).withColumn("_e", F.lead("value").over(row))
    around = beside.withColumn("_n", F.lag("value").over(column)).withColumn("_s", F.lead("value").over(column))
    r = 4 * F.col("value") - F.col("_w") - F.col("_e") - F.col("_n") - F.col("_s")
    return around.where(r.isNotNull()).groupBy("image").agg(F.avg(r * r).alias("energy"))


def _moved(pixels: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Every pixel's value at each place a step away."""
    at = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps)))
    out = pixels.withColumn("_d", at)
    return out.select("image", (F.col("x") + F.col("_d.dx")).alias("x"), (F.col("y") + F.col("_d.dy")).alias("y"), "value")


def neighbourhood(pixels: DataFrame) -> DataFrame:
    """Smallest and largest value of each pixel's 3 x 3 surroundings within the image."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    near = _moved(pixels.where("value is not null"), steps).groupBy("image", "x", "y").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return pixels.join(near, ["image", "x", "y"])


def dilated(pixels: DataFrame, rounds: int = 1) -> DataFrame:
    """Empty (null) pixels filled with the mean of their filled four neighbours, round by round; rounds are cut from each other."""
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    for k in range(rounds):
        pixels = cut(pixels) if k else pixels
        near = _moved(pixels.where("value is not null"), steps).groupBy("image", "x", "y").agg(F.avg("value").alias("_near"))
        pixels = pixels.join(near, ["image", "x", "y"], "left").select("image", "x", "y", F.coalesce("value", "_near").alias("value"))
    return pixels


def gradient(pixels: DataFrame) -> DataFrame:
    """Central differences along x and y; one-sided at the edges."""
    out = pixels
    for axis, other, name in (("x", "y", "gx"), ("y", "x", "gy")):
        line = Window.partitionBy("image", other).orderBy(axis)
        after, before = F.lead("value").over(line), F.lag("value").over(line)
        steps = F.when(after.isNotNull(), 1).otherwise(0) + F.when(before.isNotNull(), 1).otherwise(0)
        d = F.coalesce(after, F.col("value")) - F.coalesce(before, F.col("value"))
        out = out.withColumn(name, F.when(steps > 0, d / F.nullif(steps, F.lit(0))).otherwise(0.0))
    return out
