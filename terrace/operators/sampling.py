"""Values of images at points between pixels, and from images of another size: joins on pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numeric import clamp


def scaled_index(i: Column, old: int, new: int) -> Column:
    """The pixel of a line of ``new`` pixels that stands for pixel ``i`` of ``old``: whole numbers, cut down, within the line."""
    return F.least(F.lit(new - 1), F.floor(i.cast("long") * new / old).cast("int"))


def resampled(points: DataFrame, pixels: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """``points (image, x, y, ..)`` on a grid of size ``old`` with the ``value`` of the nearest pixel of images of size ``new``.

    One equi join; a pixel that is not there gives null.
    """
    at = points.withColumn("_x", scaled_index(F.col("x"), old[0], new[0])).withColumn("_y", scaled_index(F.col("y"), old[1], new[1]))
    values = pixels.select("image", F.col("x").cast("int").alias("_x"), F.col("y").cast("int").alias("_y"), "value")
    return at.join(values, ["image", "_x", "_y"], "left").drop("_x", "_y")


def bilinear(points: DataFrame, pixels: DataFrame, width: int, height: int, identity: str, wrap: bool = False) -> DataFrame:
    """``(identity, value)``: the four pixels around each point ``(identity, image, x, y)``, by their distance.

    Pixel centres lie at halves; beyond the outermost ones the edge goes on, or
    with ``wrap`` the other side across. Four rows a point meet the pixels in one
    equi join and are added up; points without all four pixels give null.
    """
    across, down = F.col("x").cast("double") - 0.5, clamp(F.col("y").cast("double") - 0.5, 0.0, float(height - 1))
    if not wrap:
        across = clamp(across, 0.0, float(width - 1))
    placed = points.select(identity, "image", across.alias("_u"), down.alias("_v"))
    left, top = F.floor("_u").cast("int"), F.floor("_v").cast("int")
    tx, ty = F.col("_u") - left, F.col("_v") - top
    corners = []
    for dx in (0, 1):
        for dy in (0, 1):
            x = F.pmod(left + dx, F.lit(width)) if wrap else F.least(left + dx, F.lit(width - 1))
            part = (tx if dx else 1 - tx) * (ty if dy else 1 - ty)
            corners.append(F.struct(x.alias("x"), F.least(top + dy, F.lit(height - 1)).alias("y"), part.alias("part")))
    wanted = placed.select(identity, "image", F.inline(F.array(*corners)))
    values = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("value").cast("double").alias("value"))
    met = wanted.join(values, ["image", "x", "y"], "left").groupBy(identity)
    return met.agg(F.when(F.count("value") == 4, F.sum(F.col("part") * F.col("value"))).alias("value"))
