"""Views of triangles: depth maps, visibility, scores, exposure gains, atlas cells and blended colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import quantile
from terrace.functions.numeric import clamp
from terrace.operators.ranking import top_per_group


def _pixels(low: Column, high: Column, most: int) -> Column:
    """Whole pixels of a line whose centres may lie in [low, high]."""
    a = F.greatest(F.lit(0), F.floor(low)).cast("int")
    b = F.least(F.lit(most - 1), F.floor(high)).cast("int")
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def depth_map(triangles: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """``(*by, px, py, depth)``: the nearest depth at the centre of each pixel that a triangle covers.

    ``triangles`` holds projected corners ``x0, y0, z0`` to ``x2, y2, z2``. Depth
    is interpolated as its reciprocal, which is linear on the image. Triangles with
    a corner at or behind the camera, without area, or with a null are left out.
    The minimum is taken before the shuffle as well as after it.
    """
    x, y, z = ([F.col(f"{a}{k}").cast("double") for k in range(3)] for a in "xyz")
    area = (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])
    usable = (z[0] > 1e-8) & (z[1] > 1e-8) & (z[2] > 1e-8) & (F.abs(area) > 1e-12)
    rows = triangles.where(usable).withColumn("_area", area)
    rows = rows.withColumn("py", F.explode(_pixels(F.least(*y), F.greatest(*y), height)))
    rows = rows.withColumn("px", F.explode(_pixels(F.least(*x), F.greatest(*x), width)))
    cx, cy = F.col("px") + 0.5, F.col("py") + 0.5

    def weight(a: int, b: int) -> Column:
        return ((x[b] - x[a]) * (cy - y[a]) - (cx - x[a]) * (y[b] - y[a])) / F.col("_area")

    rows = rows.withColumn("_w", F.array(weight(1, 2), weight(2, 0), weight(0, 1)))
    inside = F.forall("_w", lambda w: w >= 0)
    inverse = sum((F.get("_w", F.lit(k)) / z[k] for k in range(1, 3)), F.get("_w", F.lit(0)) / z[0])
    return rows.where(inside).groupBy(*by, "px", "py").agg(F.min(1 / inverse).alias("depth"))


def nearest_around(depth: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """``depth`` with the minimum over each pixel and its eight neighbours, also at pixels that were empty."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    moved = depth.withColumn("_s", F.explode(steps))
    moved = moved.withColumn("px", F.col("px") + F.col("_s.i")).withColumn("py", F.col("py") + F.col("_s.j"))
    moved = moved.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    return moved.groupBy(*by, "px", "py").agg(F.min("depth").alias("depth"))


def visible(points: DataFrame, nearest: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Points ``(*by, px, py, z, ..)`` not hidden behind ``nearest``: an equi join on camera and pixel."""
    seen = nearest.withColumnRenamed("depth", "_near")
    near = F.col("z") <= F.col("_near") * (1 + tolerance) + 1e-4
    return points.join(seen, [*by, "px", "py"]).where(near).drop("_near")


def view_score(facing: Column, x: Column, y: Column, z: Column, width: Column, height: Column) -> Column:
    """How well a camera sees a triangle: facing, away from the border, near."""
    border = F.least(F.least(x, width - x) / width, F.least(y, height - y) / height)
    return facing * clamp(border * 8, 0.05, 1.0) / F.greatest(z * z, F.lit(1e-4))


def best_views(scored: DataFrame, triangle: str, camera: str, score: str, k: int = 4) -> DataFrame:
    """The ``k`` best cameras of each triangle; the smaller camera on ties."""
    return top_per_group(scored, [triangle], [F.col(score).desc(), F.col(camera).asc()], k)


def exposure_gains(samples: DataFrame, camera: str, luminance: str, most: float) -> DataFrame:
    """``(camera, gain)``: brings each camera's median log luminance to the median of these medians.

    Luminance is raised to 1e-5 first; nulls are left out, and a camera without
    samples has no row. Gains stay in [1 / most, most].
    """
    logs = samples.where(F.col(luminance).isNotNull()).select(camera, F.log(F.greatest(F.col(luminance), F.lit(1e-5))).alias("_l"))
    medians = quantile.ranked(logs, [camera], "_l", 0.5, "upper_median", "_m")
    target = quantile.ranked(medians.withColumn("_all", F.lit(0)), ["_all"], "_m", 0.5, "upper_median", "_t").select("_t")
    gain = clamp(F.exp(F.col("_t") - F.col("_m")), 1 / most, most)
    return medians.crossJoin(F.broadcast(target)).select(camera, gain.alias("gain"))


def blended(samples: DataFrame, by: list[str], colours: list[str], gain: str, score: str) -> DataFrame:
    """Each texel's colours weighted by score, after gain, in [0, 1]; texels whose weight isn't positive are left out."""
    sums = samples.groupBy(*by).agg(*(F.sum(F.col(c) * F.col(gain) * F.col(score)).alias(c) for c in colours), F.sum(score).alias("_w"))
    return sums.where("_w > 0").select(*by, *(clamp(F.col(c) / F.col("_w"), 0.0, 1.0).alias(c) for c in colours))


def atlas(triangles: int, size: int, gutter: int, least: int | None = 2) -> tuple[int, int, int]:
    """Columns, cell and usable pixels of a square atlas; raises if cells have fewer than ``least`` usable pixels a side.

    Without ``least`` the layout comes out however small its cells are, down to
    none: pixels then say themselves whether there is room.
    """
    if triangles < 1:
        raise ValueError("an atlas needs a triangle")
    columns = math.isqrt(triangles - 1) + 1
    rows = -(-triangles // columns)
    cell = min(size // columns, size // rows)
    if least is not None and cell - 2 * gutter < least:
        raise ValueError(f"{triangles} triangles don't fit an atlas of {size} pixels")
    return columns, cell, cell - 2 * gutter


def atlas_cells(df: DataFrame, ordinal: str, triangles: int, size: int, gutter: int, least: int | None = 2) -> DataFrame:
    """The first pixel ``tile_x, tile_y`` of each triangle's cell, behind its gutter, and the cell's usable pixels.

    ``least`` as in ``atlas``; without it, no triangles give no rows.
    """
    columns, cell, inner = atlas(triangles if least is not None else max(triangles, 1), size, gutter, least)
    n = F.col(ordinal)
    down = F.floor(n / columns)
    return df.withColumn("tile_x", F.pmod(n, F.lit(columns)) * cell + gutter).withColumn("tile_y", down * cell + gutter).withColumn("inner", F.lit(inner))
