"""Overlap with a grid: tiles, cells of a light grid, cells of a voxel and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span(low: Column, high: Column, cells: int, size: float) -> Column:
    """The cells of a line that [low, high] touches; none if it lies outside."""
    a = F.greatest(F.lit(0), F.floor(low / size)).cast("int")
    b = F.least(F.lit(cells - 1), F.floor(high / size)).cast("int")
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def tiles(df: DataFrame, x: Column, y: Column, radius: Column, columns: int, rows: int, size: float) -> DataFrame:
    """A row for each tile that a disc's box touches: ``tile = row * columns + column``."""
    wide = df.withColumn("_tx", F.explode(span(x - radius, x + radius, columns, size)))
    tall = wide.withColumn("_ty", F.explode(span(y - radius, y + radius, rows, size)))
    return tall.withColumn("tile", F.col("_ty") * columns + F.col("_tx")).drop("_tx", "_ty")


def clusters(df: DataFrame, boxes: list[tuple[Column, Column]], cells: tuple[int, int, int]) -> DataFrame:
    """A row for each cell of a 3-D grid that a box, in units of cells, touches: ``cluster = (z * rows + y) * columns + x``."""
    out = df
    for name, (low, high), n in zip("xyz", boxes, cells, strict=True):
        out = out.withColumn(f"_c{name}", F.explode(span(low, high, n, 1.0)))
    cluster = (F.col("_cz") * cells[1] + F.col("_cy")) * cells[0] + F.col("_cx")
    return out.withColumn("cluster", cluster).drop("_cx", "_cy", "_cz")


def lists_by_cell(df: DataFrame, cell: str, item: str) -> DataFrame:
    """``(cell, items)``: each cell's items in ascending order."""
    return df.groupBy(cell).agg(F.sort_array(F.collect_list(item)).alias("items"))


def order_in_tiles(df: DataFrame, tile: str, order: list[str], out: str = "place") -> DataFrame:
    """Rows numbered from 1 front to back in each tile: one shuffle by tile, one sort."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(tile).orderBy(*order)))


def corner_cells(df: DataFrame, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """A row for each of the eight cells that a grid point is a corner of, with ``corner`` from 0 to 7 (x lowest bit)."""
    corners = F.array(*(F.struct(F.lit(k).alias("corner"), *(F.lit((k >> a) & 1).alias(f"d{a}") for a in range(3))) for k in range(8)))
    out = df.withColumn("_k", F.explode(corners))
    for a, axis in enumerate(axes):
        out = out.withColumn(f"c{axis}", F.col(axis) - F.col(f"_k.d{a}"))
    return out.withColumn("corner", F.col("_k.corner")).drop("_k")


def owners(df: DataFrame, axes: tuple[str, str, str] = ("bx", "by", "bz")) -> DataFrame:
    """Blocks whose surface a changed block touches: itself and the seven before it, once each, none below zero."""
    steps = F.array(*(F.struct(*(F.lit((k >> a) & 1).alias(f"d{a}") for a in range(3))) for k in range(8)))
    out = df.select(*axes).withColumn("_k", F.explode(steps))
    moved = out.select(*((F.col(axis) - F.col(f"_k.d{a}")).alias(axis) for a, axis in enumerate(axes)))
    return moved.where(" and ".join(f"{axis} >= 0" for axis in axes)).distinct()


def cluster_of(x: Column, y: Column, depth: Column, size: tuple[int, int], range_: tuple[float, float], cells: tuple[int, int, int]) -> Column:
    """The cell of a grid over the image and the logarithm of depth in which a pixel lies."""
    part = F.log(depth / range_[0]) / F.log(F.lit(range_[1] / range_[0]))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), part))

    def cell(value: Column, n: int) -> Column:
        return F.least(F.lit(n - 1), F.floor(value * n).cast("int"))

    return (cell(inside, cells[2]) * cells[1] + cell(y / size[1], cells[1])) * cells[0] + cell(x / size[0], cells[0])


def lit_by(pixels: DataFrame, lights: DataFrame, cluster: str) -> DataFrame:
    """Each pixel with the lights of its cluster: an equi join on the cluster's number."""
    return pixels.join(lights, cluster)


def picked(ids: DataFrame, x: int, y: int, identity: str, depth: str) -> DataFrame:
    """``(x, y, identity)``: the nearest thing at a pixel, the smaller id on ties; no row where nothing is."""
    at = ids.where((F.col("x") == x) & (F.col("y") == y))
    return at.groupBy("x", "y").agg(F.min(F.struct(depth, identity))[identity].alias(identity))


def far_to_near(df: DataFrame, by: list[str], at: tuple[Column, Column, Column], eye: tuple[float, float, float], ordinal: str) -> DataFrame:
    """Adds ``place``, from 1, in each group's order by squared distance from ``eye``, the farthest first, then by ``ordinal``."""
    away = [c - e for c, e in zip(at, eye, strict=True)]
    d = away[0] * away[0] + away[1] * away[1] + away[2] * away[2]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(d.desc(), ordinal)))


def digit_counts(df: DataFrame, key: str, place: int, bits: int = 4) -> DataFrame:
    """``(digit, n)``: how many keys have each digit at a place, digits being ``bits`` wide; counted before the shuffle."""
    digit = F.shiftright(F.col(key).cast("long"), place * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return df.groupBy(digit.alias("digit")).agg(F.count("*").alias("n"))
