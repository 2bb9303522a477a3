"""Voxel fields: down-sampling, bounds, fusion and surfaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import quantile
from terrace.functions.numeric import finite
from terrace.operators.tiles import corner_cells, owners


def downsampled(df: DataFrame, axes: list[str], size: float, values: list[str]) -> DataFrame:
    """A row per occupied cell: its key, the number of points, and the means of ``values``."""
    keys = [F.floor(F.col(a) / size).alias(f"c{a}") for a in axes]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))


def bounds(df: DataFrame, axes: list[str], pad: float, least: float, most_cells: int, low: float = 0.005, high: float = 0.995) -> dict[str, float | list[float]]:
    """Origin, voxel size, truncation and cells of a volume around most of the points, from quantiles per axis.

    One row per axis comes to the driver. Raises with fewer than eight points.
    """
    clean = df.where(" and ".join(f"{a} is not null" for a in axes))
    for a in axes:
        clean = clean.where(finite(F.col(a)))
    if clean.limit(8).count() < 8:
        raise ValueError("at least eight points are needed")
    ends = []
    for a in axes:
        lo = quantile.ranked(clean, [], a, low, "truncated", "q").first()["q"]
        hi = quantile.ranked(clean, [], a, high, "truncated", "q").first()["q"]
        ends.append((lo - pad, hi + pad))
    voxel = max(least, max(h - lo for lo, h in ends) / (most_cells - 1))
    return {
        "origin": [lo for lo, _ in ends],
        "voxel": voxel,
        "truncation": max(4 * voxel, 0.04),
        "cells": [int(np.ceil((h - lo) / voxel)) + 1 for lo, h in ends],
    }


def admitted(depth: Column, confidence: Column, least: float, most: float, floor: float) -> Column:
    """Whether a depth pixel takes part in fusion."""
    return finite(depth) & depth.between(least, most) & (confidence >= floor) & (confidence > 0)


def truncated(signed: Column, truncation: float) -> Column:
    """A signed distance in units of the truncation, at most 1; null where far behind the surface."""
    return F.when(signed >= -truncation, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), signed / truncation)))


def ray_cells(pixels: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), size: float = 1.0, around: int = 0, cells: tuple[int, ...] | None = None) -> DataFrame:
    """``(ray, cx, cy, cz)``: grid cells that segments ``(ray, ox.., ex..)`` pass, each once a ray.

    A segment is cut where it crosses a plane of the grid, planes that it crosses
    at once (to 12 places of its length) being one cut; each part lies in the cell
    of its middle, and the cells of both ends count too. ``around`` adds the cells
    so many steps away along any axis, ``cells`` leaves out those outside a grid
    that begins at 0. Segments that aren't finite have no cells.
    """
    ends = {f"{p}{a}": F.col(f"{p}{a}").cast("double") / size for p in "oe" for a in axes}
    rows = pixels.select("ray", *(v.alias(k) for k, v in ends.items()))
    for name in ends:
        rows = rows.where(finite(F.col(name)))

    def crossings(a: str) -> Column:
        o, e = F.col(f"o{a}"), F.col(f"e{a}")
        low, high = F.floor(F.least(o, e)) + 1, F.ceil(F.greatest(o, e)) - 1
        planes = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(planes, lambda p: F.round((p - o) / (e - o), 12))

    cuts = F.concat(F.array(F.lit(0.0), F.lit(1.0)), *(crossings(a) for a in axes))
    rows = rows.withColumn("_t", F.array_sort(F.array_distinct(cuts)))

    def cell(t: Column) -> Column:
        return F.struct(*(F.floor(F.col(f"o{a}") + (F.col(f"e{a}") - F.col(f"o{a}")) * t).alias(f"c{a}") for a in axes))

    middles = F.transform(F.slice("_t", 2, F.size("_t") - 1), lambda t, i: cell((t + F.get("_t", i)) / 2))
    tips = [F.struct(*(F.floor(F.col(f"{p}{a}")).alias(f"c{a}") for a in axes)) for p in "oe"]
    out = rows.select("ray", F.explode(F.array_distinct(F.concat(F.array(tips[0]), middles, F.array(tips[1])))).alias("_c")).select("ray", "_c.*")
    if around:
        for a in axes:
            out = out.select("*", F.explode(F.sequence(F.lit(-around), F.lit(around))).alias("_d")).withColumn(f"c{a}", F.col(f"c{a}") + F.col("_d")).drop("_d")
        out = out.distinct()
    for a, n in zip(axes, cells or (), strict=False):
        out = out.where(F.col(f"c{a}").between(0, n - 1))
    return out


#: Edges of a cell by the corners they join (x lowest bit), and its faces by their corners, anticlockwise from outside.
EDGES = tuple((c, c | 1 << a) for a in range(3) for c in range(8) if not c >> a & 1)
FACES = tuple(
    tuple(c | high << a for c in ((0, u, u | v, v) if high else (0, v, u | v, u)))
    for a, u, v in ((a, 1 << (a + 1) % 3, 1 << (a + 2) % 3) for a in range(3))
    for high in (0, 1)
)


def _crossings(case: int, ring: tuple[int, ...]) -> list[int]:
    """Sides of a face, by the place of their first corner, of which one end is inside."""
    return [k for k in range(4) if (case >> ring[k] ^ case >> ring[(k + 1) % 4]) & 1]


def cell_loops(case: int, joined: int = 0) -> list[list[int]]:
    """Loops of edge numbers in which the surface leaves a cell whose corners of ``case`` are inside.

    Going around a face, each side that leads inside is tied to the next one
    that leads out again. Where a face has two of each, that parts its inside
    corners; faces of ``joined`` tie it to the one before instead, which parts
    the outside corners. Every edge lies on two faces that pass it in opposite
    directions, so each gets one successor, and loops turn towards the outside.
    """
    after = {}
    for f, ring in enumerate(FACES):
        sides = _crossings(case, ring)
        edge = [EDGES.index(tuple(sorted((ring[k], ring[(k + 1) % 4])))) for k in sides]
        for i, k in enumerate(sides):
            if not case >> ring[k] & 1:
                after[edge[i]] = edge[i - 1 if joined >> f & 1 else (i + 1) % len(sides)]
    loops = []
    while after:
        loop = [min(after)]
        while loop[-1] in after:
            loop.append(after.pop(loop[-1]))
        loops.append(loop[:-1])
    return loops


def cell_table() -> list[tuple[int, list]]:
    """``(case + 256 * joined, loops)`` for all cases and all choices on their ambiguous faces.

    An edge comes as its corners, the offset of the lower one, and its direction.
    """
    shape = [(p, q, *(p >> a & 1 for a in range(3)), *((p ^ q) >> a & 1 for a in range(3))) for p, q in EDGES]
    out = []
    for case in range(1, 255):
        choices = [0]
        for f, ring in enumerate(FACES):
            if len(_crossings(case, ring)) == 4:
                choices += [c | 1 << f for c in choices]
        out += [(case + 256 * c, [[shape[e] for e in loop] for loop in cell_loops(case, c)]) for c in choices]
    return out


def surface(field: DataFrame, origin: tuple[float, float, float], size: float, resolved: bool = True) -> DataFrame:
    """Triangles ``(cell, k, ids, points)`` of the zero level of ``(x, y, z, distance)`` at integer grid points.

    Only cells all of whose eight corners are there, with finite distances, have
    a surface; of points that come twice the larger distance counts. The signs of
    a cell's corners, and the sign of the mean on faces where they alternate, look
    up its loops in a table that a rule makes and whose size is fixed. Cells agree
    on their common face, so the surface has no cracks.

    ``resolved`` puts a vertex at the mean of each loop and fans from it. Without
    it, alternating faces part their inside corners whatever the mean, and loops
    are fanned from their first vertex: the table of 256 cases. ``ids`` name the
    vertices by the grid edge they lie on, equal in all cells that share it, or by
    cell and loop; ``points`` are their coordinates. Triangles turn towards
    positive distance.
    """
    distance = F.col("distance").cast("double")
    corners = corner_cells(field.select("x", "y", "z", distance.alias("distance")).where(finite(F.col("distance"))))
    v = [F.col(f"v{k}") for k in range(8)]
    cells = corners.groupBy("cx", "cy", "cz").agg(*(F.max(F.when(F.col("corner") == k, F.col("distance"))).alias(f"v{k}") for k in range(8)))
    whole = cells.dropna(subset=[f"v{k}" for k in range(8)])
    key = sum((F.when(v[k] < 0, 1 << k).otherwise(0) for k in range(8)), F.lit(0))
    if resolved:
        for f, (a, b, c, d) in enumerate(FACES):
            in_a, in_b = v[a] < 0, v[b] < 0
            alternating = (in_a == (v[c] < 0)) & (in_b == (v[d] < 0)) & (in_a != in_b)
            key = key + F.when(alternating & (v[a] + v[b] + v[c] + v[d] < 0), 256 << f).otherwise(0)
    crossed = whole.where((F.least(*v) < 0) & (F.greatest(*v) >= 0)).select("cx", "cy", "cz", F.array(*v).alias("v"), key.alias("key"))
    edge = "struct<p:int,q:int,x:int,y:int,z:int,dx:int,dy:int,dz:int>"
    table = F.broadcast(field.sparkSession.createDataFrame(cell_table(), f"key int, loops array<array<{edge}>>"))
    loops = crossed.join(table, "key").select("cx", "cy", "cz", "v", F.posexplode("loops").alias("loop", "edges"))

    def vertex(e: Column) -> Column:
        near, far = F.get("v", e["p"]), F.get("v", e["q"])
        t = near / (near - far)
        low = [F.col(f"c{a}") + e[a] for a in "xyz"]
        ends = [*low, *(at + e[f"d{a}"] for at, a in zip(low, "xyz", strict=True))]
        place = [F.lit(float(o)) + size * (at + t * e[f"d{a}"]) for o, at, a in zip(origin, low, "xyz", strict=True)]
        return F.struct(F.concat_ws(",", *(x.cast("string") for x in ends)).alias("id"), F.array(*place).alias("at"))

    cell = F.concat_ws(",", *(F.col(f"c{a}").cast("string") for a in "xyz"))
    rings = loops.select(cell.alias("cell"), "loop", F.transform("edges", vertex).alias("ring"))
    n = F.size("ring")
    fans = rings.select("*", F.explode(F.sequence(F.lit(0), n - 1) if resolved else F.sequence(F.lit(1), n - 2)).alias("i"))

    def mean(a: int) -> Column:
        return F.aggregate("ring", F.lit(0.0), lambda total, r: total + r["at"][a]) / n

    centre = F.struct(F.concat_ws(":", "cell", F.col("loop").cast("string")).alias("id"), F.array(*(mean(a) for a in range(3))).alias("at"))
    corners = [centre if resolved else F.get("ring", F.lit(0)), F.get("ring", F.col("i")), F.get("ring", (F.col("i") + 1) % n)]
    return fans.select(
        "cell", (F.col("loop") * len(EDGES) + F.col("i")).alias("k"), F.array(*(c["id"] for c in corners)).alias("ids"), F.concat(*(c["at"] for c in corners)).alias("points")
    )


def welded(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vertices (id, x, y, z), triangles (a, b, c))``: one vertex per grid edge, faces that collapse left out."""
    at = triangles.select(F.posexplode("ids").alias("i", "id"), "points")
    xyz = [F.col("points")[3 * F.col("i") + k].alias(a) for k, a in enumerate("xyz")]
    vertices = at.select("id", *xyz).groupBy("id").agg(*(F.first(a).alias(a) for a in "xyz"))
    faces = triangles.select(*(F.col("ids")[k].alias(n) for k, n in enumerate("abc"))).where("a <> b and b <> c and a <> c")
    return vertices, faces


def remeshed(field: DataFrame, patches: DataFrame, dirty: DataFrame, block: int, origin: tuple[float, float, float], size: float) -> DataFrame:
    """``patches`` (triangles with their block ``bx, by, bz``) after the blocks ``dirty`` of ``field`` have changed.

    A cell belongs to the block of its lowest corner and looks one point beyond
    it, so the owners of a change are its block and the seven before; their
    patches are made anew from these blocks and a halo of one point, all others
    stay as they are.
    """
    keys = ["bx", "by", "bz"]
    touched = owners(dirty).select(*keys)
    spread = touched
    for key, axis in zip(keys, "xyz", strict=True):
        steps = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("_d")
        spread = spread.select("*", steps).withColumn(key, F.col(key) + F.col("_d")).drop("_d")
    needed = spread.distinct()
    placed = field.select("*", *(F.floor(F.col(a) / block).alias(k) for a, k in zip("xyz", keys, strict=True)))
    near = placed.join(needed, keys, "left_semi").drop(*keys)
    cell = F.split("cell", ",")
    made = surface(near, origin, size).select(*(F.floor(cell[i].cast("long") / block).alias(k) for i, k in enumerate(keys)), "cell", "k", "ids", "points")
    return patches.join(touched, keys, "left_anti").unionByName(made.join(touched, keys, "left_semi"))


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """``(id, nx, ny, nz)``: unit normals, triangles ``(a, b, c)`` weighing by their area; vertices without area are left out."""
    t = triangles.select("a", "b", "c")
    for corner in "abc":
        at = vertices.select(F.col("id").alias(corner), F.struct("x", "y", "z").alias(f"_{corner}"))
        t = t.join(at, corner)
    u = [F.col(f"_b.{i}") - F.col(f"_a.{i}") for i in "xyz"]
    v = [F.col(f"_c.{i}") - F.col(f"_a.{i}") for i in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    each = t.select(F.explode(F.array("a", "b", "c")).alias("id"), *(x.alias(f"n{i}") for i, x in zip("xyz", n, strict=True)))
    sums = each.groupBy("id").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in "xyz"))
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return sums.withColumn("_l", length).where("_l > 1e-20").select("id", *((F.col(f"n{i}") / F.col("_l")).alias(f"n{i}") for i in "xyz"))
