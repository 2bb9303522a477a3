"""Meshes as rows: corners of triangles, joined parts, tangents, morphs and skins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.geometry import Vec, cross, dot


def corners(triangles: DataFrame, vertices: DataFrame, identity: str, vertex: str, fields: list[str]) -> DataFrame:
    """``(identity, code, fields0 .. fields2)``: each triangle ``(identity, a, b, c)`` with its three vertices' fields.

    The corners are exploded, joined once by key, and put side by side again;
    ``code`` marks triangles that name a vertex which is not there.
    """
    each = triangles.select(identity, F.posexplode(F.array("a", "b", "c")).alias("_k", vertex))
    met = each.join(vertices.select(vertex, F.struct(*fields).alias("_f")), vertex, "left").groupBy(identity)
    side = met.agg(*(F.max(F.when(F.col("_k") == k, F.col("_f"))).alias(f"_f{k}") for k in range(3)))
    code = F.when(F.col("_f0").isNull() | F.col("_f1").isNull() | F.col("_f2").isNull(), "no-vertex")
    return side.select(identity, code.alias("code"), *(F.col(f"_f{k}")[f].alias(f"{f}{k}") for k in range(3) for f in fields))


def joined(vertices: DataFrame, triangles: DataFrame, part: str, vertex: str) -> tuple[DataFrame, DataFrame]:
    """The parts' vertices and triangles as one mesh: numbers of vertices go on from part to part.

    Vertices are numbered from 0 within a part. A part's first number is the count
    of all vertices of the parts before it: a running sum over a row a part.
    """
    counts = vertices.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    moved = triangles.join(base, part)
    return (
        vertices.join(base, part).withColumn(vertex, (F.col(vertex) + F.col("_base")).cast("long")).drop("_base"),
        moved.select(*((F.col(c) + F.col("_base")).cast("long").alias(c) if c in "abc" else F.col(c) for c in triangles.columns)),
    )


def tangents(faces: DataFrame, normals: DataFrame, vertex: str) -> DataFrame:
    """``(vertex, tx, ty, tz, hand)`` from triangles of ``corners`` with ``x, y, z, u, v`` and normals ``(vertex, nx, ny, nz)``.

    ``faces`` also has the corners' numbers ``a, b, c``. Directions of u and v are
    summed over a vertex' triangles; the tangent is what of that of u is at right
    angles to the normal. Triangles without area in u and v add nothing, and a
    vertex without a direction gets one at right angles to its normal.
    """
    def c(name: str, k: int) -> Column:
        return F.col(f"{name}{k}").cast("double")

    e, f = (tuple(c(a, k) - c(a, 0) for a in "xyz") for k in (1, 2))
    u1, v1, u2, v2 = c("u", 1) - c("u", 0), c("v", 1) - c("v", 0), c("u", 2) - c("u", 0), c("v", 2) - c("v", 0)
    area = u1 * v2 - v1 * u2
    along = [(e[k] * v2 - f[k] * v1) / area for k in range(3)]
    beside = [(f[k] * u1 - e[k] * u2) / area for k in range(3)]
    usable = faces.where(F.abs(area) > 1e-12)
    each = usable.select(F.explode(F.array("a", "b", "c")).alias(vertex), *(x.alias(f"_t{k}") for k, x in enumerate(along)), *(x.alias(f"_b{k}") for k, x in enumerate(beside)))
    sums = each.groupBy(vertex).agg(*(F.sum(f"_{n}{k}").alias(f"_{n}{k}") for n in "tb" for k in range(3)))
    zero = F.lit(0.0)
    met = normals.join(sums, vertex, "left")
    n: Vec = tuple(F.col(f"n{a}").cast("double") for a in "xyz")
    t, b = (tuple(F.coalesce(f"_{s}{k}", zero) for k in range(3)) for s in "tb")
    flat = tuple(x - y * dot(n, t) for x, y in zip(t, n, strict=True))
    own = dot(flat, flat)
    up = F.abs(n[1]) < 0.999
    axis: Vec = (F.when(up, 0.0).otherwise(1.0), F.when(up, 1.0).otherwise(0.0), zero)
    other = cross(axis, n)
    wide = F.sqrt(dot(other, other))
    out = tuple(F.when(own > 1e-12, x / F.sqrt(own)).otherwise(y / wide) for x, y in zip(flat, other, strict=True))
    hand = F.when(dot(cross(n, out), b) < 0, -1.0).otherwise(1.0)
    return met.select(vertex, *(x.alias(f"t{a}") for x, a in zip(out, "xyz", strict=True)), hand.alias("hand"))


def morphed(vertices: DataFrame, deltas: DataFrame, weights: DataFrame, vertex: str) -> DataFrame:
    """``vertices (vertex, x, y, z)`` moved by ``deltas (vertex, target, dx, dy, dz)`` times ``weights (target, weight)``."""
    sums = deltas.join(weights, "target").groupBy(vertex).agg(*(F.sum(F.col(f"d{a}") * F.col("weight")).alias(f"_d{a}") for a in "xyz"))
    return vertices.join(sums, vertex, "left").select(vertex, *((F.col(a) + F.coalesce(f"_d{a}", F.lit(0.0))).alias(a) for a in "xyz"))


def skinned(vertices: DataFrame, influences: DataFrame, joints: DataFrame, vertex: str) -> DataFrame:
    """``vertices (vertex, x, y, z)`` moved by the weighted sum of their joints' matrices.

    ``influences (vertex, joint, weight)``; ``joints (joint, m)`` with 16 numbers,
    column by column; a joint beyond the last is the last. Vertices without an
    influence stay where they are.
    """
    last = joints.agg(F.max("joint").alias("_last"))
    held = influences.crossJoin(F.broadcast(last)).withColumn("joint", F.least("joint", "_last")).join(joints, "joint")
    sums = held.groupBy(vertex).agg(*(F.sum(F.get("m", F.lit(k)) * F.col("weight")).alias(f"_m{k}") for k in range(16)))
    met = vertices.join(sums, vertex, "left")

    def moved(r: int) -> Column:
        x = F.col(f"_m{r}") * F.col("x") + F.col(f"_m{4 + r}") * F.col("y") + F.col(f"_m{8 + r}") * F.col("z") + F.col(f"_m{12 + r}")
        return F.coalesce(x, F.col("xyz"[r]))

    return met.select(vertex, *(moved(r).alias(a) for r, a in enumerate("xyz")))


def in_world(vertices: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``vertices (.., x, y, z, nx, ny, nz)`` moved by a 4 x 4 matrix, the normals by its inverse turned over, of length one."""
    turn = np.linalg.inv(np.asarray(matrix, float)[:3, :3]).T

    def sums(rows: np.ndarray, fields: str, last: bool) -> list[Column]:
        return [sum((float(rows[r][k]) * F.col(f) for k, f in enumerate(fields.split())), F.lit(float(rows[r][3]) if last else 0.0)) for r in range(3)]

    places, normals = sums(np.asarray(matrix, float), "x y z", True), sums(turn, "nx ny nz", False)
    moved = vertices.select(*(c for c in vertices.columns if c not in "x y z nx ny nz".split()), *(p.alias(a) for p, a in zip(places, "xyz", strict=True)), *(n.alias(f"n{a}") for n, a in zip(normals, "xyz", strict=True)))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return moved.withColumn("_l", F.nullif(size, F.lit(0.0))).withColumns({f"n{a}": F.col(f"n{a}") / F.col("_l") for a in "xyz"}).drop("_l")


def wound(triangles: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``triangles (.., a, b, c)`` with two corners exchanged if the matrix mirrors, so that they face as before."""
    if np.linalg.det(np.asarray(matrix, float)[:3, :3]) >= 0:
        return triangles
    return triangles.withColumns({"b": F.col("c"), "c": F.col("b")})


def byte_colour(x: Column) -> Column:
    """A colour in [0, 1] as a whole number from 0 to 255; NaN and null are 0."""
    clean = F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), clean)) * 255 + 0.5).cast("int")
