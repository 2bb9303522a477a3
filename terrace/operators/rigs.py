"""Cameras, calibrations, poses and what they see: joins in which a missing key is said, not dropped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.geometry import Vec, cross, dot, length
from terrace.functions.numeric import nearest_cell

#: Cameras that go to every task at a time.
CAMERAS = 4096


def matched(matches: DataFrame, cameras: DataFrame, poses: DataFrame, image: str, frame: str) -> DataFrame:
    """Every match with its camera and its pose, and ``code`` where either is missing.

    ``cameras`` has the column ``image``, ``poses`` the column ``frame``, each
    once at most; both are joined by hash, left, so that no match is lost.
    """
    a = cameras.withColumn("_camera", F.lit(True))
    b = poses.withColumn("_pose", F.lit(True))
    both = matches.join(a, image, "left").join(b, frame, "left")
    code = F.when(F.col("_camera").isNull(), "no-camera").when(F.col("_pose").isNull(), "no-pose")
    return both.withColumn("code", code).drop("_camera", "_pose")


def calibrated(rig: DataFrame, calibrations: DataFrame, camera: str, name: str) -> DataFrame:
    """A rig's images with their calibration; ``code`` says what is wrong: a name that comes twice, no calibration."""
    twice = rig.groupBy(name).agg(F.count("*").alias("_n"))
    found = calibrations.withColumn("_found", F.lit(True))
    both = rig.join(twice, name).join(found, camera, "left")
    code = F.when(F.col("_n") > 1, "duplicate").when(F.col("_found").isNull(), "no-calibration")
    return both.withColumn("code", code).drop("_n", "_found")


def checked(df: DataFrame, code: str = "code") -> DataFrame:
    """``df`` without ``code`` if no row has one; the first code is raised as a ValueError."""
    bad = df.where(F.col(code).isNotNull()).select(code).first()
    if bad is not None:
        raise ValueError(f"rows are refused: {bad[0]}")
    return df.drop(code)


def blocks(table: DataFrame, identity: str, most: int = CAMERAS) -> list[DataFrame]:
    """``table`` in parts of about ``most`` rows, by hash of ``identity``: each may go to every task."""
    parts = max(1, math.ceil(table.count() / most))
    if parts == 1:
        return [table]
    return [table.where(F.pmod(F.xxhash64(identity), F.lit(parts)) == k) for k in range(parts)]


def seen(v: Vec, camera: str = "") -> tuple[Column, Column, Column]:
    """Image coordinates and depth of a point for the camera columns ``r0 .. r8, t0 .. t2, fx, fy, cx, cy`` (world to camera)."""
    c = lambda n: F.col(f"{camera}{n}")
    x, y, z = (dot(tuple(c(f"r{3 * k + j}") for j in range(3)), v) + c(f"t{k}") for k in range(3))
    depth = F.when(z > 1e-8, z)
    return c("fx") * x / depth + c("cx"), c("fy") * y / depth + c("cy"), depth


def facing(a: Vec, b: Vec, c: Vec, eye: Vec) -> Column:
    """Cosine between a triangle's normal, either side of it, and the way from its centroid to the eye; 0 without area."""
    normal = cross(tuple(y - x for x, y in zip(a, b, strict=True)), tuple(y - x for x, y in zip(a, c, strict=True)))
    way = tuple(e - (p + q + r) / 3 for e, p, q, r in zip(eye, a, b, c, strict=True))
    return F.coalesce(F.abs(dot(normal, way)) / F.nullif(length(normal) * length(way), F.lit(0.0)), F.lit(0.0))


def candidates(triangles: DataFrame, cameras: DataFrame, identity: str, least_facing: float, margin: float = 0.0) -> DataFrame:
    """``(triangle columns, camera, px, py, z, facing)``: triangles that face a camera and whose centroid lies in its image.

    ``triangles`` has corners ``x0, y0, z0`` to ``x2, y2, z2``, ``cameras`` what
    ``seen`` needs, an eye ``ex, ey, ez`` and ``width, height``. Cameras go to the
    triangles a block at a time, whatever their number. What is hidden is for
    ``bake.visible`` to say, by the camera's depth map.
    """
    p, q, r = ((F.col(f"x{k}"), F.col(f"y{k}"), F.col(f"z{k}")) for k in range(3))
    centre = tuple((a + b + c) / 3 for a, b, c in zip(p, q, r, strict=True))
    out = None
    for part in blocks(cameras, identity):
        named = part.select(F.col(identity).alias("_c_id"), *(F.col(c).alias(f"_c_{c}") for c in part.columns if c != identity))
        x, y, z = seen(centre, "_c_")
        met = triangles.join(F.broadcast(named)).withColumn("px", x).withColumn("py", y).withColumn("z", z)
        met = met.withColumn("facing", facing(p, q, r, tuple(F.col(f"_c_e{a}") for a in "xyz")))
        inside = F.col("px").between(margin, F.col("_c_width") - margin) & F.col("py").between(margin, F.col("_c_height") - margin)
        kept = met.where((F.col("facing") >= least_facing) & inside).select(*triangles.columns, F.col("_c_id").alias(identity), "px", "py", "z", "facing")
        out = kept if out is None else out.unionByName(kept)
    return out


def voxel_pixels(voxels: DataFrame, frames: DataFrame, pixels: DataFrame, frame: str) -> DataFrame:
    """``(voxel columns, frame, px, py, z, pixel columns)``: each voxel with the pixel it falls on in each frame.

    ``voxels`` has ``x, y, z`` of their middles; ``frames`` what ``seen`` needs
    and ``width, height``; ``pixels`` ``(frame, px, py, ..)``. Voxels outside an
    image, behind its camera or on a pixel that is not there have no row for it.
    """
    out = None
    for part in blocks(frames, frame):
        named = part.select(F.col(frame).alias("_c_id"), *(F.col(c).alias(f"_c_{c}") for c in part.columns if c != frame))
        x, y, z = seen((F.col("x"), F.col("y"), F.col("z")), "_c_")
        met = voxels.join(F.broadcast(named)).withColumn("px", nearest_cell(x)).withColumn("py", nearest_cell(y)).withColumn("depth", z)
        inside = (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("_c_width")) & (F.col("py") < F.col("_c_height"))
        kept = met.where(inside).select(*voxels.columns, F.col("_c_id").alias(frame), "px", "py", "depth")
        out = kept if out is None else out.unionByName(kept)
    return out.join(pixels, [frame, "px", "py"])
