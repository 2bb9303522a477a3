"""Gaussian splats as columns: projected covariance and view-dependent colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.geometry import Quat, Vec, dot, length, matrix_of

# Constants of the real spherical harmonics of degree 0 to 3.
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def covariance(q: Quat, scale: Vec) -> tuple[Vec, Vec, Vec]:
    """R diag(s^2) R^T of a unit quaternion and three standard deviations."""
    r = matrix_of(q)
    scaled = [tuple(row[k] * scale[k] for k in range(3)) for row in r]
    return tuple(tuple(dot(a, b) for b in scaled) for a in scaled)


def projected_covariance(cov: tuple[Vec, Vec, Vec], view: tuple[Vec, Vec, Vec], at: Vec, fx: Column, fy: Column, blur: float = 0.3) -> tuple[Column, Column, Column]:
    """Entries xx, xy, yy on the image of a covariance seen at camera coordinates ``at``; null at or behind the camera."""
    z = F.when(at[2] > 1e-8, at[2])
    rows = []
    for f, p, axis in ((fx, at[0], 0), (fy, at[1], 1)):
        rows.append(tuple(f / z * view[axis][k] - f * p / (z * z) * view[2][k] for k in range(3)))
    through = [tuple(dot(r, tuple(cov[k][c] for k in range(3))) for c in range(3)) for r in rows]
    return dot(through[0], rows[0]) + blur, dot(through[0], rows[1]), dot(through[1], rows[1]) + blur


def radius(xx: Column, xy: Column, yy: Column) -> Column:
    """Three standard deviations along the longest axis of an ellipse."""
    middle = (xx + yy) / 2
    return 3 * F.sqrt(middle + F.sqrt(F.greatest(F.lit(0.0), middle * middle - (xx * yy - xy * xy))))


def basis(direction: Vec, degree: int) -> list[Column]:
    """Spherical harmonics of a direction, which need not have length 1: 1, 4, 9 or 16 of them."""
    n = F.nullif(length(direction), F.lit(0.0))
    x, y, z = (c / n for c in direction)
    out = [F.lit(SH0)]
    if degree > 0:
        out += [-SH1 * y, SH1 * z, -SH1 * x]
    if degree > 1:
        out += [SH2[0] * x * y, SH2[1] * y * z, SH2[2] * (2 * z * z - x * x - y * y), SH2[3] * x * z, SH2[4] * (x * x - y * y)]
    if degree > 2:
        out += [
            SH3[0] * y * (3 * x * x - y * y),
            SH3[1] * x * y * z,
            SH3[2] * y * (4 * z * z - x * x - y * y),
            SH3[3] * z * (2 * z * z - 3 * x * x - 3 * y * y),
            SH3[4] * x * (4 * z * z - x * x - y * y),
            SH3[5] * z * (x * x - y * y),
            SH3[6] * x * (x * x - 3 * y * y),
        ]
    return out


def colour(coefficients: list[Column], direction: Vec, degree: int) -> Column:
    """One channel: the coefficients over the basis, raised by a half, not below 0."""
    terms = basis(direction, degree)
    if len(coefficients) != len(terms):
        raise ValueError(f"degree {degree} has {len(terms)} coefficients")
    return F.greatest(F.lit(0.0), dot(tuple(coefficients), tuple(terms)) + 0.5)
