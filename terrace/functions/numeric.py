"""Guards for numbers: Spark raises where native code yields NaN, and orders NaN above infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, and once in the plan, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def nearest_cell(x: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return F.round(x).cast("long")


def grid_cell(x: Column, size: float, origin: float = 0.0) -> Column:
    """The cell of a regular grid: rounded down, also below the origin."""
    return F.floor((x - F.lit(origin)) / F.lit(size))


def safe_arccos(x: Column) -> Column:
    return F.acos(clamp(x, -1.0, 1.0))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def array_dot(x: Column, y: Column) -> Column:
    return array_sum(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def pearson_distance(x: Column, y: Column, n: int) -> Column:
    """Half of one less the correlation of two arrays of ``n`` numbers; 1 if either is constant."""
    sx, sy = array_sum(F.transform(x, lambda v: v.cast("double"))), array_sum(F.transform(y, lambda v: v.cast("double")))
    vx = array_dot(x, x) - sx * sx / n
    vy = array_dot(y, y) - sy * sy / n
    cov = array_dot(x, y) - sx * sy / n
    return F.when((vx <= 1e-12) | (vy <= 1e-12), F.lit(1.0)).otherwise(0.5 * (1 - clamp(cov / F.sqrt(vx * vy), -1.0, 1.0)))


def id_colour(x: Column) -> Column:
    """A 32-bit mix of an id, for telling ids apart by colour: multiply, xor and shift modulo 2**32."""
    mask = F.lit(0xFFFFFFFF)
    x = (x * 747796405 + 2891336453).bitwiseAND(mask)
    y = F.shiftright(x, 16).bitwiseXOR(x)
    y = (y * 277803737).bitwiseAND(mask)
    return F.shiftright(y, 13).bitwiseXOR(y)


def radical_inverse(i: Column, base: int = 2, digits: int = 20) -> Column:
    """The digits of ``i`` mirrored at the point: a low-discrepancy sequence in [0, 1)."""
    out, left, scale = F.lit(0.0), i, 1.0
    for _ in range(digits):
        scale /= base
        out = out + F.pmod(left, F.lit(base)) * scale
        left = F.floor(left / base)
    return out


def safe_path(path: Column) -> Column:
    """Relative, in normal form and without a step upwards."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~bad
