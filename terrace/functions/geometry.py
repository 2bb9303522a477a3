"""Cameras, quaternions and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.numeric import clamp, let, safe_arccos

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def length(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return length(tuple(x - y for x, y in zip(a, b, strict=True)))


def angle(a: Vec, b: Vec) -> Column:
    """Radians between two vectors; 0 if either has no length."""
    la, lb = length(a), length(b)
    return F.when((la > 0) & (lb > 0), safe_arccos(dot(a, b) / F.nullif(la * lb, F.lit(0.0)))).otherwise(F.lit(0.0))


def multiply(p: Quat, q: Quat) -> Quat:
    return (
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
        p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1],
        p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    )


def conjugate(q: Quat) -> Quat:
    return q[0], -q[1], -q[2], -q[3]


def rotate(q: Quat, v: Vec) -> Vec:
    """A unit quaternion applied to a vector: v + 2w (q x v) + 2 q x (q x v)."""
    axis = (q[1], q[2], q[3])
    once = cross(axis, v)
    twice = cross(axis, once)
    return tuple(v[k] + 2 * q[0] * once[k] + 2 * twice[k] for k in range(3))


def matrix_of(q: Quat) -> tuple[Vec, Vec, Vec]:
    """Rows of the rotation matrix of a unit quaternion."""
    w, x, y, z = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def quaternion_of(m: tuple[Vec, Vec, Vec]) -> Column:
    """``struct<w,x,y,z>`` of a rotation matrix, by its largest component."""
    (a, b, c), (d, e, f), (g, h, i) = m

    def made(w: Column, x: Column, y: Column, z: Column) -> Column:
        return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))

    s0, s1, s2, s3 = (
        2 * F.sqrt(F.greatest(F.lit(0.0), t)) for t in (1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i)
    )
    s0, s1, s2, s3 = (F.nullif(s, F.lit(0.0)) for s in (s0, s1, s2, s3))
    return (
        F.when(a + e + i > 0, made(s0 / 4, (h - f) / s0, (c - g) / s0, (d - b) / s0))
        .when((a > e) & (a > i), made((h - f) / s1, s1 / 4, (b + d) / s1, (c + g) / s1))
        .when(e > i, made((c - g) / s2, (b + d) / s2, s2 / 4, (f + h) / s2))
        .otherwise(made((d - b) / s3, (c + g) / s3, (f + h) / s3, s3 / 4))
    )


def camera_centre(q: Quat, t: Vec) -> Vec:
    """Where a world-to-camera pose has its camera: minus the inverse rotation of t."""
    return tuple(-x for x in rotate(conjugate(q), t))


def orientation_error(p: Quat, q: Quat) -> Column:
    """Degrees between two unit quaternions, whichever sign they have."""
    return F.degrees(2 * F.acos(clamp(F.abs(dot(p, q)), 0.0, 1.0)))


def unproject(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Vec:
    """A pixel at depth z in camera coordinates."""
    return (x - cx) * z / fx, (y - cy) * z / fy, z


def project(v: Vec, fx: Column, fy: Column, cx: Column, cy: Column, k: tuple[float, ...] = (0, 0, 0), p: tuple[float, ...] = (0, 0)) -> tuple[Column, Column]:
    """Image coordinates with radial and tangential distortion; null at or behind the camera."""
    z = F.when(v[2] > 1e-8, v[2])
    x, y = v[0] / z, v[1] / z
    r2 = x * x + y * y
    radial = 1 + k[0] * r2 + k[1] * r2 * r2 + k[2] * r2 * r2 * r2
    xd = x * radial + 2 * p[0] * x * y + p[1] * (r2 + 2 * x * x)
    yd = y * radial + p[0] * (r2 + 2 * y * y) + 2 * p[1] * x * y
    return fx * xd + cx, fy * yd + cy


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def video_to_rgb(y: Column, cb: Column, cr: Column) -> Vec:
    """BT.709 video-range bytes to RGB in [0, 1]."""
    luma, u, v = (y - 16) / 219.0, (cb - 128) / 224.0, (cr - 128) / 224.0
    return tuple(clamp(c, 0.0, 1.0) for c in (luma + 1.5748 * v, luma - 0.1873 * u - 0.4681 * v, luma + 1.8556 * u))


def sigmoid(x: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -limit, limit)))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return length(cross(tuple(x - y for x, y in zip(b, a, strict=True)), tuple(x - y for x, y in zip(c, a, strict=True)))) / 2


def axis_angle_matrix(v: Vec) -> tuple[Vec, Vec, Vec]:
    """Rotation by a vector's length about it; the identity for a length below 1e-12."""
    theta = length(v)
    some = theta >= 1e-12
    n = F.nullif(theta, F.lit(0.0))
    x, y, z = (F.when(some, c / n).otherwise(F.lit(0.0)) for c in v)
    c, s = F.cos(theta), F.sin(theta)
    o = 1 - c
    return (
        (F.when(some, c + x * x * o).otherwise(1.0), x * y * o - z * s, x * z * o + y * s),
        (y * x * o + z * s, F.when(some, c + y * y * o).otherwise(1.0), y * z * o - x * s),
        (z * x * o - y * s, z * y * o + x * s, F.when(some, c + z * z * o).otherwise(1.0)),
    )


def scaled_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, old: tuple[Column, Column], new: tuple[Column, Column]) -> Quat:
    """Focal lengths and centre of a camera whose image is resized from ``old`` (width, height) to ``new``."""
    across, down = new[0] / old[0], new[1] / old[1]
    return fx * across, fy * down, cx * across, cy * down


def millimetres(depth: Column) -> Column:
    """Whole millimetres as metres in 32 bits."""
    return (depth.cast("double") * 0.001).cast("float")


def is_unit(q: tuple[Column, ...], tolerance: float) -> Column:
    """Whether a vector's length is one, within the tolerance; false for nulls and NaN."""
    return F.coalesce(F.abs(length(q) - 1) <= tolerance, F.lit(False))


def is_rotation(rows: tuple[Vec, Vec, Vec], tolerance: float) -> Column:
    """Whether columns have length one and right angles, and keep handedness, each within the tolerance."""
    columns = tuple(zip(*rows, strict=True))
    lengths = [F.abs(dot(c, c) - 1) for c in columns]
    angles = [F.abs(dot(columns[i], columns[k])) for i, k in ((0, 1), (0, 2), (1, 2))]
    hand = F.abs(dot(cross(columns[0], columns[1]), columns[2]) - 1)
    return F.coalesce(F.greatest(*lengths, *angles, hand) <= tolerance, F.lit(False))


def rigid_code(m: Column, tolerance: float = 2e-3) -> Column:
    """What keeps 16 numbers, column by column, from being a rigid pose; null if nothing does."""
    at = [F.get(m, F.lit(k)) for k in range(16)]
    rows = tuple((at[r], at[4 + r], at[8 + r]) for r in range(3))
    affine = F.greatest(*(F.abs(at[k]) for k in (3, 7, 11)), F.abs(at[15] - 1))
    return F.when(F.size(m) != 16, "size").when(~F.coalesce(affine <= tolerance, F.lit(False)), "affine").when(~is_rotation(rows, tolerance), "rotation")


def image_pose(m: Column) -> Column:
    """``struct<w,x,y,z,tx,ty,tz>`` of a pose of 16 numbers, column by column, whose camera looks along -z with y up.

    The result's camera looks along +z with y down, as images do: the second and
    third axes are turned round.
    """
    at = [F.get(m, F.lit(k)) for k in range(16)]
    found = quaternion_of(tuple((at[r], -at[4 + r], -at[8 + r]) for r in range(3)))

    def pose(q: Column) -> Column:
        size = length(tuple(q[k] for k in "wxyz"))
        return F.struct(*((q[k] / size).alias(k) for k in "wxyz"), *(at[12 + k].alias(f"t{a}") for k, a in enumerate("xyz")))

    return let(found, pose)


def placed(t: Vec, q: Quat, s: Vec) -> Column:
    """The 16 numbers, column by column, that scale, then turn by a unit quaternion, then move."""
    rows = matrix_of(q)
    out = [rows[r][c] * s[c] if r < 3 else F.lit(0.0) for c in range(3) for r in range(4)]
    return F.array(*out, *t, F.lit(1.0))


def taken_apart(m: Column, tolerance: float = 1e-4) -> Column:
    """``struct<code, translation, rotation, scale>`` of 16 numbers, column by column.

    ``code`` says what has no such parts: perspective, a scale near 0, shear. A
    mirrored matrix gets its sign on the first scale.
    """
    at = [F.get(m, F.lit(k)) for k in range(16)]
    axes = [tuple(at[4 * c + r] for r in range(3)) for c in range(3)]
    seen = F.greatest(*(F.abs(at[k]) for k in (3, 7, 11)), F.abs(at[15] - 1))
    size = [length(a) for a in axes]
    mirrored = dot(cross(axes[0], axes[1]), axes[2]) < 0
    scales = F.array(F.when(mirrored, -size[0]).otherwise(size[0]), size[1], size[2])

    def turned(scale: Column) -> Column:
        """``struct<scale, unit>``: the axes over their scales, one after the other."""
        parts = [x / F.nullif(F.get(scale, F.lit(c)), F.lit(0.0)) for c in range(3) for x in axes[c]]
        return F.struct(scale.alias("scale"), F.array(*parts).alias("unit"))

    def parts(p: Column) -> Column:
        unit = [tuple(F.get(p["unit"], F.lit(3 * c + r)) for r in range(3)) for c in range(3)]
        skew = F.greatest(*(F.abs(dot(unit[i], unit[k])) for i, k in ((0, 1), (0, 2), (1, 2))))
        least = F.array_min(F.transform(p["scale"], lambda x: F.abs(x)))
        code = F.when(seen > tolerance, "perspective").when(least <= tolerance, "degenerate").when(skew > tolerance, "shear")
        q = quaternion_of(tuple(tuple(unit[c][r] for c in range(3)) for r in range(3)))
        return F.struct(code.alias("code"), p["scale"].alias("scale"), q.alias("q"))

    def named(p: Column) -> Column:
        n = length(tuple(p["q"][k] for k in "wxyz"))
        return F.struct(
            p["code"].alias("code"),
            F.array(at[12], at[13], at[14]).alias("translation"),
            F.when(p["code"].isNull(), F.array(*(p["q"][k] / n for k in "wxyz"))).alias("rotation"),
            F.when(p["code"].isNull(), p["scale"]).alias("scale"),
        )

    return let(let(let(scales, turned), parts), named)


def perspective(field_of_view: Column, aspect: Column, near: Column, far: Column | None = None) -> Column:
    """The 16 numbers, column by column, of a view in which depth falls from 1 near to 0 far; without ``far``, at infinity."""
    up = 1 / F.tan(field_of_view / 2)
    zero, span = F.lit(0.0), None if far is None else far - near
    scale, offset = (zero, near) if far is None else (near / span, near * far / span)
    return F.array(up / aspect, zero, zero, zero, zero, up, zero, zero, zero, zero, scale, F.lit(-1.0), zero, zero, offset, zero)


def orthographic(height: Column, aspect: Column, near: Column, far: Column) -> Column:
    """The same for parallel rays over a view of that height."""
    zero, span = F.lit(0.0), far - near
    return F.array(2 / (height * aspect), zero, zero, zero, zero, 2 / height, zero, zero, zero, zero, 1 / span, zero, zero, zero, far / span, F.lit(1.0))


def slerp(p: Quat, q: Quat, part: Column) -> Quat:
    """The turn ``part`` of the way from one unit quaternion to another, the shorter way round."""
    cosine = dot(p, q)

    def parts(c: Column) -> Column:
        theta = F.acos(clamp(F.abs(c), 0.0, 1.0))
        sign = F.when(c < 0, -1.0).otherwise(1.0)
        straight, sine = F.sin(theta) < 1e-6, F.nullif(F.sin(theta), F.lit(0.0))
        a = F.when(straight, 1 - part).otherwise(F.sin((1 - part) * theta) / sine)
        b = F.when(straight, part).otherwise(F.sin(part * theta) / sine) * sign
        return F.array(*(a * x + b * y for x, y in zip(p, q, strict=True)))

    mixed = let(let(cosine, parts), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, y: t + y * y))))
    return tuple(F.get(mixed, F.lit(k)) for k in range(4))


def jitter_index(frame: Column, cycle: int = 8) -> Column:
    """The place in a low-discrepancy sequence that a frame uses: 1 to ``cycle``, over and over."""
    return F.pmod(frame, F.lit(cycle)) + 1


def cascade_split(k: Column, near: float, far: float, cascades: int, mix: float) -> Column:
    """The far end of the ``k``-th cascade, from 1: part logarithmic, the rest uniform."""
    part = k / F.lit(float(cascades))
    return mix * near * F.pow(F.lit(far / near), part) + (1 - mix) * (near + (far - near) * part)
