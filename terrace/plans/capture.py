"""More queries over the driver's tables: cameras, sampling, meshes, runs and names, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import geometry as g
from terrace.functions import names
from terrace.functions.numeric import radical_inverse
from terrace.operators import images, meshes, ranking, rigs, runs, sampling, tables, temporal, tiles, voxels
from terrace.plans.registry import _SECONDS, query, r6, seconds
from terrace.sources import manifest

_E = "(select vec_id, label, " + ", ".join(f"embedding[{k}]::double as e{k}" for k in range(1, 21)) + " from embeddings)"


def _e(read) -> DataFrame:
    return read("embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"e{k + 1}") for k in range(20)))


def _c(*numbers: int) -> tuple[Column, ...]:
    return tuple(F.col(f"e{k}") for k in numbers)


def _quat(name: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{name}{a}") for a in "wxyz")


def _units(read) -> DataFrame:
    """``_e`` with unit quaternions ``q`` of its numbers 1 to 4 and ``p`` of its numbers 5 to 8."""
    e = _e(read)
    for name, first in (("q", 1), ("p", 5)):
        q = _c(*range(first, first + 4))
        e = e.withColumn("_n", g.length(q)).select("*", *((x / F.col("_n")).alias(f"{name}{a}") for x, a in zip(q, "wxyz", strict=True))).drop("_n")
    return e


def _unit_sql(name: str, *numbers: int) -> str:
    n = "sqrt(" + " + ".join(f"e{k} * e{k}" for k in numbers) + ")"
    return ", ".join(f"e{k} / {n} as {name}{a}" for k, a in zip(numbers, "wxyz", strict=True))


# --- cameras -------------------------------------------------------------------------------------------


@query("select p_partkey, round(p_retailprice * (p_size * 2 / 640), 6) as fx, round(p_retailprice * (p_size / 480), 6) as fy, round(320 * (p_size * 2 / 640), 6) as cx, round(240 * (p_size / 480), 6) as cy from part")
def intrinsic_rescale(read):
    f, size = F.col("p_retailprice"), F.col("p_size")
    made = g.scaled_intrinsics(f, f, F.lit(320.0), F.lit(240.0), (F.lit(640), F.lit(480)), (size * 2, size))
    return read("part").select("p_partkey", *(r6(x, n) for x, n in zip(made, ("fx", "fy", "cx", "cy"), strict=True)))


@query("select l_orderkey, l_linenumber, round(((l_partkey % 65536) * 0.001::double)::float::double, 6) as metres from lineitem")
def depth_millimetres(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", F.round(g.millimetres(F.col("l_partkey") % 65536).cast("double"), 6).alias("metres"))


@query(f"""
select vec_id, case when z > 1e-8 then round(500 * ((x / z) * r + 2 * 0.001 * (x / z) * (y / z) + 0.002 * (r2 + 2 * (x / z) * (x / z))) + 320, 4) end as px,
  case when z > 1e-8 then round(510 * ((y / z) * r + 0.001 * (r2 + 2 * (y / z) * (y / z)) + 2 * 0.002 * (x / z) * (y / z)) + 240, 4) end as py
from (select *, 1 + 0.1 * r2 - 0.05 * r2 * r2 + 0.01 * r2 * r2 * r2 as r from (select *, (x / z) * (x / z) + (y / z) * (y / z) as r2 from (
  select vec_id, e1 as x, e2 as y, abs(e3) + case when label = 0 then -1 else 2 end as z from {_E})))""")
def distorted_project(read):
    z = F.abs(F.col("e3")) + F.when(F.col("label") == 0, -1).otherwise(2)
    px, py = g.project((*_c(1, 2), z), F.lit(500), F.lit(510), F.lit(320), F.lit(240), (0.1, -0.05, 0.01), (0.001, 0.002))
    return _e(read).select("vec_id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


_ROTATED = """(1 - 2 * (qy * qy + qz * qz)) * e5 + 2 * (qx * qy - qw * qz) * e6 + 2 * (qx * qz + qw * qy) * e7"""


@query(f"select vec_id, round({_ROTATED}, 6) as x, round(sqrt(e5 * e5 + e6 * e6 + e7 * e7), 6) as size, 1.0::double as turns from (select *, {_unit_sql('q', 1, 2, 3, 4)} from {_E})")
def quaternion_rotate(read):
    """A vector turned by a quaternion, its length kept, and the quaternion found again from its matrix."""
    q, v = _quat("q"), _c(5, 6, 7)
    turned = g.rotate(q, v)
    again = g.quaternion_of(g.matrix_of(q))
    same = F.abs(g.dot(q, tuple(again[k] for k in "wxyz")))
    return _units(read).select("vec_id", r6(turned[0], "x"), r6(g.length(turned), "size"), r6(same, "turns"))


@query(f"""
select vec_id, round(pw * qw - px * qx - py * qy - pz * qz, 6) as w, round(pw * qx + px * qw + py * qz - pz * qy, 6) as x,
  round(2 * degrees(acos(least(1, abs(pw * qw + px * qx + py * qy + pz * qz)))), 3) as degrees
from (select vec_id, {_unit_sql('p', 1, 2, 3, 4)}, {_unit_sql('q', 5, 6, 7, 8)} from {_E})""")
def quaternion_product(read):
    p, q = _quat("q"), _quat("p")
    made = g.multiply(p, q)
    return _units(read).select("vec_id", r6(made[0], "w"), r6(made[1], "x"), F.round(g.orientation_error(p, q), 3).alias("degrees"))


@query(f"""
select vec_id, round(-((1 - 2 * (qy * qy + qz * qz)) * e5 + 2 * (qx * qy + qw * qz) * e6 + 2 * (qx * qz - qw * qy) * e7), 6) as x,
  round(-(2 * (qx * qy - qw * qz) * e5 + (1 - 2 * (qx * qx + qz * qz)) * e6 + 2 * (qy * qz + qw * qx) * e7), 6) as y
from (select *, {_unit_sql('q', 1, 2, 3, 4)} from {_E})""")
def camera_centres(read):
    centre = g.camera_centre(_quat("q"), _c(5, 6, 7))
    return _units(read).select("vec_id", r6(centre[0], "x"), r6(centre[1], "y"))


@query(f"""
select vec_id, case when n < 1e-12 then 1 else round(cos(n) + (e1 / n) * (e1 / n) * (1 - cos(n)), 6) end as m00,
  round((e1 / n) * (e2 / n) * (1 - cos(n)) - (e3 / n) * sin(n), 6) as m01, round(1 + 2 * cos(n), 6) as trace
from (select *, sqrt(e1 * e1 + e2 * e2 + e3 * e3) as n from {_E})""")
def axis_angle(read):
    m = g.axis_angle_matrix(_c(1, 2, 3))
    return _e(read).select("vec_id", r6(m[0][0], "m00"), r6(m[0][1], "m01"), r6(m[0][0] + m[1][1] + m[2][2], "trace"))


_RIGID = """[1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy + qw * qz), 2 * (qx * qz - qw * qy)] as a,
  [2 * (qx * qy - qw * qz), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz + qw * qx)] as b, [2 * (qx * qz + qw * qy), 2 * (qy * qz - qw * qx), 1 - 2 * (qx * qx + qy * qy)] as c"""


@query(f"""
select vec_id, case when label % 4 = 1 then 'affine' when label % 4 in (2, 3) then 'rotation' end as code,
  case when label % 4 = 0 then round(abs(qx * 1.0), 5) end as turn
from (select *, {_unit_sql('q', 1, 2, 3, 4)} from {_E})""")
def rigid_poses(read):
    """Poses as 16 numbers, some of them with a wrong last row, a stretched or a mirrored axis, and their image-aligned turn."""
    q, kind = _quat("q"), F.col("label") % 4
    m = g.matrix_of(q)
    stretch = F.when(kind == 2, 1.01).when(kind == 3, -1.0).otherwise(1.0)
    flat = [m[r][c] * (stretch if c == 0 else 1) if r < 3 else (F.when(kind == 1, 0.1).otherwise(0.0) if c == 1 else F.lit(0.0)) for c in range(3) for r in range(4)]
    poses = _units(read).select("vec_id", F.array(*flat, *_c(5, 6, 7), F.lit(1.0)).alias("m"))
    code, pose = g.rigid_code(F.col("m")), g.image_pose(F.col("m"))
    # turned about x by half, (w, x, y, z) becomes (-x, w, z, -y): the new w is the old x
    return poses.select("vec_id", code.alias("code"), F.when(code.isNull(), F.round(F.abs(pose["w"]), 5)).alias("turn"))


@query(f"""
select vec_id, case when label = 0 then 'degenerate' when label = 1 then 'perspective' end as code, case when label > 1 then round(case when label % 2 = 0 then -1 else 1 end * (abs(e5) + 0.1), 4) end as sx,
  case when label > 1 then round(abs(e7) + 0.3, 4) end as sz, round(e8, 6) as tx, case when label > 1 then 1.0::double end as same from {_E}""")
def transforms_taken_apart(read):
    """Transforms put together of movement, turn and scale, some of them mirrored, flat or with perspective, and taken apart again."""
    q = _quat("q")
    label = F.col("label")
    size = [F.abs(F.col(f"e{k}")) + 0.1 * (k - 4) for k in (5, 6, 7)]
    first = F.when(label == 0, 0.0).when(label % 2 == 0, -size[0]).otherwise(size[0])
    m = g.placed(_c(8, 9, 10), q, (first, size[1], size[2]))
    m = F.when(label == 1, F.transform(m, lambda x, i: F.when(i == 7, 0.5).otherwise(x))).otherwise(m)
    rows = _units(read).select("vec_id", *q, m.alias("m")).withColumn("p", g.taken_apart(F.col("m"), 1e-6))
    same = F.abs(g.dot(q, tuple(F.get("p.rotation", F.lit(k)) for k in range(4))))
    return rows.select(
        "vec_id", F.col("p.code").alias("code"), F.round(F.get("p.scale", F.lit(0)), 4).alias("sx"), F.round(F.get("p.scale", F.lit(2)), 4).alias("sz"), r6(F.get("p.translation", F.lit(0)), "tx"), F.round(same, 5).alias("same")
    )


@query("""
select n_nationkey, [round(1 / tan(f / 2) / a, 6), round(1 / tan(f / 2), 6), round(0.1 / 99.9, 6), round(10 / 99.9, 6), round(2 / (f * a), 6), round(1 / 99.9, 6), round(100 / 99.9, 6), 0.1] as m
from (select n_nationkey, 0.3 + n_nationkey * 0.05 as f, 1 + n_regionkey * 0.25 as a from nation)""")
def projection_matrices(read):
    n = read("nation").select("n_nationkey", (0.3 + F.col("n_nationkey") * 0.05).alias("f"), (1 + F.col("n_regionkey") * 0.25).alias("a"))
    near, far = F.lit(0.1), F.lit(100.0)
    p, o, i = g.perspective(F.col("f"), F.col("a"), near, far), g.orthographic(F.col("f"), F.col("a"), near, far), g.perspective(F.col("f"), F.col("a"), near)
    picked = [(p, 0), (p, 5), (p, 10), (p, 14), (o, 0), (o, 10), (o, 14), (i, 14)]
    return n.select("n_nationkey", F.array(*(F.round(F.get(m, F.lit(k)), 6) for m, k in picked)).alias("m"))


@query(f"""
select vec_id, round(sin((1 - t) * o) / sin(o) * pw + s * sin(t * o) / sin(o) * qw, 4) as w, round(sin((1 - t) * o) / sin(o) * px + s * sin(t * o) / sin(o) * qx, 4) as x
from (select *, acos(least(1, abs(d))) as o, case when d < 0 then -1 else 1 end as s from (select *, pw * qw + px * qx + py * qy + pz * qz as d from (
  select vec_id, label / 10.0::double as t, {_unit_sql('p', 1, 2, 3, 4)}, {_unit_sql('q', 5, 6, 7, 8)} from {_E})))""")
def slerp_lookup(read):
    made = g.slerp(_quat("q"), _quat("p"), F.col("label") / 10.0)
    return _units(read).select("vec_id", F.round(made[0], 4).alias("w"), F.round(made[1], 4).alias("x"))


@query("select event_id, round(sum_2 - 0.5, 6) as x, round(sum_3 - 0.5, 6) as y from (select event_id, list_sum(list_transform(range(0, 20), lambda d: ((i // (2 ** d)::bigint) % 2) / (2.0::double ** (d + 1)))) as sum_2, list_sum(list_transform(range(0, 20), lambda d: ((i // (3 ** d)::bigint) % 3) / (3.0::double ** (d + 1)))) as sum_3 from (select event_id, event_id % 8 + 1 as i from events))")
def jitter_cycle(read):
    i = g.jitter_index(F.col("event_id"))
    return read("events").select("event_id", r6(radical_inverse(i, 2) - 0.5, "x"), r6(radical_inverse(i, 3) - 0.5, "y"))


@query("select r_regionkey, round(0.6 * 0.1 * 1000 ** ((r_regionkey + 1) / 5.0::double) + 0.4 * (0.1 + 99.9 * (r_regionkey + 1) / 5.0::double), 5) as far from region")
def cascade_splits(read):
    return read("region").select("r_regionkey", F.round(g.cascade_split(F.col("r_regionkey") + 1, 0.1, 100.0, 5, 0.6), 5).alias("far"))


@query("""
select event_id, [floor(greatest(0, least(1, y + 1.5748 * v)) * 100000 + 0.5)::bigint, floor(greatest(0, least(1, y - 0.1873 * u - 0.4681 * v)) * 100000 + 0.5)::bigint,
  floor(greatest(0, least(1, y + 1.8556 * u)) * 100000 + 0.5)::bigint] as rgb,
  round(0.2126::double * (event_id % 7) + 0.7152::double * (event_id % 11) + 0.0722::double * (event_id % 13), 6) as luma, round(1 / (1 + exp(-greatest(-30, least(30, value::double)))), 6) as squashed
from (select event_id, value, (event_id % 256 - 16) / 219.0::double as y, (event_id % 251 - 128) / 224.0::double as u, (event_id % 241 - 128) / 224.0::double as v from events)""")
def video_colours(read):
    """Colours in hundred-thousandths: many lie half-way between two, where the engines' own rounding differs."""
    i = F.col("event_id")
    rgb = g.video_to_rgb((i % 256).cast("double"), (i % 251).cast("double"), (i % 241).cast("double"))
    luma = g.luminance((i % 7).cast("double"), (i % 11).cast("double"), (i % 13).cast("double"))
    return read("events").select("event_id", F.array(*(F.floor(c * 100_000 + 0.5) for c in rgb)).alias("rgb"), r6(luma, "luma"), r6(g.sigmoid(F.col("value").cast("double")), "squashed"))


@query(f"""
select vec_id, round(0.5 * sqrt((y1 * z2 - z1 * y2) ** 2 + (z1 * x2 - x1 * z2) ** 2 + (x1 * y2 - y1 * x2) ** 2), 5) as area, e1 between 0.1 and 2 and label >= 2 and label > 0 as admitted,
  case when e2 >= -0.5 then round(greatest(-1, least(1, e2 / 0.5)), 6) end as signed
from (select *, e4 - e1 as x1, e5 - e2 as y1, e6 - e3 as z1, e7 - e1 as x2, e8 - e2 as y2, e9 - e3 as z2 from {_E})""")
def triangle_areas(read):
    """Areas of triangles, and of the same numbers which are admitted as depths and their truncated distances."""
    area = g.triangle_area(_c(1, 2, 3), _c(4, 5, 6), _c(7, 8, 9))
    taken = voxels.admitted(F.col("e1"), F.col("label").cast("double"), 0.1, 2.0, 2.0)
    return _e(read).select("vec_id", F.round(area, 5).alias("area"), taken.alias("admitted"), r6(voxels.truncated(F.col("e2"), 0.5), "signed"))


@query(f"select label, count(*) as n, count(*) filter (where abs(sqrt(e1 * e1 + e2 * e2) - 1) <= 0.1) as unit from {_E} group by label")
def unit_norms(read):
    return _e(read).groupBy("label").agg(F.count("*").alias("n"), F.count_if(g.is_unit(_c(1, 2), 0.1)).alias("unit"))


# --- sampling ------------------------------------------------------------------------------------------


def _grids(read) -> DataFrame:
    return images.pixels_of(read("embeddings"), "vec_id", "embedding", 8)


@query("select vec_id as image, x::int as x, y::int as y, round(embedding[(y * 8 // 5) * 8 + (x * 8 // 5) + 1]::double, 6) as value from embeddings, range(0, 5) as a(x), range(0, 5) as b(y)")
def nearest_resample(read):
    axis = F.explode(F.sequence(F.lit(0), F.lit(4)))
    points = read("embeddings").select(F.col("vec_id").alias("image"), axis.alias("x")).select("*", axis.alias("y"))
    return sampling.resampled(points, _grids(read), (5, 5), (8, 8)).select("image", "x", "y", r6(F.col("value"), "value"))


def _bilinear_sql(wrap: bool) -> str:
    u = "e1 * 3 + 4 - 0.5" if wrap else "greatest(0, least(7, e1 * 3 + 4 - 0.5))"
    x0, x1 = ("((i % 8) + 8) % 8", "((i + 1) % 8 + 8) % 8") if wrap else ("i", "least(i + 1, 7)")
    return f"""
select vec_id, round((1 - v + j) * ((1 - u + i) * p[j * 8 + {x0} + 1] + (u - i) * p[j * 8 + {x1} + 1]) + (v - j) * ((1 - u + i) * p[least(j + 1, 7) * 8 + {x0} + 1] + (u - i) * p[least(j + 1, 7) * 8 + {x1} + 1]), 5) as value
from (select *, floor(u)::bigint as i, floor(v)::bigint as j from (select vec_id, embedding::double[] as p, {u} as u, greatest(0, least(7, e2 * 3 + 4 - 0.5)) as v from embeddings join {_E} using (vec_id)))"""


def _bilinear(read, wrap: bool) -> DataFrame:
    points = _e(read).select("vec_id", F.col("vec_id").alias("image"), (F.col("e1") * 3 + 4).alias("x"), (F.col("e2") * 3 + 4).alias("y"))
    return sampling.bilinear(points, _grids(read), 8, 8, "vec_id", wrap).select("vec_id", F.round("value", 5).alias("value"))


@query(_bilinear_sql(False))
def bilinear_sample(read):
    return _bilinear(read, False)


@query(_bilinear_sql(True))
def panorama_sample(read):
    return _bilinear(read, True)


@query("""
with p as (select vec_id as image, (i - 1) % 8 as x, (i - 1) // 8 as y, embedding[i]::double as value from embeddings, range(1, 65) as t(i)),
n as (select *, lead(value) over (partition by image, y order by x) as r, lag(value) over (partition by image, y order by x) as l,
  lead(value) over (partition by image, x order by y) as d, lag(value) over (partition by image, x order by y) as u from p)
select image, x::int as x, y::int as y, round((coalesce(r, value) - coalesce(l, value)) / ((r is not null)::int + (l is not null)::int), 6) as gx,
  round((coalesce(d, value) - coalesce(u, value)) / ((d is not null)::int + (u is not null)::int), 6) as gy from n""")
def central_differences(read):
    return images.gradient(_grids(read)).select("image", "x", "y", r6(F.col("gx"), "gx"), r6(F.col("gy"), "gy"))


# --- rigs and views ------------------------------------------------------------------------------------


@query("""
select l_orderkey, l_linenumber, p_size, s_acctbal, case when p_size is null then 'no-camera' when s_acctbal is null then 'no-pose' end as code
from lineitem left join (select * from part where p_size > 5) on p_partkey = l_partkey left join (select * from supplier where s_acctbal > 0) on s_suppkey = l_suppkey""")
def matched_poses(read):
    cameras = read("part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    poses = read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return rigs.matched(read("lineitem"), cameras, poses, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "p_size", "s_acctbal", "code")


@query("""
select c_custkey, n_name, case when count(*) over (partition by k) > 1 then 'duplicate' when n_name is null then 'no-calibration' end as code
from (select *, c_custkey // 2 * (c_custkey % 5) as k from customer) left join (select * from nation where n_regionkey <> 2) on n_nationkey = c_nationkey""")
def calibrated_rig(read):
    rig = read("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.expr("c_custkey div 2 * (c_custkey % 5)").alias("k"))
    return rigs.calibrated(rig, read("nation").where("n_regionkey <> 2").select("n_nationkey", "n_name"), "n_nationkey", "k").select("c_custkey", "n_name", "code")


def _cameras(df: DataFrame, key: str) -> DataFrame:
    """Cameras that look along +z from places set back by their key."""
    turn = [F.lit(1.0 if k in (0, 4, 8) else 0.0).alias(f"r{k}") for k in range(9)]
    back = F.col(key) * 0.1 + 3
    return df.select(
        key, *turn, F.lit(0.0).alias("t0"), (F.col(key) * -0.05).alias("t1"), back.alias("t2"), F.lit(0.0).alias("ex"), (F.col(key) * 0.05).alias("ey"), (-back).alias("ez"),
        *(F.lit(v).alias(n) for n, v in (("fx", 4.0), ("fy", 4.0), ("cx", 4.0), ("cy", 4.0), ("width", 8), ("height", 8))),
    )


@query(f"""
with t as (select *, (e1 + e4 + e7) / 3 as mx, (e2 + e5 + e8) / 3 as my, (e3 + e6 + e9) / 3 as mz, (e5 - e2) * (e9 - e3) - (e6 - e3) * (e8 - e2) as nx, (e6 - e3) * (e7 - e1) - (e4 - e1) * (e9 - e3) as ny,
  (e4 - e1) * (e8 - e2) - (e5 - e2) * (e7 - e1) as nz from {_E}),
c as (select n_nationkey as k, n_nationkey * 0.1 + 3 as back, n_nationkey * 0.05 as up from nation),
v as (select *, 4 * mx / (mz + back) + 4 as px, 4 * (my - up) / (mz + back) + 4 as py, mz + back as z, abs(nx * -mx + ny * (up - my) + nz * (-back - mz)) / (sqrt(nx * nx + ny * ny + nz * nz) * sqrt(mx * mx + (up - my) * (up - my) + (back + mz) * (back + mz))) as f from t, c)
select vec_id, k as n_nationkey, round(px, 5) as px, round(py, 5) as py, round(f, 5) as facing from v where z > 1e-8 and f >= 0.3 and px between 0 and 8 and py between 0 and 8""")
def triangle_cameras(read):
    t = _e(read).select("vec_id", *(F.col(f"e{3 * k + i + 1}").alias(f"{a}{k}") for k in range(3) for i, a in enumerate("xyz")))
    out = rigs.candidates(t, _cameras(read("nation"), "n_nationkey"), "n_nationkey", 0.3)
    return out.select("vec_id", "n_nationkey", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"), F.round("facing", 5).alias("facing"))


@query(f"""
with v as (select vec_id, r_regionkey as frame, round(4 * e1 / (e3 + r_regionkey * 0.1 + 3) + 4)::bigint as px, round(4 * (e2 - r_regionkey * 0.05) / (e3 + r_regionkey * 0.1 + 3) + 4)::bigint as py, e3 + r_regionkey * 0.1 + 3 as z from {_E}, region)
select v.vec_id, frame, px, py, round(z, 6) as depth, round(i.embedding[py * 8 + px + 1]::double, 6) as value from v join embeddings i on i.vec_id = frame where z > 1e-8 and px between 0 and 7 and py between 0 and 7""")
def voxels_on_pixels(read):
    points = _e(read).select("vec_id", *(F.col(f"e{k + 1}").alias(a) for k, a in enumerate("xyz")))
    pixels = _grids(read).select(F.col("image").alias("frame"), F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"), "value")
    frames = _cameras(read("region"), "r_regionkey").withColumnRenamed("r_regionkey", "frame")
    return rigs.voxel_pixels(points, frames, pixels, "frame").select("vec_id", "frame", "px", "py", r6(F.col("depth"), "depth"), r6(F.col("value"), "value"))


@query(f"""
with p as (select vec_id, 4 + e1 * 2 as x, 4 + e2 * 2 as y, 0.2 + abs(e3) * 30 as z from {_E}),
c as (select vec_id, ((least(3, floor(greatest(0, least(0.999999, ln(z / 0.1) / ln(1000))) * 4)::int) * 4 + least(3, floor(y * 4 / 8)::int)) * 4 + least(3, floor(x * 4 / 8)::int))::int as cluster from p where x >= 0 and x < 8 and y >= 0 and y < 8),
l as (select label, cluster, count(*) as n from c join embeddings using (vec_id) group by all)
select vec_id, c.cluster, label, n from c join l using (cluster)""")
def pixel_lights(read):
    """The lights, here labels, of the cluster in which each pixel lies."""
    p = _e(read).select("vec_id", "label", (4 + F.col("e1") * 2).alias("x"), (4 + F.col("e2") * 2).alias("y"), (0.2 + F.abs(F.col("e3")) * 30).alias("z"))
    at = p.where("x >= 0 and x < 8 and y >= 0 and y < 8").withColumn("cluster", tiles.cluster_of(F.col("x"), F.col("y"), F.col("z"), (8, 8), (0.1, 100.0), (4, 4, 4)))
    lights = at.groupBy("label", "cluster").agg(F.count("*").alias("n"))
    return tiles.lit_by(at.select("vec_id", "cluster"), lights, "cluster").select("vec_id", "cluster", "label", "n")


@query(f"select floor(e1)::bigint as x, floor(e2)::bigint as y, arg_min(vec_id, e3) as id from {_E} where floor(e1) = 0 and floor(e2) = -1 group by all")
def picked(read):
    """The nearest thing at one pixel: a filter, then the least depth."""
    e = _e(read).select("vec_id", F.floor("e1").alias("x"), F.floor("e2").alias("y"), F.col("e3").alias("depth"))
    return tiles.picked(e, 0, -1, "vec_id", "depth").withColumnRenamed("vec_id", "id")


@query(f"select vec_id, label, row_number() over (partition by label order by (e1 - 1) * (e1 - 1) + (e2 - 2) * (e2 - 2) + (e3 - 3) * (e3 - 3) desc, vec_id)::int as place from {_E}")
def far_to_near(read):
    return tiles.far_to_near(_e(read), ["label"], _c(1, 2, 3), (1.0, 2.0, 3.0), "vec_id").select("vec_id", "label", "place")


# --- meshes --------------------------------------------------------------------------------------------


@query("""
with t as (select o_orderkey as id, o_custkey as a, o_orderkey % 50 as b, o_orderkey % 300 as c from orders), v as (select p_partkey as k, p_retailprice as x, p_size as y from part where p_size > 2)
select id, case when va.k is null or vb.k is null or vc.k is null then 'no-vertex' end as code, round(va.x, 4) as x0, vb.y as y1, round(vc.x, 4) as x2 from t left join v va on va.k = a left join v vb on vb.k = b left join v vc on vc.k = c""")
def triangle_corners(read):
    k = F.col("o_orderkey").cast("long")
    t = read("orders").select(k.alias("id"), F.col("o_custkey").cast("long").alias("a"), (k % 50).alias("b"), (k % 300).alias("c"))
    v = read("part").where("p_size > 2").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_retailprice").alias("x"), F.col("p_size").alias("y"))
    return meshes.corners(t, v, "id", "k", ["x", "y"]).select("id", "code", F.round("x0", 4).alias("x0"), "y1", F.round("x2", 4).alias("x2"))


@query("""
with v as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as n from customer), b as (select c_nationkey, sum(count(*)) over (order by c_nationkey) - count(*) as base from v group by 1)
select c_custkey, (n + base)::bigint as a, ((n + 1) % 3 + base)::bigint as b, (n + base)::bigint as vertex from v join b using (c_nationkey)""")
def union_rebased(read):
    line = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    v = read("customer").select("c_custkey", "c_nationkey", (F.row_number().over(line) - 1).cast("long").alias("n"))
    t = v.select("c_custkey", "c_nationkey", F.col("n").alias("a"), ((F.col("n") + 1) % 3).alias("b"))
    vertices, faces = meshes.joined(v, t, "c_nationkey", "n")
    return faces.select("c_custkey", "a", "b").join(vertices.select("c_custkey", F.col("n").alias("vertex")), "c_custkey")


_FACES = f"(select vec_id as a, lead(vec_id) over (order by vec_id) as b, lead(vec_id, 2) over (order by vec_id) as c from {_E})"


@query(f"""
with p as (select vec_id, e1 as x, e2 as y, e3 as z, e4 as u, e5 as v, e6 / sqrt(e6 * e6 + e7 * e7 + e8 * e8) as nx, e7 / sqrt(e6 * e6 + e7 * e7 + e8 * e8) as ny, e8 / sqrt(e6 * e6 + e7 * e7 + e8 * e8) as nz from {_E}),
f as (select a, b, c from {_FACES} where c is not null and b = a + 1 and c = a + 2),
d as (select a, b, c, q.x - p.x as ex, q.y - p.y as ey, q.z - p.z as ez, r.x - p.x as fx, r.y - p.y as fy, r.z - p.z as fz, q.u - p.u as u1, q.v - p.v as v1, r.u - p.u as u2, r.v - p.v as v2
  from f join p on p.vec_id = a join p q on q.vec_id = b join p r on r.vec_id = c),
t as (select unnest([a, b, c]) as vec_id, (ex * v2 - fx * v1) / (u1 * v2 - v1 * u2) as tx, (ey * v2 - fy * v1) / (u1 * v2 - v1 * u2) as ty, (ez * v2 - fz * v1) / (u1 * v2 - v1 * u2) as tz,
  (fx * u1 - ex * u2) / (u1 * v2 - v1 * u2) as bx, (fy * u1 - ey * u2) / (u1 * v2 - v1 * u2) as bb, (fz * u1 - ez * u2) / (u1 * v2 - v1 * u2) as bz from d where abs(u1 * v2 - v1 * u2) > 1e-12),
s as (select vec_id, sum(tx) as tx, sum(ty) as ty, sum(tz) as tz, sum(bx) as bx, sum(bb) as bb, sum(bz) as bz from t group by 1),
o as (select *, tx - nx * (nx * tx + ny * ty + nz * tz) as ox, ty - ny * (nx * tx + ny * ty + nz * tz) as oy, tz - nz * (nx * tx + ny * ty + nz * tz) as oz from s join p using (vec_id))
select vec_id, round(ox / sqrt(ox * ox + oy * oy + oz * oz), 4) as tx, case when (ny * oz - nz * oy) * bx + (nz * ox - nx * oz) * bb + (nx * oy - ny * ox) * bz < 0 then -1.0 else 1.0 end::double as hand from o""")
def vertex_tangents(read):
    e = _e(read)
    v = e.select(F.col("vec_id").alias("k"), *(F.col(f"e{i + 1}").alias(a) for i, a in enumerate("xyzuv")))
    t = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") + 2).alias("c"))
    found = meshes.corners(t.withColumn("id", F.col("a")), v, "id", "k", list("xyzuv")).where("code is null").select("*", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    n = g.length(_c(6, 7, 8))
    normals = e.select("vec_id", *((F.col(f"e{k}") / n).alias(f"n{a}") for k, a in zip((6, 7, 8), "xyz", strict=True)))
    some = found.select(F.explode(F.array("a", "b", "c")).alias("vec_id")).distinct()
    return meshes.tangents(found, normals.join(some, "vec_id", "left_semi"), "vec_id").select("vec_id", F.round("tx", 4).alias("tx"), "hand")


@query(f"""
with m as (select vec_id, label, e1 + 0.25 * e4 - 0.5 * e7 as x, e2 + 0.25 * e5 - 0.5 * e8 as y, e3 + 0.25 * e6 - 0.5 * e9 as z from {_E})
select vec_id, round(0.75 * ((1 + j) * x + j) + 0.25 * ((1 + k) * x + k), 5) as x, round(0.75 * (y - 2 * j) + 0.25 * (y - 2 * k), 5) as y, round(z, 5) as z from (select *, least(4, label) as j, least(4, label // 2) as k from m)""")
def morph_and_skin(read):
    e = _e(read)
    v = e.select("vec_id", *(F.col(f"e{k + 1}").alias(a) for k, a in enumerate("xyz")))
    target = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), *(F.col(f"e{3 * t + 4 + k}").alias(f"d{a}") for k, a in enumerate("xyz"))) for t in (0, 1)))).alias("t")
    weights = read("region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("int").alias("target"), F.when(F.col("r_regionkey") == 0, 0.25).otherwise(-0.5).alias("weight"))
    moved = meshes.morphed(v, e.select("vec_id", target).select("vec_id", "t.*"), weights, "vec_id")
    pull = F.explode(F.array(F.struct(F.col("label").cast("long").alias("joint"), F.lit(0.75).alias("weight")), F.struct(F.floor(F.col("label") / 2).alias("joint"), F.lit(0.25).alias("weight")))).alias("p")
    j, one, zero = F.col("r_regionkey").cast("double"), F.lit(1.0), F.lit(0.0)
    joints = read("region").select(F.col("r_regionkey").cast("long").alias("joint"), F.array(1 + j, zero, zero, zero, zero, one, zero, zero, zero, zero, one, zero, j, -2 * j, zero, one).alias("m"))
    out = meshes.skinned(moved, e.select("vec_id", pull).select("vec_id", "p.*"), joints, "vec_id")
    return out.select("vec_id", *(F.round(a, 5).alias(a) for a in "xyz"))


# --- runs, counters and names ---------------------------------------------------------------------------


@query("select count(*) as newly from (select user_id, event_type from events where event_id % 3 = 0 and value > 0 group by all) as n anti join (select user_id, event_type from events where event_id % 3 = 1 and value > 0 group by all) as o using (user_id, event_type)")
def newly_observed(read):
    def state(k: int) -> DataFrame:
        return read("events").where(F.col("event_id") % 3 == k).groupBy("user_id", "event_type").agg(F.sum(F.greatest("value", F.lit(0))).alias("weight"))

    return runs.newly_observed(state(1), state(0), ["user_id", "event_type"], "weight")


@query("select event_type, max(n) as n, round(max(total), 4) as total from (select event_type, ts::date as d, count(*) as n, sum(value) as total from events group by all) group by 1")
def peak_counters(read):
    frames = read("events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return runs.peaks(frames, ["event_type"], ["n", "total"]).select("event_type", "n", F.round("total", 4).alias("total"))


@query("select count(*) as images, sum(length(p_name))::bigint as source_bytes, sum(16 * p_size * (p_size + 1))::bigint as working_bytes from part where p_size > 0")
def report_totals(read):
    p = read("part").where("p_size > 0").select(F.length("p_name").alias("bytes"), F.col("p_size").alias("width"), (F.col("p_size") + 1).alias("height"))
    return runs.totals(p)


@query("select o_custkey, max(o_orderkey) filter (where o_orderstatus = 'F') as latest, count(*) filter (where o_orderstatus = 'F') as runs from orders group by 1 having count(*) filter (where o_orderstatus = 'F') > 0")
def latest_run(read):
    o = read("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "run.json").otherwise("log.txt").alias("file"))
    return runs.latest(o, "o_custkey", "o_orderkey", "file")


@query("""
with w as (select page_id, split_part(split_part(url, '://', 2), '?', 1) as name from pages), l as (select name, count(*) as n from w where page_id % 3 = 0 group by 1),
m as (select name from l union all select 'nowhere/' || r_regionkey from region)
select page_id, name from w semi join m using (name)""")
def listed_only(read):
    """The rows that a list names: a semi join, the list's problems being told apart."""
    w = read("pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)).alias("name"))
    names_ = w.where("page_id % 3 = 0").select("name").unionByName(read("region").select(F.concat(F.lit("nowhere/"), F.col("r_regionkey").cast("string")).alias("name")))
    return tables.listed(w, names_, "name")


@query("""
with w as (select split_part(split_part(url, '://', 2), '?', 1) as name, page_id from pages), m as (select name from w where page_id % 3 = 0 union all select 'nowhere/' || r_regionkey from region union all select '../up' from region)
select name, case when name like '../%' or name like '%/' then 'path' when count(*) > 1 then 'duplicate' else 'missing' end as code from m group by name having count(*) > 1 or name like '%/' or name not in (select name from w)""")
def list_problems(read):
    w = read("pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)).alias("name"))
    more = [F.concat(F.lit("nowhere/"), F.col("r_regionkey").cast("string")), F.lit("../up")]
    names_ = w.where("page_id % 3 = 0").select("name")
    for m in more:
        names_ = names_.unionByName(read("region").select(m.alias("name")))
    return tables.list_problems(w, names_, "name")


@query("select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey between 1 and 30000 then o_orderkey end as checkpoint, case when o_orderkey % 3 = 1 then round(o_totalprice, 2) end as stamp, o_orderkey % 3 = 1 as image from orders")
def name_numbers(read):
    k = F.col("o_orderkey")
    price = F.format_string("%.2f", F.col("o_totalprice").cast("double"))
    made = F.when(k % 3 == 0, F.concat(F.lit("a/checkpoint_"), k.cast("string"), F.lit(".ply"))).when(k % 3 == 1, F.concat(F.lit("wide/4_1_"), price, F.lit(".JPG"))).otherwise(F.concat(F.lit("checkpoint_"), k.cast("string"), F.lit("x.ply")))
    stamp = F.when(k % 3 == 1, names.timestamp_of(F.col("path")))
    return read("orders").withColumn("path", made).select("o_orderkey", names.checkpoint_number(F.col("path"), 30_000).alias("checkpoint"), F.round(stamp, 2).alias("stamp"), names.is_image(F.col("path")).alias("image"))


@query("select conv_id, turn, to_json(text || chr(10) || '\"\\')::varchar as js from conversations")
def json_strings(read):
    return read("conversations").select("conv_id", "turn", names.json_string(F.concat("text", F.lit('\n"\\'))).alias("js"))


@query("select event_id, event_id % 5 > 2 as dropped from events")
def writer_pressure(read):
    """With three writes pending the newest frame is dropped."""
    return runs.pressed(read("events").select("event_id", (F.col("event_id") % 5).alias("pending")), "pending", 3).select("event_id", "dropped")


@query("""
select user_id, count(*) filter (where s = 0) as accepted, count(*) filter (where s = 1) as dropped, count(*) filter (where s = 2) as failed, count(*) filter (where s = 3) as rejected
from (select user_id, case when event_id % 5 > 2 then 1 when event_id % 11 = 0 then 2 when value < 20 then 3 else 0 end as s from events) group by 1""")
def frame_counters(read):
    e = runs.pressed(read("events").withColumn("pending", F.col("event_id") % 5), "pending", 3)
    return runs.counters(e, ["user_id"], F.col("dropped"), F.col("event_id") % 11 == 0, F.col("value") < 20)


@query("select l_linestatus, sum(case l_linenumber % 3 when 0 then 0 when 1 then 128 else 255 end)::bigint as level from lineitem group by 1")
def confidence_levels(read):
    return read("lineitem").groupBy("l_linestatus").agg(F.sum(manifest.confidence(F.col("l_linenumber") % 3)).alias("level"))


@query(f"""
select event_id, round(m[1], 4) as m0, round(-m[2] + 0.0, 4) as m4, round(p, 4) as px from (select event_id, [1 + -sin(n) * 0 - (1 - cos(n)), sin(n)] as m, -(value * cos(n) + {_SECONDS} / 1e9 * sin(n)) as p from (select *, (event_id % 30) / 10.0::double as n from events))""")
def trajectory_poses(read):
    """Lines of a trajectory, turns about z, as poses of 16 numbers."""
    from terrace.sources import scans

    parts = [seconds(), F.lit(0), F.lit(0), (F.col("event_id") % 30) / 10.0, F.col("value").cast("double"), seconds() / 1e9, F.lit(0)]
    lines = read("events").select("event_id", F.concat_ws(" ", *(p.cast("double").cast("string") for p in parts)).alias("line"))
    made = scans.trajectory(lines)
    return made.select("event_id", *(F.round(F.get("pose", F.lit(k)) + 0.0, 4).alias(n) for n, k in (("m0", 0), ("m4", 4), ("px", 12))))


@query("select s_suppkey, case when s_nationkey = 0 then null else s_nationkey end as width, round(s_acctbal::double, 2) as fx, case when s_nationkey = 0 or s_acctbal <= 0 then 'bounds' end as code from supplier")
def pinhole_files(read):
    from terrace.sources import scans

    text = F.concat_ws(" ", F.col("s_nationkey").cast("string"), F.lit("480"), F.col("s_acctbal").cast("string"), F.lit("500.5"), F.lit("3e2"), F.lit("240"))
    made = scans.pinhole(read("supplier").select("s_suppkey", text.alias("text")))
    return made.select("s_suppkey", F.nullif("width", F.lit(0)).cast("int").alias("width"), F.round("fx", 2).alias("fx"), "code")


def _gap_sql() -> str:
    """The SQL of ``keyframe_select`` with the number of rows since the last chosen one."""
    from terrace.plans.registry import _SQL

    sql = _SQL["keyframe_select"].replace("''::varchar as reason from o where i = 0", "''::varchar as reason, null::bigint as gap from o where i = 0").replace(", x\n  from f join o", ", x, o.i - f.at\n  from f join o")
    return sql[: sql.rindex("select user_id")] + "select user_id, event_id, gap::int as gap from f where i >= 0"


@query(_gap_sql())
def keyframe_gap(read):
    from terrace.operators import fold

    rejected = F.when(F.col("event_type") == "purchase", "relative-blur").when(F.col("value") < 1, "underexposed")
    out = fold.keyframes(read("events"), ["user_id"], ["ts", "event_id"], F.col("value").cast("double"), rejected, {"event_id": F.col("event_id")}, 2, 5, 10.0, 60.0)
    return out.select("user_id", "event_id", "gap")


@query("""
with k as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events),
b as (select *, max((event_type = 'purchase')::int) over (partition by user_id order by i rows unbounded preceding) as f from k where i >= 2 and i < 12)
select user_id, event_id from b where f = 0""")
def replayed(read):
    """Each user's events from the third, ten at most, up to the first that fails."""
    from terrace.sources import scans

    line = F.struct("ts", "event_id")
    return scans.replay(read("events").withColumn("at", line), "user_id", "at", 2, 10, F.col("event_type") == "purchase").select("user_id", "event_id")


@query("select unnest(['svd', 'horn']) as form, 2.0::double as scale, [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]::double[] as rotation, [1.0, 3.0, -1.0]::double[] as translation")
def similarity_forms(read):
    """Both fits of pairs whose transform is known: the SQL states it."""
    from terrace.operators import align

    e = _e(read)
    pairs = e.select(*(F.col(f"e{k + 1}").alias(f"s{a}") for k, a in enumerate("xyz")), (2 * F.col("e2") + 1).alias("tx"), (3 - 2 * F.col("e1")).alias("ty"), (2 * F.col("e3") - 1).alias("tz"))
    row = align.moments(pairs).first()
    rows = []
    for form, fit in (("svd", align.fitted(row)), ("horn", align.horn(row, (0.1, 10.0)))):
        clean = lambda v: [round(float(x), 6) + 0.0 for x in v]
        rows.append((form, round(fit.scale, 6), clean(fit.rotation.ravel()), clean(fit.translation)))
    return e.sparkSession.createDataFrame(rows, "form string, scale double, rotation array<double>, translation array<double>")


@query(f"select vec_id, round(2 * e1 + 1, 5) as x, round(-3 * e2, 5) as y, round(e4 / 2 / sqrt(e4 * e4 / 4 + e5 * e5 / 9 + e6 * e6), 5) as nx, floor(greatest(0, least(1, e7)) * 255 + 0.5)::int as red, vec_id + 2 as b from {_E}")
def exported_mesh(read):
    """Vertices and triangles as a file of a mesh has them, under a transform that mirrors."""
    import numpy as np

    m = np.array([[2.0, 0, 0, 1], [0, -3, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    v = _e(read).select("vec_id", *(F.col(f"e{k + 1}").alias(n) for k, n in enumerate(("x", "y", "z", "nx", "ny", "nz"))), meshes.byte_colour(F.col("e7")).alias("red"))
    t = _e(read).select("vec_id", F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") + 2).alias("c"))
    made = meshes.in_world(v, m).join(meshes.wound(t, m).select("vec_id", "b"), "vec_id")
    return made.select("vec_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("nx", 5).alias("nx"), "red", "b")


# --- volumes, streams and models --------------------------------------------------------------------------


@query(f"""
with b as (select list(e1 order by e1) as a, list(e2 order by e2) as b, list(e3 order by e3) as c, count(*) as n from {_E}),
q as (select [a[1 + i], b[1 + i], c[1 + i]] as lo, [a[1 + j], b[1 + j], c[1 + j]] as hi from (select *, least(n - 1, floor(0.005::double * (n - 1)))::bigint as i, least(n - 1, floor(0.995::double * (n - 1)))::bigint as j from b)),
v as (select *, greatest(0.01, list_max(list_transform(range(1, 4), lambda k: hi[k] - lo[k] + 0.2)) / 127) as voxel from q)
select unnest(range(0, 3))::int as axis, unnest(list_transform(range(1, 4), lambda k: round(lo[k] - 0.1, 6))) as origin, round(voxel, 8) as voxel, round(greatest(4 * voxel, 0.04), 8) as truncation,
  unnest(list_transform(range(1, 4), lambda k: ceil((hi[k] - lo[k] + 0.2) / voxel - 1e-9)::int + 1)) as cells from v""")
def auto_bounds(read):
    found = voxels.bounds(_e(read), ["e1", "e2", "e3"], 0.1, 0.01, 128)
    rows = [(k, round(float(o), 6), round(float(found["voxel"]), 8), round(float(found["truncation"]), 8), int(n)) for k, (o, n) in enumerate(zip(found["origin"], found["cells"], strict=True))]
    return read("embeddings").sparkSession.createDataFrame(rows, "axis int, origin double, voxel double, truncation double, cells int")


@query(f"select vec_id as ray, (1 + abs(floor(e4 / 0.25) - floor(e1 / 0.25)) + abs(floor(e5 / 0.25) - floor(e2 / 0.25)) + abs(floor(e6 / 0.25) - floor(e3 / 0.25)))::bigint as cells from {_E}")
def ray_cell_counts(read):
    """A ray passes one cell, and one more at each side of a cell that it crosses."""
    rays = _e(read).select(F.col("vec_id").alias("ray"), *(F.col(f"e{k + 1}").alias(f"o{a}") for k, a in enumerate("xyz")), *(F.col(f"e{k + 4}").alias(f"e{a}") for k, a in enumerate("xyz")))
    return voxels.ray_cells(rays, size=0.25).groupBy("ray").agg(F.count("*").alias("cells"))


@query(f"""
with p as (select vec_id, label as camera, floor(4 + e1 * 2)::int as px, floor(4 + e2 * 2)::int as py, abs(e3) + 0.5 as z from {_E}),
n as (select camera, px, py, min(z) as near from p group by all)
select p.vec_id from p join n using (camera, px, py) where z <= near * 1.1::double + 1e-4""")
def visible_points(read):
    from terrace.operators import bake

    at = [F.floor(4 + F.col(f"e{k}") * 2).cast("int") for k in (1, 2)]
    p = _e(read).select("vec_id", F.col("label").alias("camera"), at[0].alias("px"), at[1].alias("py"), (F.abs(F.col("e3")) + 0.5).alias("z"))
    nearest = p.groupBy("camera", "px", "py").agg(F.min("z").alias("depth"))
    return bake.visible(p, nearest, ["camera"], 0.1).select("vec_id")


@query("""
with recursive o as (select user_id, value::double as s, (1 + event_id % 3)::double as w, row_number() over (partition by user_id order by event_id % 2, ts, event_id) as i from events),
f as (
  select user_id, 0::bigint as i, 0::double as v, 0::double as wt from o where i = 1
  union all
  select f.user_id, o.i, (f.v * (least(20.0, f.wt + w) - least(w, least(20.0, f.wt + w))) + s * least(w, least(20.0, f.wt + w))) / least(20.0, f.wt + w), least(20.0, f.wt + w)
  from f join o on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, round(v, 5) as mean, wt::double as weight, i as observations from f qualify row_number() over (partition by user_id order by i desc) = 1""")
def fused_batches(read):
    """Two micro-batches, even events and then odd ones, put into one state."""
    from terrace.streaming import fusion

    e = read("events").withColumn("w", (1 + F.col("event_id") % 3).cast("double"))
    state = None
    for k in (0, 1):
        state = fusion.fused(state, e.where(F.col("event_id") % 2 == k), ["user_id"], ["ts", "event_id"], "value", "w", 20.0)
    return state.select("user_id", F.round("mean", 5).alias("mean"), "weight", "observations")


@query("select 2.0::double as scale, [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]::double[] as rotation, [1.0, 3.0, -1.0]::double[] as translation")
def consensus_fit(read):
    """Pairs of which those of four labels in ten are wrong; the transform of the others is known and the SQL states it."""
    from terrace.operators import align

    e = _e(read)
    wrong = F.col("label") < 4
    good = (2 * F.col("e2") + 1, 3 - 2 * F.col("e1"), 2 * F.col("e3") - 1)
    pairs = e.select("vec_id", *(F.col(f"e{k + 1}").alias(f"s{a}") for k, a in enumerate("xyz")), *(F.when(wrong, 9 * F.col(f"e{k + 4}")).otherwise(t).alias(f"t{a}") for k, (a, t) in enumerate(zip("xyz", good, strict=True))))
    fit = align.consensus(pairs, "vec_id", 1e-3, trials=64)
    clean = lambda v: [round(float(x), 5) + 0.0 for x in v]
    return e.sparkSession.createDataFrame([(round(fit.scale, 5), clean(fit.rotation.ravel()), clean(fit.translation))], "scale double, rotation array<double>, translation array<double>")


@query("""
select p_partkey, case when p_partkey % 7 = 0 then 'path' when p_partkey % 5 = 0 then 'sha256' when p_size <= 3 then 'stride' when p_partkey % 3 = 0 then 'size' end as code from part""")
def plane_records(read):
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.when(k % 7 == 0, F.lit("a/../b")).otherwise(F.concat(F.lit("planes/"), k.cast("string")))
    sha = F.when(k % 5 == 0, F.lit("abc")).otherwise(F.sha2(F.col("p_name"), 256))
    plane = F.struct(
        path.alias("path"), sha.alias("sha256"), (size - 3).alias("width"), F.lit(2).alias("height"), (size - 3).alias("row_stride"), F.lit(1).alias("bytes_per_pixel"),
        ((size - 3) * 2 + F.when(k % 3 == 0, 1).otherwise(0)).cast("long").alias("byte_count"),
    )
    return read("part").select("p_partkey", manifest.plane_code(plane).alias("code"))


@query("""
select s_suppkey as camera_id, case s_suppkey % 3 when 0 then 'PINHOLE' when 1 then 'SIMPLE_PINHOLE' else 'FISHEYE' end as model, s_nationkey + 1 as width,
  case s_suppkey % 3 when 0 then null when 1 then null else 'unknown-model' end as code, 4 as params, round(s_acctbal::double, 2) as focal from supplier where s_suppkey % 3 <> 1
union all select s_suppkey, 'SIMPLE_PINHOLE', s_nationkey + 1, 'parameters', 4, round(s_acctbal::double, 2) from supplier where s_suppkey % 3 = 1""")
def sfm_cameras(read):
    from terrace.sources import sfm

    model = F.when(F.col("s_suppkey") % 3 == 0, "PINHOLE").when(F.col("s_suppkey") % 3 == 1, "SIMPLE_PINHOLE").otherwise("FISHEYE")
    line = F.concat_ws(" ", F.col("s_suppkey").cast("string"), model, (F.col("s_nationkey") + 1).cast("string"), F.lit("480"), F.col("s_acctbal").cast("string"), F.lit("1 2 3"))
    made = sfm.cameras_of(read("supplier").select(line.alias("line")))
    return made.select("camera_id", "model", "width", "code", F.size("params").alias("params"), F.round(F.get("params", F.lit(0)), 2).alias("focal"))


@query("select event_id as image_id, round(value::double, 2) as tx, user_id as camera_id, event_type || '/' || event_id as name, (event_id % 4)::int as observations, case when event_id % 5 = 0 then 'quaternion' end as code from events")
def sfm_images(read):
    """Records of two lines each, the second with as many observations as it has."""
    from terrace.sources import sfm

    k = F.col("event_id").cast("string")
    first = F.concat_ws(" ", k, F.when(F.col("event_id") % 5 == 0, "2").otherwise("1"), F.lit("0 0 0"), F.col("value").cast("string"), F.lit("0 0"), F.col("user_id").cast("string"), F.concat_ws("/", "event_type", k))
    second = F.concat_ws(" ", F.transform(F.when(F.col("event_id") % 4 > 0, F.sequence(F.lit(1), (F.col("event_id") % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.lit("1.5 2.5 -1")))
    lines = read("events").select(F.col("user_id").alias("file"), F.posexplode(F.array(first, second)).alias("i", "line"), "event_id")
    made = sfm.images_of(lines.select("file", (F.col("event_id") * 2 + F.col("i")).alias("at"), "line"))
    return made.select("image_id", F.round("tx", 2).alias("tx"), "camera_id", "name", "observations", "code")


@query(f"""
with q as (select vec_id, abs(e5) + 0.1 as a, abs(e6) + 0.1 as b, abs(e7) + 0.1 as c, {_unit_sql('q', 1, 2, 3, 4)}, abs(e8) + 1 as z, e9 as x from {_E}),
m as (select *, 1 - 2 * (qy * qy + qz * qz) as r00, 2 * (qx * qy - qw * qz) as r01, 2 * (qx * qz + qw * qy) as r02, 2 * (qx * qz - qw * qy) as r20, 2 * (qy * qz + qw * qx) as r21, 1 - 2 * (qx * qx + qy * qy) as r22 from q),
v as (select *, r00 * r00 * a * a + r01 * r01 * b * b + r02 * r02 * c * c as xx, r00 * r20 * a * a + r01 * r21 * b * b + r02 * r22 * c * c as xz, r20 * r20 * a * a + r21 * r21 * b * b + r22 * r22 * c * c as zz from m)
select vec_id, round(xx, 5) as xx, round((100 / z) ** 2 * xx - 2 * (100 / z) * (100 * x / (z * z)) * xz + (100 * x / (z * z)) ** 2 * zz + 0.3, 3) as wide from v""")
def projected_splats(read):
    from terrace.functions import splats

    e = _units(read)
    cov = splats.covariance(_quat("q"), tuple(F.abs(F.col(f"e{k}")) + 0.1 for k in (5, 6, 7)))
    zero, one = F.lit(0.0), F.lit(1.0)
    e = e.select("vec_id", "e8", "e9", *(cov[i][k].alias(f"c{i}{k}") for i in range(3) for k in range(3)))
    held = tuple(tuple(F.col(f"c{i}{k}") for k in range(3)) for i in range(3))
    view = ((one, zero, zero), (zero, one, zero), (zero, zero, one))
    xx, _, _ = splats.projected_covariance(held, view, (F.col("e9"), zero, F.abs(F.col("e8")) + 1), F.lit(100.0), F.lit(100.0))
    return e.select("vec_id", F.round("c00", 5).alias("xx"), F.round(xx, 3).alias("wide"))


@query("""
select 'rows' as budget, count(*)::bigint as used, 1000::bigint as most, count(*) > 1000 as exceeded from lineitem union all
select 'keys', count(distinct l_partkey), 100000, count(distinct l_partkey) > 100000 from lineitem union all
select 'largest', max(n), 40, max(n) > 40 from (select max(l_linenumber)::bigint as n from lineitem)""")
def budget_guards(read):
    limits = {"rows": (F.count("*"), 1000), "keys": (F.countDistinct("l_partkey"), 100_000), "largest": (F.max("l_linenumber"), 40)}
    return tables.budgets(read("lineitem"), limits)


@query(f"""
with r as (select vec_id as ray, floor(e1 / 0.5)::bigint as x, floor(e2 / 0.5)::bigint as y from {_E}),
c as (select distinct ray, x + i as cx, y + j as cy from r, range(-1, 2) as a(i), range(-1, 2) as b(j))
select ray, cx, cy, 0::bigint as cz from c where cx between 0 and 3 and cy between 0 and 3""")
def ray_footprints(read):
    """Segments of no length, with the cells beside theirs, within a grid of one layer."""
    at = {"x": F.col("e1"), "y": F.col("e2"), "z": F.lit(0.25)}
    rays = _e(read).select(F.col("vec_id").alias("ray"), *(v.alias(f"{p}{a}") for p in "oe" for a, v in at.items()))
    return voxels.ray_cells(rays, size=0.5, around=1, cells=(4, 4, 1))
