"""Baking, splat kernels and JSON settings against plain Python."""

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import splats
from terrace.operators import bake
from terrace.sources import codecs, settings

CORNERS = ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz")


def _covered(t, width, height):
    """Depth by pixel of one triangle, by testing every pixel of the image."""
    (x0, y0, z0), (x1, y1, z1), (x2, y2, z2) = (t[k : k + 3] for k in (0, 3, 6))
    area = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
    if abs(area) <= 1e-12 or min(z0, z1, z2) <= 1e-8:
        return {}
    out = {}
    for py in range(height):
        for px in range(width):
            m = np.array([[x0, x1, x2], [y0, y1, y2], [1, 1, 1]], float)
            w = np.linalg.solve(m, [px + 0.5, py + 0.5, 1])
            if (w >= 0).all():
                out[px, py] = 1 / (w[0] / z0 + w[1] / z1 + w[2] / z2)
    return out


def test_depth_map_takes_the_nearest_triangle_at_each_pixel(spark):
    r = random.Random(3)
    rows = [(k % 2, *(v for _ in range(3) for v in (r.uniform(-4, 20), r.uniform(-4, 14), r.uniform(0.5, 5)))) for k in range(24)]
    rows += [(0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0, 3.0, 3.0, 1.0), (1, 0.0, 0.0, -1.0, 9.0, 0.0, 1.0, 0.0, 9.0, 1.0), (1, None, 0.0, 1.0, 9.0, 0.0, 1.0, 0.0, 9.0, 1.0)]
    want = {}
    for camera, *t in rows:
        for p, depth in ({} if None in t else _covered(t, 16, 10)).items():
            want[camera, *p] = min(depth, want.get((camera, *p), math.inf))
    found = bake.depth_map(spark.createDataFrame(rows, "camera int, " + CORNERS), ["camera"], 16, 10).collect()
    got = {(x.camera, x.px, x.py): x.depth for x in found}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_visible_looks_at_neighbours_and_needs_a_surface(spark):
    depth = spark.createDataFrame([(0, 2, 2, 1.0), (0, 3, 2, 2.0)], "camera int, px int, py int, depth double")
    near = bake.nearest_around(depth, ["camera"], 8, 8)
    points = [(1, 0, 2, 2, 1.01), (2, 0, 3, 2, 2.0), (3, 0, 4, 2, 2.0), (4, 0, 6, 6, 1.0), (5, 1, 2, 2, 1.0)]
    df = spark.createDataFrame(points, "id int, camera int, px int, py int, z double")
    assert sorted(x.id for x in bake.visible(df, near, ["camera"], 0.02).collect()) == [1, 3]
    assert bake.nearest_around(depth.limit(0), ["camera"], 8, 8).count() == 0


def test_best_views_and_score(spark):
    df = spark.createDataFrame([(7, c, s) for c, s in ((3, 0.5), (1, 0.5), (2, 0.9), (5, 0.1), (4, 0.1))], "t int, c int, s double")
    assert [x.c for x in bake.best_views(df, "t", "c", "s").orderBy("rank").collect()] == [2, 1, 3, 4]
    score = spark.range(1).select(bake.view_score(F.lit(0.5), F.lit(10.0), F.lit(50.0), F.lit(2.0), F.lit(100.0), F.lit(100.0)).alias("s")).first().s
    assert math.isclose(score, 0.5 * 0.8 / 4)


def test_gains_meet_the_median_of_medians(spark):
    rows = [("a", v) for v in (0.1, 0.2, 0.4)] + [("b", v) for v in (0.4, 0.8)] + [("c", 0.0), ("d", None)]
    got = {x.camera: x.gain for x in bake.exposure_gains(spark.createDataFrame(rows, "camera string, l double"), "camera", "l", 4.0).collect()}
    # upper medians .2, .8 and 1e-5; the upper median of these is .2
    assert got.keys() == {"a", "b", "c"}
    assert math.isclose(got["a"], 1.0) and math.isclose(got["b"], 0.25) and got["c"] == 4.0


def test_blend_and_atlas(spark):
    df = spark.createDataFrame([(1, 0.2, 2.0, 1.0), (1, 0.8, 1.0, 3.0), (2, 0.5, 1.0, 0.0)], "texel int, r double, gain double, score double")
    assert [(x.texel, round(x.r, 9)) for x in bake.blended(df, ["texel"], ["r"], "gain", "score").collect()] == [(1, 0.7)]
    assert bake.atlas(5, 64, 2) == (3, 21, 17)
    cells = bake.atlas_cells(spark.range(5), "id", 5, 64, 2).orderBy("id").collect()
    assert [(x.tile_x, x.tile_y) for x in cells] == [(2, 2), (23, 2), (44, 2), (2, 23), (23, 23)]
    for n, size in ((0, 64), (5, 9)):
        with pytest.raises(ValueError):
            bake.atlas(n, size, 2)


def test_covariance_against_numpy(spark):
    r = np.random.default_rng(5)
    q = r.normal(size=4)
    q /= np.linalg.norm(q)
    s, at = r.uniform(0.1, 1, 3), np.array([0.3, -0.2, 2.0])
    w, x, y, z = q
    m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    jacobian = np.array([[50 / at[2], 0, -50 * at[0] / at[2] ** 2], [0, 60 / at[2], -60 * at[1] / at[2] ** 2]])
    view = m.T
    want = jacobian @ view @ m @ np.diag(s * s) @ m.T @ view.T @ jacobian.T + 0.3 * np.eye(2)
    lit = lambda v: tuple(F.lit(float(c)) for c in v)
    xx, xy, yy = splats.projected_covariance(splats.covariance(lit(q), lit(s)), tuple(lit(v) for v in view), lit(at), F.lit(50.0), F.lit(60.0))
    got = spark.range(1).select(xx.alias("xx"), xy.alias("xy"), yy.alias("yy"), splats.radius(xx, xy, yy).alias("r")).first()
    assert np.allclose([got.xx, got.xy, got.yy], [want[0, 0], want[0, 1], want[1, 1]])
    assert math.isclose(got.r, 3 * math.sqrt(np.linalg.eigvalsh(want)[-1]))


def test_harmonics_are_orthonormal(spark):
    r = np.random.default_rng(1)
    rows = [tuple(map(float, v)) for v in r.normal(size=(40000, 3))]
    terms = splats.basis((F.col("x"), F.col("y"), F.col("z")), 3)
    names = [f"b{k}" for k in range(16)]
    base = spark.createDataFrame(rows, "x double, y double, z double").select(*(t.alias(n) for t, n in zip(terms, names, strict=True)))
    got = base.agg(*(F.avg(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i in range(16) for j in range(i, 16))).first()
    worst = max(abs(4 * math.pi * got[f"m{i}_{j}"] - (i == j)) for i in range(16) for j in range(i, 16))
    assert worst < 0.06


def test_settings(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    key = {"time": 0.0, "position": [0, 0, 0], "rotation": [0, 0, 0, 2], "verticalFovRadians": 0.9, "exposureEv": 0.0}
    path = put("path.json", {"schemaVersion": 1, "keyframes": [key, key | {"time": 2.0}, key | {"time": 2.0}, key | {"position": [1]}, key | {"time": 3.0, "rotation": [0, 0, 0, 0]}]})
    rows = settings.camera_paths(spark, path).orderBy("place").collect()
    assert [x.code for x in rows] == [None, None, "time-order", "fields", "rotation"] and rows[0].rotation == [0, 0, 0, 1]
    for value, code in (("{", "malformed"), ({"schemaVersion": 2, "keyframes": [key]}, "version"), ({"schemaVersion": 1, "keyframes": []}, "empty")):
        assert [x.code for x in settings.camera_paths(spark, put("bad.json", value)).collect()] == [code]

    one = {"id": "a", "width": 4, "height": 3, "fx": 1.0, "fy": 1.0, "cx": 2.0, "cy": 1.5}
    good = put("one.json", one | {"distortionModel": "Opencv", "distortion": [0] * 8})
    assert [(x.id, x.code) for x in settings.calibrations(spark, good).collect()] == [("a", None)]
    for change, code in (({"fx": None}, "fields"), ({"fx": -1.0}, "range"), ({"distortion": [0]}, "distortion"), ({"distortionModel": "Fish"}, "distortion-model")):
        assert [x.code for x in settings.calibrations(spark, put("c.json", one | change)).collect()] == [code]

    group = {"id": "a", "relativeDirectory": "a", "device": "d", "lens": "l"}
    listed = [group, group | {"id": "b", "relativeDirectory": "../b"}, group | {"id": "c", "relativeDirectory": "c", "focalLengthMillimetres": -1}, group | {"id": "d"}]
    rows = settings.camera_groups(spark, put("groups.json", {"schemaVersion": 1, "groups": listed})).collect()
    assert {x.id: x.code for x in rows} == {"a": "duplicate", "b": "path", "c": "focal", "d": "duplicate"}

    pairs = [("a.jpg", 1), ("b.jpg", 2), ("b.jpg", 3), ("c.jpg", 0), ("/d.jpg", 4)]
    rows = settings.camera_matches(spark, put("m.json", {"schemaVersion": 1, "pairs": [{"colmapImage": i, "captureFrameId": f} for i, f in pairs]})).collect()
    assert [x.code for x in sorted(rows, key=lambda x: x.frame_id)] == ["fields", None, "not-one-to-one", "not-one-to-one", "path"]


def test_rig_round_trip_and_rejections(spark):
    turn = [0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]
    one = {"id": "a", "source": "s", "image": "x/ü.jpg", "width": 4, "height": 3, "intrinsics": [1.0, 1.0, 2.0, 1.5], "camera_to_world": [float(v) for v in turn], "timestamp_ns": None, "confidence": 0.5}
    cameras = [one, one | {"id": "b", "timestamp_ns": 2**63 + 1}]
    raw = codecs.encode_rig(cameras)
    assert codecs.CAMERA.itemsize == 224 and len(raw) == 64 + 448 + 20 and codecs.decode_rig(raw) == cameras
    got = codecs.rig_rows(spark.createDataFrame([(bytearray(raw),)], "content binary")).collect()
    assert [x.asDict() | {"timestamp_ns": x.timestamp_ns and int(x.timestamp_ns)} for x in got] == cameras
    mirrored = [-v if k in (2, 6, 10) else v for k, v in enumerate(one["camera_to_world"])]
    for bad in ([], [one, one], [one | {"image": "../x"}], [one | {"confidence": 1.1}], [one | {"camera_to_world": mirrored}], [one | {"width": 0}]):
        with pytest.raises(ValueError):
            codecs.encode_rig(bad)
    for bad in (raw[:-1], raw[:40], b"?" + raw[1:], raw[: 64 + 220] + b"\x01" + raw[64 + 221 :]):
        with pytest.raises(ValueError):
            codecs.decode_rig(bad)


@pytest.mark.parametrize("n", [1, 1_200_000])
def test_atlas_cells_of_any_number_of_parts(spark, tmp_path, n):
    """As many rows as the SQL has; 1,200,000 parts leave one usable pixel a cell, which the layout used to refuse."""
    from terrace.plans import registry

    spark.range(n).select((F.col("id") * 3).alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    registry.queries()["atlas_cells"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.sql(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    con.sql(f"create table want as {registry.oracle_sql()['atlas_cells']}")
    con.sql(f"create table got as from '{tmp_path}/out/*.parquet'")
    assert con.sql("select count(*) from got").fetchall() == [(n,)]
    assert con.sql("select count(*) from ((from want except all from got) union all (from got except all from want))").fetchall() == [(0,)]


def test_atlas_without_room(spark):
    assert bake.atlas(30, 20, 1, None) == (6, 3, 1) and bake.atlas(20_000_000, 4096, 1, None) == (4473, 0, -2)
    assert bake.atlas_cells(spark.range(0), "id", 0, 64, 2, least=None).isEmpty()
    with pytest.raises(ValueError):
        bake.atlas_cells(spark.range(30), "id", 30, 20, 1)
