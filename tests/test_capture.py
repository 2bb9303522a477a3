"""Readers of recordings, journals, meshes that are kept up, and folds, against plain Python and hand-made files."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import geometry as g
from terrace.functions import quantile
from terrace.operators import align, fold, images, meshes, rigs, scan, tables, tiles, voxels
from terrace.operators.tables import Versions
from terrace.plans import gates
from terrace.sources import manifest, ply, records, scans
from terrace.streaming import fusion, journal, meshing


def test_trajectory(spark):
    lines = ["1.5 0 0 1.5707963267948966 1 2 3", "", "2 0 0 0 0 0 0", "3 0 0 0 0 0", "4 0 nan 0 0 0 0"]
    got = {r.line: r for r in scans.trajectory(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert len(got) == 4 and [got[x].code for x in (lines[2], lines[3], lines[4])] == [None, "fields", "fields"]
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    want = np.eye(4)
    want[:3, :3], want[:3, 3] = turn.T @ np.diag([1, -1, -1]), -turn.T @ [1, 2, 3]
    # the pose's axes are those of a camera with y up that looks along -z
    assert np.allclose(np.array(got[lines[0]].pose).reshape(4, 4).T[:3, 3], want[:3, 3])
    assert np.allclose(np.array(got[lines[0]].pose).reshape(4, 4).T[:3, :3], want[:3, :3])
    pose = spark.createDataFrame([(got[lines[0]].pose,)], "m array<double>").select(g.rigid_code(F.col("m")).alias("c"), g.image_pose(F.col("m")).alias("p")).first()
    w, x, y, z = (pose.p[k] for k in "wxyz")
    matrix = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    assert pose.c is None and np.allclose(matrix, turn.T) and np.allclose([pose.p.tx, pose.p.ty, pose.p.tz], want[:3, 3])


def test_image_files_and_manifests(spark, tmp_path):
    for name in ("b/2.JPG", "a/1.png", "a/.png", "c.txt", "deep/er/x.nef", "jpg"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"xy")
    assert [(r.name, r.bytes) for r in scans.image_files(spark, str(tmp_path / "in")).collect()] == [("a/1.png", 2), ("b/2.JPG", 2), ("deep/er/x.nef", 2)]
    (tmp_path / "m").mkdir()
    for name, text in {"a": '{"schemaVersion": 1, "id": "a", "note": "n"}', "b": '{"schemaVersion": 2, "id": "b"}', "c": '{"schemaVersion": 1, "id": "x"}', "d": "no", "schema": "{}"}.items():
        (tmp_path / "m" / f"{name}.json").write_text(text)
    got = scans.manifests(spark, str(tmp_path / "m"), 1, "schemaVersion int, id string, note string").collect()
    assert {r.name: r.code for r in got} == {"a": None, "b": "version", "c": "identity", "d": "json"}


def lidar_frame(k, **change):
    plane = lambda n, w, h, kind, size: {"path": f"{n}/{k}.bin", "sha256": hashlib.sha256(n.encode()).hexdigest(), "width": w, "height": h, "rowStrideBytes": w * size, "pixelFormat": kind, "byteCount": w * size * h}
    frame = {
        "frameID": k, "timestampNanoseconds": 1000 * k, "arTimestampSeconds": k / 4, "cameraTrackingState": "normal", "nativeImageOrientation": "landscapeRight", "mirrored": False,
        "calibration": {"imageWidth": 8, "imageHeight": 6, "depthWidth": 4, "depthHeight": 3},
        "luma": plane("luma", 8, 6, "y8", 1), "chroma": plane("chroma", 4, 3, "cbcr8x2", 2), "depth": plane("depth", 4, 3, "depth-f32-metres", 4),
        "cameraToWorld": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, k, 0, 0, 1],
    }
    for path, value in change.items():
        at = frame
        *above, last = path.split("__")
        for a in above:
            at = at[a]
        at[last] = value
    return frame


def test_lidar_manifest(spark, tmp_path):
    wrong = [
        (None, {}), ("tracking", {"cameraTrackingState": "limited"}), ("orientation", {"mirrored": True}), ("orientation", {"nativeImageOrientation": "portrait"}), ("time", {"arTimestampSeconds": -1}),
        ("incomplete", {"chroma": None}), ("plane", {"depth__pixelFormat": "f16"}), ("plane", {"luma__sha256": "00"}), ("plane", {"luma__path": "../x"}), ("sizes", {"calibration__depthWidth": 5}),
        ("pose", {"cameraToWorld": [2] + [0] * 15}), ("pose", {"cameraToWorld": [1.0]}), ("exposure", {"exposure": {"durationSeconds": -1, "exposureOffsetEV": 0}}), (None, {"exposure": {"durationSeconds": 1, "exposureOffsetEV": 0}}),
        ("frame-order", {"frameID": 3}), ("time-order", {"timestampNanoseconds": 1}), ("plane", {"confidence": {"path": "c"}}), (None, {}),
    ]
    frames = [lidar_frame(k + 1, **c) for k, (_, c) in enumerate(wrong)]
    frames[-1]["frameID"], frames[-1]["timestampNanoseconds"] = 100, 10**6
    body = {"sourceID": "s", "coordinateSystem": scans.CONVENTIONS, "frames": frames}
    (tmp_path / "a.json").write_text(json.dumps(body))
    got = scans.lidar_frames(spark, str(tmp_path / "a.json")).orderBy("place").collect()
    assert [r.code for r in got] == [c for c, _ in wrong]
    assert (got[0].at_ns, got[0].frame_id, got[0].pose.tx) == (250_000_000, 1, 1.0) and abs(got[0].pose.x) == pytest.approx(1)
    assert got[1].pose is None
    (tmp_path / "b.json").write_text(json.dumps(body | {"coordinateSystem": scans.CONVENTIONS | {"depthUnit": "feet"}}))
    assert {r.code for r in scans.lidar_frames(spark, str(tmp_path / "b.json")).collect()} == {"conventions"}


def test_replay(spark):
    df = spark.createDataFrame([(s, k, s == "b" and k == 3) for s in "ab" for k in range(6)], "s string, k int, bad boolean")
    got = sorted((r.s, r.k) for r in scans.replay(df, "s", "k", 1, 4, F.col("bad")).collect())
    assert got == [("a", k) for k in range(1, 5)] + [("b", 1), ("b", 2)]
    assert scans.replay(df, "s", "k").count() == 12


def test_splat_columns(spark):
    names = [*ply.SPLAT, *(f"f_rest_{k}" for k in range(9)), "nx"]
    assert ply.splat_columns(names) == (9, ["nx"])
    for bad in (names[1:], [*names, "x"], [n for n in names if n != "f_rest_3"], [*names, "f_rest_9"]):
        with pytest.raises(ValueError):
            ply.splat_columns(bad)
    row = spark.createDataFrame([(0, *map(float, range(len(names))))], ["idx", *names])
    assert ply.splats(row).columns == ["idx", *ply.SPLAT, "rest"] and ply.splats(row).first().rest == [float(k) for k in range(14, 23)]


def test_records_and_journal(spark, tmp_path):
    path = str(tmp_path / "r.json")
    assert records.read_json(spark, path) is None
    for value in ({"a": 1}, {"a": "two\nlines", "b": None}):
        records.write_json(spark, path, value)
        assert records.read_json(spark, path) == value
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["r.json"]
    folder = str(tmp_path / "j")
    put = journal.journal(folder, "frame_id")
    for batch, ids in enumerate(([3, 1, 2], [], [4])):
        for _ in range(2):  # a batch that comes again is not written twice
            put(spark.createDataFrame([(i, 10 * i) for i in ids], "frame_id long, timestamp_ns long"), batch)
    (tmp_path / "j" / "open-000000003").mkdir()
    (tmp_path / "j" / "open-000000003" / "part").write_text('{"frame_id": 9}\n')
    assert sorted(map(tuple, journal.frames(spark, folder, "frame_id long, timestamp_ns long").collect())) == [(i, 10 * i) for i in range(1, 5)]
    assert records.read_json(spark, f"{folder}/checkpoint.json") == {"batch": 2, "frames": 4, "last": 4}


def test_meshing_by_batches(spark, tmp_path):
    def field(radius):
        points = spark.range(17 * 17 * 17).select(*(F.pmod(F.floor(F.col("id") / 17**k), F.lit(17)).alias(a) for k, a in enumerate("xyz")))
        d = F.sqrt(sum(((F.col(a) - 8.1) * (F.col(a) - 8.1) for a in "xyz"), F.lit(0.0)))
        return points.withColumn("distance", d - radius)

    now = {"r": 4.0}
    versions = Versions(spark, str(tmp_path / "v"))
    run = meshing.mesher(lambda: field(now["r"]), versions, 4, (0.0, 0.0, 0.0), 1.0)
    blocks = spark.range(125).select(*(F.pmod(F.floor(F.col("id") / 5**k), F.lit(5)).alias(f"b{a}") for k, a in enumerate("xyz")))
    run(blocks, 0)
    run(blocks.limit(0), 0)
    first = versions.read().count()
    now["r"] = 5.0
    run(blocks, 1)
    want = voxels.surface(field(5.0), (0.0, 0.0, 0.0), 1.0).count()
    assert versions.latest() == 1 and versions.read().count() == want != first > 0


def test_matched_rigs_raise(spark):
    matches = spark.createDataFrame([("a", 1), ("b", 9), ("z", 1)], "image string, frame long")
    cameras, poses = spark.createDataFrame([("a",), ("b",)], "image string"), spark.createDataFrame([(1,)], "frame long")
    out = rigs.matched(matches, cameras, poses, "image", "frame")
    assert {r.image: r.code for r in out.collect()} == {"a": None, "b": "no-pose", "z": "no-camera"}
    with pytest.raises(ValueError):
        rigs.checked(out)
    assert rigs.checked(out.where("code is null")).columns == ["frame", "image"]


def test_candidates_in_blocks(spark, monkeypatch):
    rows = [(k, *np.random.default_rng(k).normal(size=9).tolist()) for k in range(20)]
    t = spark.createDataFrame(rows, ["id", *(f"{a}{k}" for k in range(3) for a in "xyz")])
    turn = [1.0 if k in (0, 4, 8) else 0.0 for k in range(9)]
    cams = spark.createDataFrame([(c, *turn, 0.0, 0.0, 3.0 + c, 4.0, 4.0, 4.0, 4.0, 0.0, 0.0, -3.0 - c, 8, 8) for c in range(7)], ["cam", *(f"r{k}" for k in range(9)), "t0", "t1", "t2", "fx", "fy", "cx", "cy", "ex", "ey", "ez", "width", "height"])
    whole = sorted((r.id, r.cam) for r in rigs.candidates(t, cams, "cam", 0.2).collect())
    real = rigs.blocks
    monkeypatch.setattr(rigs, "blocks", lambda table, identity: real(table, identity, 2))
    assert sorted((r.id, r.cam) for r in rigs.candidates(t, cams, "cam", 0.2).collect()) == whole != []


def test_skin_beyond_the_last_joint(spark):
    v = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 1.0, 0.0, 0.0)], "k long, x double, y double, z double")
    joints = spark.createDataFrame([(0, np.eye(4).T.ravel().tolist()), (1, [float(x) for x in (2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 0, 0, 1)])], "joint long, m array<double>")
    got = {r.k: (r.x, r.y, r.z) for r in meshes.skinned(v, spark.createDataFrame([(0, 7, 1.0)], "k long, joint long, weight double"), joints, "k").collect()}
    assert got == {0: (7.0, 2.0, 3.0), 1: (1.0, 0.0, 0.0)}


def test_fits_agree_and_refuse(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=(40, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn = q * np.sign(np.linalg.det(q))
    t = 1.7 * s @ turn.T + [1, -2, 3]
    df = spark.createDataFrame(np.hstack([s, t]).tolist(), [f"{p}{a}" for p in "st" for a in "xyz"])
    row = align.moments(df).first()
    for fit in (align.fitted(row), align.horn(row)):
        assert fit.scale == pytest.approx(1.7) and np.allclose(fit.rotation, turn) and np.allclose(fit.translation, [1, -2, 3])
    for fit in (align.fitted, align.horn):
        with pytest.raises(ValueError):
            fit(row, (2.0, 3.0))
        with pytest.raises(ValueError):
            fit(align.moments(df.limit(2)).first())
        with pytest.raises(ValueError):
            fit(align.moments(df.selectExpr("sx", "sx as sy", "sx as sz", "tx", "ty", "tz")).first())
        with pytest.raises(ValueError):
            fit(align.moments(df.selectExpr("sx", "sy", "sz", "1d as tx", "1d as ty", "1d as tz")).first())


def test_long_folds_cost_no_square(spark):
    """One key's many rows stream through a task."""
    import time

    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") % 7).cast("double").alias("m"))
    start = time.perf_counter()
    got = fold.keyframes(df, ["k"], ["id"], F.col("m"), F.lit(None), {"id": F.col("id")}, 2, 30, 1.5, 10.0)
    rows = got.agg(F.count("*").alias("n"), F.count_if("selected").alias("s"), F.max("gap").alias("g")).first()
    assert time.perf_counter() - start < 60 and rows.n == n and rows.s > 0 and rows.g >= 2
    assert got.columns == ["k", "id", "selected", "reason", "gap"]


def test_folds_keep_null_keys_and_measures(spark):
    policy = {"pending": 2, "depth": 0.2, "clipped": 0.9, "sharpness": 0.2, "interval": 1.0, "motion": 1.0, "stationary": 5.0}
    rows = [(None, 0.0, 0.0, None), (None, 2.0, None, None), (None, 4.0, 3.0, 3), ("a", None, 1.0, None), ("a", 9.0, 1.0, 0), ("a", 20.0, None, 0)]
    df = spark.createDataFrame(rows, "k string, t double, p double, q int")
    none = F.lit(None).cast("double")
    out = fold.admission(df, ["k"], ["t"], F.col("t"), F.col("p"), F.col("q"), none, none, none, {"at": F.col("t")}, policy).collect()
    assert {(r.k, r["at"]): r.reason for r in out} == {
        (None, 0.0): "first-frame", (None, 2.0): "insufficient-motion", (None, 4.0): "writer-pressure", ("a", None): "first-frame", ("a", 9.0): "first-frame", ("a", 20.0): "stationary-refresh",
    }


def test_fusion_leaves_out_what_is_no_observation(spark):
    batch = spark.createDataFrame([("a", 1, 5.0, 0.0), ("a", 2, float("nan"), 1.0), ("a", 3, 2.0, 1.0), ("b", 1, 1.0, 0.0)], "k string, i int, v double, w double")
    got = fusion.fused(None, batch, ["k"], ["i"], "v", "w", 5.0).collect()
    assert [(r.k, r.mean, r.weight, r.observations) for r in got] == [("a", 2.0, 1.0, 1)]


def test_scans_order_by_any_columns(spark):
    rows = [("x", k % 5, k) for k in range(400)] + [("w", 0, 1)]
    df = spark.createDataFrame(rows, "s string, a int, b int").repartition(7)
    got = {(r.s, r.a, r.b): r.n for r in scan.numbered(df, ["s", "a", "b"], "n").collect()}
    assert got == {row: k for k, row in enumerate(sorted(rows))}


def test_report_has_all_rows(spark):
    assert len(gates.markdown(spark.range(3000), ["id"]).splitlines()) == 3002


def test_dilation_over_rounds(spark):
    px = spark.createDataFrame([(0, x, 0, 5.0 if x == 0 else None) for x in range(6)], "image int, x int, y int, value double")
    got = {r.x: r.value for r in images.dilated(px, 3).collect()}
    assert got == {0: 5.0, 1: 5.0, 2: 5.0, 3: 5.0, 4: None, 5: None}


def test_clusters_at_the_ends(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.01), (7.99, 7.99, 1e9)], "x double, y double, z double")
    made = df.select(tiles.cluster_of(F.col("x"), F.col("y"), F.col("z"), (8, 8), (0.1, 100.0), (4, 4, 4)).alias("c")).collect()
    assert [r.c for r in made] == [0, 63]


def test_slerp_goes_the_shorter_way(spark):
    half = math.sqrt(0.5)
    df = spark.createDataFrame([(1.0, 0.0, -half, -half, 0.5), (1.0, 0.0, 1.0, 0.0, 0.3)], "a double, b double, c double, d double, t double")
    zero = F.lit(0.0)
    out = g.slerp((F.col("a"), F.col("b"), zero, zero), (F.col("c"), F.col("d"), zero, zero), F.col("t"))
    rows = df.select(out[0].alias("w"), out[1].alias("x")).collect()
    assert (rows[0].w, rows[0].x) == (pytest.approx(math.cos(math.pi / 8)), pytest.approx(math.sin(math.pi / 8))) and (rows[1].w, rows[1].x) == (1.0, 0.0)


def test_ray_cells_by_small_steps(spark):
    """Each cell that many points of a segment lie in is there, and none that is not next to one."""
    rng = np.random.default_rng(5)
    rays = [(k, *map(float, rng.uniform(-3, 3, 6))) for k in range(40)] + [(40, 0.0, 0.0, 0.0, -2.0, 0.0, 0.0), (41, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5), (42, 1.0, float("inf"), 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rays, "ray int, ox double, oy double, oz double, ex double, ey double, ez double")
    got = {}
    for r in voxels.ray_cells(df, size=0.7).collect():
        got.setdefault(r.ray, []).append((r.cx, r.cy, r.cz))
    assert 42 not in got and got[41] == [(0, 0, 0)] and sorted(got[40]) == [(-3, 0, 0), (-2, 0, 0), (-1, 0, 0), (0, 0, 0)]
    for k, *p in rays[:40]:
        o, e = np.array(p[:3]), np.array(p[3:])
        seen = {tuple(map(int, c)) for c in np.floor((o + (e - o) * np.linspace(0, 1, 20_001)[:, None]) / 0.7)}
        assert seen <= set(got[k]) and len(got[k]) == len(set(got[k])) == 1 + int(np.abs(np.floor(o / 0.7) - np.floor(e / 0.7)).sum())


def test_budgets_raise(spark):
    df = spark.range(10)
    assert tables.within(df, {"rows": (F.count("*"), 10)}).count() == 10
    with pytest.raises(ValueError, match="rows is 10, above its budget of 9"):
        tables.within(df, {"rows": (F.count("*"), 9)})
    assert tables.within(df.limit(0), {"sum": (F.sum("id"), 0)}).count() == 0


def test_ply_ranges(spark, tmp_path):
    """Vertices and triangles in ranges of rows; a polygon and a cut-off file are refused."""
    spark.dataSource.register(ply.PlyDataSource)
    path = str(tmp_path / "a.ply")
    vertices, triangles = [(float(k), -float(k), 0.5) for k in range(1000)], [(k, k + 1, k + 2) for k in range(998)]
    ply.write_ply(path, vertices, triangles)
    read = lambda **o: spark.read.format("ply").options(path=path, rowsPerPartition="37", **o).load()
    got = read(element="vertex")
    assert got.rdd.getNumPartitions() == 28
    assert sorted(map(tuple, got.collect())) == [(k, *v) for k, v in enumerate(vertices)]
    with pytest.raises(Exception, match="without reading|no element|cut off"):
        read(element="edge").collect()
    faces = str(tmp_path / "f.ply")
    head = b"ply\nformat binary_little_endian 1.0\nelement face 4\nproperty list uchar int vertex_indices\nend_header\n"
    row = lambda n: bytes([n]) + b"".join(int(k).to_bytes(4, "little") for k in range(n))
    for body, want in ((row(3) * 4, 4), (row(3) * 3 + row(4), None), (row(3) * 3, None)):
        with open(faces, "wb") as f:
            f.write(head + body)
        df = spark.read.format("ply").options(path=faces, element="face", rowsPerPartition="2").load()
        if want:
            assert sorted(map(tuple, df.collect())) == [(k, 0, 1, 2) for k in range(4)]
        else:
            with pytest.raises(Exception, match="triangles|cut off"):
                df.collect()


@pytest.mark.parametrize("kind,q", [("linear", 0.9), ("upper_median", 0.5), ("ceil_rank", 0.25), ("rounded", 0.33), ("truncated", 1.0)])
def test_ranked_over_ranges(spark, kind, q):
    """One group over many ranges, small groups, a null group, ties and nulls, against the array form."""
    rng = np.random.default_rng(7)
    rows = [("big", float(x)) for x in rng.normal(size=3000)] + [(None, float(k % 3)) for k in range(50)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.q for r in quantile.ranked(df, ["g"], "v", q, kind, "q").collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(quantile.exact(F.collect_list("v"), q, kind).alias("q")).where("q is not null").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert quantile.ranked(df, [], "v", q, kind, "q").count() == 1 and quantile.ranked(df.limit(0), [], "v", q, kind, "q").first().q is None


def test_long_journal(spark, tmp_path, monkeypatch):
    """A journal in several parts, and a tail longer than a step back from its end."""
    path = str(tmp_path / "j.ndjson")
    lines = "".join(json.dumps({"frame_id": k, "timestamp_ns": 10 * k}) + "\n" for k in range(1, 3001))
    for tail in ("", '{"frame', "x" * 300):
        with open(path, "w") as f:
            f.write(lines + tail)
        assert manifest.tail_bytes(spark, path, 64) == len(tail)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        try:
            rows, cut_off = manifest.recovered(spark, path)
            assert cut_off == len(tail) and sorted(map(tuple, rows.collect())) == [(k, 10 * k) for k in range(1, 3001)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for bad in (lines + '{"frame_id": 3002, "timestamp_ns": 99999}\n', lines + '{"frame_id": 3001, "timestamp_ns": 1}\n', "no\n" + lines):
        with open(path, "w") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            manifest.recovered(spark, path)
    open(path, "w").close()
    assert manifest.recovered(spark, path)[0].count() == 0
