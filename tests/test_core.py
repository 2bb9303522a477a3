"""Operators against analytic truth, plain Python and DuckDB."""

import hashlib
import json
import math
import random
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import geometry, quantile
from terrace.operators import align, fold, graph, images, nearest, scan, tables, temporal, tiles, voxels
from terrace.plans import gates, registry
from terrace.plans.ledger import Ledger, job_fingerprint, last_json_line
from terrace.sources import chunks, codecs, manifest, ply, sfm
from terrace.streaming import admission, fusion

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(x):
        if isinstance(x, (list, tuple)):
            return str([show(v) for v in x])
        return f"{float(x):.6g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(show(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = registry.queries()[name](spark, DATA)
    found = con.execute(registry.oracle_sql()[name])
    want = _norm(found.fetchall(), [c[0] for c in found.description])
    assert _norm([tuple(r) for r in df.collect()], df.columns) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_saturating_mean_depends_on_order_only_once_saturated(spark):
    rows = [("a", i, v, w) for i, (v, w) in enumerate([(1.0, 2.0), (3.0, 2.0), (float("nan"), 1.0), (5.0, 4.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "k string, i int, v double, w double")
    r = fold.saturating_mean(df, ["k"], ["i"], "v", "w", 5.0, single=False).first()
    mean, weight = 0.0, 0.0
    for v, w in [(1.0, 2.0), (3.0, 2.0), (5.0, 4.0)]:
        grown = min(5.0, weight + w)
        part = min(w, grown)
        mean, weight = (mean * (grown - part) + v * part) / grown, grown
    assert (r.mean, r.weight, r.observations) == (pytest.approx(mean), 5.0, 3)


@pytest.mark.parametrize("kind,q,want", [("upper_median", 0.5, 3.0), ("linear", 0.5, 2.5), ("truncated", 0.9, 3.0), ("ceil_rank", 0.95, 10.0), ("rounded", 0.5, 3.0)])
def test_quantiles(spark, kind, q, want):
    df = spark.createDataFrame([(x,) for x in (10.0, 1.0, 3.0, 2.0)], "x double")
    assert quantile.ranked(df, [], "x", q, kind, "q").first()["q"] == want
    assert df.agg(quantile.exact(F.collect_list("x"), q, kind).alias("q")).first()["q"] == want


def test_as_of_ties_and_tolerance(spark):
    left = spark.createDataFrame([("k", 1.0), ("k", 5.0), ("k", 20.0), ("z", 1.0)], "k string, t double")
    right = spark.createDataFrame([("k", 0.0, 1), ("k", 2.0, 2), ("k", 6.0, 3), ("k", 6.0, 4)], "k string, t double, v int")
    got = {(r.k, r.t): r.matched for r in temporal.nearest(left, right, ["k"], "t", "v", 1.0).collect()}
    assert got == {("k", 1.0): 2, ("k", 5.0): 3, ("k", 20.0): None, ("z", 1.0): None}


def test_interpolation(spark):
    left = spark.createDataFrame([(1, -1.0), (1, 1.0), (1, 2.0), (1, 9.0)], "k int, t double")
    right = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 0.2)], "k int, t double, v double")
    got = {r.t: r.value_at for r in temporal.interpolated(left, right, ["k"], "t", "v").collect()}
    assert got == {-1.0: 0.0, 1.0: pytest.approx(0.1), 2.0: pytest.approx(0.2), 9.0: pytest.approx(0.2)}


def test_grid_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 3)), np.concatenate([rng.normal(size=(40, 3)), [[30.0, 30, 30]]])
    frame = lambda p: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "i int, x double, y double, z double")
    got = {r.i: (r.neighbour, r.distance) for r in nearest.grid_neighbours(frame(a), frame(b).withColumnRenamed("i", "j"), "i", "j", ["x", "y", "z"], 0.3).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(d.argmin(axis=1).tolist()))


def test_scan_and_runs(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    got = {r.i: r.s for r in scan.exclusive_scan(spark.createDataFrame(rows, "i long, n long"), ["i"], "n", "s").collect()}
    total = 0
    for i, n in rows:
        assert got[i] == total
        total += n
    runs = {r.k: (r.first, r.last) for r in scan.runs(spark.createDataFrame([(3,), (1,), (3,)], "k int"), "k", ["k"]).collect()}
    assert runs == {1: (0, 1), 3: (1, 3)}


def sphere(spark, n=18, r=0.6):
    h = 2 / n
    p = "({} * %f - 1)" % h
    grid = spark.range((n + 1) ** 3).select((F.col("id") % (n + 1)).alias("x"), (F.expr(f"id div {n + 1}") % (n + 1)).alias("y"), F.expr(f"id div {(n + 1) ** 2}").alias("z"))
    return grid.withColumn("distance", F.expr(f"sqrt({p.format('x')} * {p.format('x')} + {p.format('y')} * {p.format('y')} + {p.format('z')} * {p.format('z')}) - {r}")), h


def test_surface_of_a_sphere(spark):
    field, h = sphere(spark)
    triangles = voxels.surface(field, (-1.0, -1.0, -1.0), h)
    vertices, faces = voxels.welded(triangles.cache())
    row = graph.topology(faces).first()
    assert (row.boundary, row.non_manifold, row.euler) == (0, 0, 2)
    radius = [math.sqrt(v.x**2 + v.y**2 + v.z**2) for v in vertices.collect()]
    assert max(abs(x - 0.6) for x in radius) < h
    t = triangles.first().points
    a, b, c = (np.array(t[k : k + 3]) for k in (0, 3, 6))
    assert np.cross(b - a, c - a) @ (a + b + c) > 0


@pytest.mark.parametrize("case", range(0, 256, 5))
def test_cell_cases_close(case):
    """A cell inside a shell of positive corners has a closed surface, whatever its signs."""
    values = {(x, y, z): 1.0 for x in range(4) for y in range(4) for z in range(4)}
    for k in range(8):
        values[(1 + (k & 1), 1 + (k >> 1 & 1), 1 + (k >> 2))] = -1.0 if case >> k & 1 else 1.0
    use = {}
    for cell in ((x, y, z) for x in range(3) for y in range(3) for z in range(3)):
        at = [tuple(c + (k >> a & 1) for a, c in enumerate(cell)) for k in range(8)]
        inside = [values[p] < 0 for p in at]
        for loop in voxels.cell_loops(sum(x << k for k, x in enumerate(inside))):
            ids = [tuple(at[c] for c in voxels.EDGES[e]) for e in loop]
            assert all(inside[p] != inside[q] for p, q in (voxels.EDGES[e] for e in loop)) and len(set(loop)) == len(loop) >= 3
            for i in range(len(ids)):
                e = (ids[i - 1], ids[i])
                use[e] = use.get(e, 0) + 1
    # each side of a loop is passed once, and once the other way by a neighbour
    assert all(n == 1 and use.get(e[::-1]) == 1 for e, n in use.items()) and bool(use) == bool(case)


def test_cell_table():
    table = dict(voxels.cell_table())
    assert {k % 256 for k in table} == set(range(1, 255)) and len(table) < 1000
    for key, loops in table.items():
        crossed = sum((key >> p ^ key >> q) & 1 for p, q in voxels.EDGES)
        assert sum(map(len, loops)) == crossed
    corner = [voxels.EDGES[e] for e in voxels.cell_loops(1)[0]]
    assert [q for _, q in corner] in ([1, 2, 4], [2, 4, 1], [4, 1, 2])  # seen from outside, x to y to z


def solid(spark, distance, n=65, h=0.01, truncation=0.04):
    """A truncated distance field in single precision, from numpy columns of places around the middle.

    Places are multiples of ``h``: grid points that lie on the surface get a
    distance of zero, as they do where products and sums are rounded once.
    """
    z, y, x = (g.ravel() for g in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    d = np.clip(distance(*(h * (c - n // 2) for c in (x, y, z))) / truncation, -1, 1).astype("f4")
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z, "distance": d}))


@pytest.mark.parametrize("resolved, counts", [(True, (14942, 29880)), (False, (7470, 14936))])
def test_surface_has_the_known_counts(spark, resolved, counts):
    field = solid(spark, lambda x, y, z: np.sqrt(x * x + y * y + z * z) - 0.2)
    vertices, faces = voxels.welded(voxels.surface(field, (-0.32,) * 3, 0.01, resolved).cache())
    row = graph.topology(faces).first()
    assert (row.vertices, row.faces) == counts and (row.boundary, row.non_manifold, row.euler) == (0, 0, 2)
    off = sorted(abs(math.sqrt(v.x**2 + v.y**2 + v.z**2) - 0.2) for v in vertices.collect())
    assert off[int(0.95 * len(off))] < (0.000163 if resolved else 0.000052)


@pytest.mark.parametrize("resolved", [True, False])
def test_surface_of_an_ambiguous_face(spark, resolved):
    inside = {(2, 1, 1), (2, 2, 2)}
    rows = [(x, y, z, -0.5 if (x, y, z) in inside else 1.0) for x in range(5) for y in range(5) for z in range(5)]
    faces = voxels.welded(voxels.surface(spark.createDataFrame(rows, "x int, y int, z int, distance double"), (0.0,) * 3, 1.0, resolved))[1]
    row = graph.topology(faces).first()
    assert (row.boundary, row.non_manifold, row.euler) == (0, 0, 4)


def test_surface_needs_whole_cells(spark):
    rows = [(k & 1, k >> 1 & 1, k >> 2, float("nan") if k == 7 else k - 0.5) for k in range(8)]
    schema = "x int, y int, z int, distance double"
    assert voxels.surface(spark.createDataFrame(rows, schema), (0.0,) * 3, 1.0).isEmpty()
    assert voxels.surface(spark.createDataFrame(rows[:7], schema), (0.0,) * 3, 1.0).isEmpty()
    assert voxels.surface(spark.createDataFrame([], schema), (0.0,) * 3, 1.0).isEmpty()
    whole = [*rows[:7], (1, 1, 1, 1.0), (1, 1, 1, 1.0), (0, 0, 0, None)]
    assert voxels.surface(spark.createDataFrame(whole, schema), (0.0,) * 3, 1.0, False).count() == 1


def test_ray_cells(spark):
    rays = [(1, 0.5, 0.5, 0.5, 3.5, 0.5, 0.5), (2, 0.5, 0.5, 0.5, 2.5, 2.5, 2.5), (3, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rays, "ray int, ox double, oy double, oz double, ex double, ey double, ez double")
    got = sorted((r.ray, r.cx, r.cy, r.cz) for r in voxels.ray_cells(df).collect())
    assert got == [(1, k, 0, 0) for k in range(4)] + [(2, k, k, k) for k in range(3)]


def test_bounds(spark):
    points = spark.createDataFrame([(k / 10, k / 20, 0.5) for k in range(101)], "x double, y double, z double")
    b = voxels.bounds(points, ["x", "y", "z"], 0.1, 0.01, 64)
    assert b["voxel"] == pytest.approx((10 * 0.99 + 0.2) / 63, rel=0.02) and b["truncation"] == pytest.approx(4 * b["voxel"])
    with pytest.raises(ValueError):
        voxels.bounds(points.limit(3), ["x", "y", "z"], 0.1, 0.01, 64)


def test_alignment_recovers_a_transform(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=(12, 3))
    rot = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    t = 2.5 * s @ rot.T + np.array([4.0, -3, 7])
    t[3] += 5
    t[9] -= 4
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(s, t, strict=True))], "i int, sx double, sy double, sz double, tx double, ty double, tz double")
    start = align.consensus(df, "i", 0.05, trials=64)
    fit = align.robust_fit(df, start, 0.05, 0.01)
    assert fit.scale == pytest.approx(2.5, abs=1e-6) and np.allclose(fit.rotation, rot, atol=1e-6)
    assert fit.residual(df).where("residual < 0.001").count() == 10
    line = df.select("i", *(F.col("sx").alias(f"{p}{a}") for p in "st" for a in "xyz"))
    with pytest.raises(ValueError):
        align.fit(line)


def test_graphs(spark):
    uses = spark.createDataFrame([(0, 7, "write"), (1, 7, "read"), (2, 7, "write"), (2, 7, "read"), (3, 7, "read"), (4, 8, "write")], "pass long, resource long, mode string")
    edges = {(r["pass"], r.needs) for r in graph.dependencies(uses).collect()}
    assert edges == {(1, 0), (2, 0), (2, 1), (3, 2)}
    assert graph.live(edges, [3]) == {0, 1, 2, 3} and graph.schedule(range(5), edges) == [0, 4, 1, 2, 3]
    with pytest.raises(ValueError):
        graph.schedule([1, 2], [(1, 2), (2, 1)])
    assert "n0 -> n1" in graph.dot_text([(0, "a"), (1, "b")], {(1, 0)})
    bad = spark.createDataFrame([(1, None, "r"), (2, 3, "a"), (3, 2, "b")], "id int, parent int, name string")
    with pytest.raises(ValueError):
        graph.paths(bad)


def test_quaternions(spark):
    h = math.sqrt(0.5)
    q, v = tuple(F.lit(x) for x in (h, 0.0, 0.0, h)), tuple(F.lit(x) for x in (1.0, 0.0, 0.0))
    row = spark.range(1).select(*geometry.rotate(q, v), geometry.quaternion_of(geometry.matrix_of(q)).alias("b"), geometry.orientation_error(q, tuple(-x for x in q)).alias("e")).first()
    assert [row[0], row[1], row[2]] == pytest.approx([0, 1, 0], abs=1e-12)
    assert [row.b.w, row.b.z] == pytest.approx([h, h]) and row.e == pytest.approx(0, abs=1e-5)


def test_versions_keep_state_on_failure(spark, tmp_path):
    v = tables.Versions(spark, str(tmp_path / "t"))
    assert v.publish(spark.range(3), -1) == 0
    with pytest.raises(ValueError):
        v.publish(spark.range(10), 0, most_rows=5)
    with pytest.raises(ValueError):
        v.publish(spark.range(1), -1)
    assert v.latest() == 0 and v.read().count() == 3


def test_tiles_and_light_cells(spark):
    df = spark.createDataFrame([(1, 4.0, 4.0, 1.0), (2, 8.0, 8.0, 1.0), (3, -9.0, 0.0, 1.0)], "i int, x double, y double, r double")
    got = sorted((r.i, r.tile) for r in tiles.tiles(df, F.col("x"), F.col("y"), F.col("r"), 2, 2, 8.0).collect())
    assert got == [(1, 0), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_gradient(spark):
    px = images.pixels_of(spark.createDataFrame([(1, [0.0, 1.0, 4.0, 9.0])], "i int, v array<double>"), "i", "v", 4)
    assert [r.gx for r in images.gradient(px).orderBy("x").collect()] == [1.0, 2.0, 4.0, 5.0]


def test_issues_and_report(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "i int, v int")
    got = gates.issues(df, {"null": ("error", F.col("v").isNull()), "low": ("warning", F.col("v") < 9)}, ["i"]).collect()
    assert sorted((r.severity, r.code, r.i) for r in got) == [("error", "null", 2), ("warning", "low", 1)]
    assert gates.markdown(df.where("i = 1"), ["i", "v"]).splitlines()[-1] == "| 1 | 5 |"


def test_ply_round_trip(spark, tmp_path):
    path = str(tmp_path / "m.ply")
    ply.write_ply(path, [(0, 0, 0), (1, 0, 0), (0, 1, 2)], [(0, 1, 2)])
    spark.dataSource.register(ply.PlyDataSource)
    v = spark.read.format("ply").option("rowsPerPartition", 2).load(path)
    assert [tuple(r) for r in v.orderBy("idx").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 2)]
    assert tuple(spark.read.format("ply").option("element", "face").load(path).first()) == (0, 0, 1, 2)
    (tmp_path / "bad.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nend_header\n")
    with pytest.raises(ValueError):
        ply.read_header(str(tmp_path / "bad.ply"))


def test_chunks(spark, tmp_path):
    path = str(tmp_path / "p.pkg")
    made = [chunks.Chunk(1, b"meta", True), chunks.Chunk(5, bytes(range(256)) * 40, False, True), chunks.Chunk(6, bytes(1 << 20), False, True)]
    chunks.write_chunks(path, made)
    raw = (tmp_path / "p.pkg").read_bytes()
    back = chunks.read_chunks(raw)
    assert [c.content for c in back] == [c.content for c in made] and [c.compress for c in back] == [False, True, False]
    assert {(r.type, len(r.content)) for r in chunks.chunk_rows(spark, path).collect()} == {(1, 4), (5, 10240), (6, 1 << 20)}
    for cut, rule in [(raw[:40], "size"), (b"x" + raw[1:], "magic"), (raw[:-1] + b"\x01", "content hash"), (raw[:70] + b"!" + raw[71:], "content hash")]:
        with pytest.raises(chunks.Corrupt, match=rule):
            chunks.read_chunks(cut)
    with pytest.raises(chunks.Corrupt, match="unknown required"):
        chunks.read_chunks(raw, known={5, 6})


def test_manifest(spark, tmp_path):
    good = b"\x00" * 32
    (tmp_path / "planes").mkdir()
    (tmp_path / "planes" / "a.bin").write_bytes(good)
    plane = {"path": "a.bin", "width": 4, "height": 8, "row_stride": 4, "bytes_per_pixel": 1, "byte_count": 32, "sha256": hashlib.sha256(good).hexdigest()}
    frames = [{"frame_id": 1, "timestamp_ns": 5, "planes": [plane]}, {"frame_id": 2, "timestamp_ns": 4, "planes": [plane]}]
    frames += [{"frame_id": 3, "timestamp_ns": 9, "planes": [plane | {"path": "../x"}, plane | {"row_stride": 3}, plane | {"path": "b.bin"}, plane | {"sha256": "0" * 64}]}]
    (tmp_path / "m.json").write_text(json.dumps({"source_id": "s", "frames": frames}))
    got = manifest.checked(spark, manifest.frames(spark, str(tmp_path / "m.json")), str(tmp_path / "planes")).collect()
    assert sorted(str(r.code) for r in got) == sorted(["None", "time-order", "path", "stride", "missing", "file-hash"])


def test_journal(spark, tmp_path):
    path = tmp_path / "j.ndjson"
    path.write_text('{"frame_id":1,"timestamp_ns":5}\n{"frame_id":2,"timestamp_ns":5}\n{"frame_id":')
    rows, tail = manifest.recovered(spark, str(path))
    assert rows.count() == 2 and tail == 12
    path.write_text('{"frame_id":1,"timestamp_ns":5}\n{"frame_id":3,"timestamp_ns":5}\n')
    with pytest.raises(ValueError):
        manifest.recovered(spark, str(path))


def test_sfm_text(spark, tmp_path):
    (tmp_path / "i.txt").write_text("# c\n1 1 0 0 0 1 2 3 7 a.jpg\n1 2 -1 3 4 5\n2 2 0 0 0 0 0 0 7 ../b.jpg\n\n")
    (tmp_path / "p.txt").write_text("# c\n5 1 2 3 9 8 7 0.5 1 0 2 4\n")
    (tmp_path / "c.txt").write_text("7 PINHOLE 640 480 500 500 320 240\n8 NEW 1 1 1\n")
    img = {r.image_id: r for r in sfm.images(spark, str(tmp_path / "i.txt")).collect()}
    assert (img[1].name, img[1].observations, img[1].code, img[2].code) == ("a.jpg", 2, None, "quaternion")
    p = sfm.points(spark, str(tmp_path / "p.txt")).first()
    assert [(t.image_id, t.point2d) for t in p.track] == [(1, 0), (2, 4)] and p.error == 0.5
    assert [r.code for r in sfm.cameras(spark, str(tmp_path / "c.txt")).orderBy("camera_id").collect()] == [None, "unknown-model"]


POLICY = {"pending": 2, "depth": 0.2, "clipped": 0.95, "sharpness": 0.25, "interval": 1 / 15, "motion": 0.015, "stationary": 0.5}


def test_stream_admission(spark, tmp_path):
    samples = [(0, 0, 0, 1, 0, 1), (0.02, 0.1, 0, 1, 0, 1), (0.1, 0.02, 0, 1, 0, 1), (0.2, 0.02, 0, 1, 0, 1), (0.7, 0.02, 0, 1, 0, 1)]
    samples += [(0.8, 9, 0, 1, 0.99, 1), (0.9, 9, 0, 0.1, 0, 1), (1.0, 9, 0, 1, 0, 0.1), (1.1, 9, 3, 1, 0, 1)]
    want = ["first-frame", "rate-limited", "useful-motion", "insufficient-motion", "stationary-refresh", "extreme-exposure", "unusable-depth", "unusably-soft", "writer-pressure"]
    kind = "source string, at double, position double, pending int, depth double, clipped double, sharpness double"
    rows = [("s", float(a), float(p), q, float(d), float(c), float(s)) for a, p, q, d, c, s in samples]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    run = admission.admitted(stream, POLICY).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.reason for r in spark.table("admitted").orderBy("at").collect()] == want
    df = spark.createDataFrame(rows, kind)
    cols = [F.col(c) for c in ("at", "position", "pending", "depth", "clipped", "sharpness")]
    batch = fold.admission(df, ["source"], ["at"], *cols, {"at_": F.col("at")}, POLICY)
    assert [r.reason for r in batch.orderBy("at_").collect()] == want


def test_stream_fusion_equals_batch(spark, tmp_path):
    rows = [(k % 3, i, float(i * k % 7), 1.0 + k % 2) for i in range(9) for k in range(5)]
    kind = "k int, i int, v double, w double"
    v = tables.Versions(spark, str(tmp_path / "state"))
    put = fusion.publisher(v, keys=["k"], order=["i", "v", "w"], value="v", weight="w", most=6.0)
    for b in range(3):
        part = spark.createDataFrame([r for r in rows if r[1] // 3 == b], kind)
        put(part, b)
        put(part, b)
    df = spark.createDataFrame(rows, kind)
    want = {r.k: (pytest.approx(r.mean), r.weight, r.observations) for r in fold.saturating_mean(df, ["k"], ["i", "v", "w"], "v", "w", 6.0, single=False).collect()}
    assert {r.k: (r.mean, r.weight, r.observations) for r in v.read().collect()} == want


def test_ledger(tmp_path):
    out = tmp_path / "o"
    ledger = Ledger(str(tmp_path / "l"), job_fingerprint(["a"], [("p", 1, "x")]))
    assert ledger.run("one", lambda: out.write_text("x"), [str(out)])
    assert not ledger.run("one", lambda: 1 / 0, [str(out)])
    assert Ledger(str(tmp_path / "l"), "other").done("one") is False
    with pytest.raises(RuntimeError):
        ledger.run("two", lambda: None, [str(tmp_path / "none")])
    assert last_json_line('x\n{"a": 1}\nnot') == {"a": 1}


def test_codecs(spark):
    rows = np.zeros(3, codecs.SPLAT)
    rows["rot"][:, 0], rows["pos"], rows["rest"] = 1, np.arange(9).reshape(3, 3), 2
    raw = codecs.encode_splats(rows, 1)
    back = codecs.decode_splats(raw)
    assert len(raw) == 32 + 3 * 256 and (back["pos"] == rows["pos"]).all() and back["rest"][:, 9:].sum() == 0
    got = codecs.splat_rows(spark.createDataFrame([(raw,)], "content binary")).orderBy("idx").collect()
    assert got[2].pos == [6.0, 7.0, 8.0] and len(got[0].rest) == 9
    for bad in (raw[:-1], b"x" + raw[1:], raw[:20]):
        with pytest.raises(ValueError):
            codecs.decode_splats(bad)
    v = np.zeros(3, codecs.VERTEX)
    a, b = codecs.decode_mesh(codecs.encode_mesh(v, np.array([[0, 1, 2]])))
    assert len(a) == 3 and b.tolist() == [[0, 1, 2]]
    with pytest.raises(ValueError):
        codecs.encode_mesh(v, np.array([[0, 1, 3]]))
    assert codecs.decode_confidence(codecs.encode_confidence(np.array([0, 0.5]))).tolist() == [0, 0.5]


def test_remeshing_equals_a_full_surface(spark):
    before, h = sphere(spark, 12, 0.5)
    moved = before.withColumn("distance", F.when((F.col("x") < 6) & (F.col("y") < 6), F.col("distance") - 0.15).otherwise(F.col("distance")))
    key = [F.floor(F.split("cell", ",")[i].cast("long") / 6).alias(k) for i, k in enumerate(("bx", "by", "bz"))]
    full = lambda f: voxels.surface(f, (-1.0, -1.0, -1.0), h).select(*key, "cell", "k", "ids", "points")
    dirty = spark.createDataFrame([(0, 0, z) for z in range(3)], "bx long, by long, bz long")
    got = voxels.remeshed(moved, full(before), dirty, 6, (-1.0, -1.0, -1.0), h)
    want = full(moved)
    assert sorted((r.cell, r.k, r.ids) for r in got.collect()) == sorted((r.cell, r.k, r.ids) for r in want.collect())
    vertices, faces = voxels.welded(full(before))
    for r in voxels.vertex_normals(vertices, faces).join(vertices, "id").limit(40).collect():
        n, p = np.array([r.nx, r.ny, r.nz]), np.array([r.x, r.y, r.z])
        assert n @ p / np.linalg.norm(p) > 0.8


def test_neighbours_in_blocks(spark, monkeypatch):
    """Sides beyond what a task may hold, in 64 dimensions, with ties and a repeated id, against brute force."""
    monkeypatch.setattr(nearest, "MOST_HELD", 9)
    monkeypatch.setattr(nearest, "MOST_PAIRS", 100, raising=False)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(23, 64)), rng.normal(size=(40, 64))
    b[17] = b[3]
    frame = lambda p, first: spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(p)], "i long, p array<double>")
    right = frame(b, 500).unionByName(frame(b[:1], 500))
    got = {r.i: (r.neighbour, r.distance) for r in nearest.neighbours(frame(a, 0), right, "i", "i", "p", blocks=2).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert {i: n for i, (n, _) in got.items()} == {i: 500 + k for i, k in enumerate(d.argmin(axis=1).tolist())}
    assert all(got[i][1] == pytest.approx(d[i].min()) for i in got)


def test_components_of_all_orders(spark):
    """Against union-find over the whole table."""
    rows = spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for c, o in rows:
        x, y = sorted((find(c), find(10**12 + o // 40)))
        parent[y] = x
    got = {r.id: r.component for r in registry.queries()["connected_components"](spark, DATA).collect()}
    assert got == {x: find(x) for x in parent}


def test_pairs_of_all_groups_in_blocks(spark):
    df = spark.createDataFrame([(i, i % 3 if i else None) for i in range(40)], "i long, g int")
    got = [(r.i, r.i2) for r in nearest.paired(df, "g", "i", block=4).collect()]
    assert sorted(got) == [(i, j) for i in range(1, 40) for j in range(i + 1, 40) if i % 3 == j % 3]
    assert {r.label for r in registry.queries()["max_pair_angle"](spark, DATA).collect()} == set(range(10))


def test_consensus_draws_from_all_pairs(spark):
    """The 100,000 smallest identities are outliers; most pairs agree."""
    at = [F.rand(k) for k in range(6)]
    df = spark.range(260_000).select(F.col("id").alias("i"), *(at[k].alias(f"s{a}") for k, a in enumerate("xyz")), *(at[3 + k].alias(f"_o{a}") for k, a in enumerate("xyz")))
    good = [F.when(F.col("i") < 100_000, 50 * F.col(f"_o{a}")).otherwise(2 * F.col(f"s{a}") + 1).alias(f"t{a}") for a in "xyz"]
    found = align.consensus(df.select("i", "sx", "sy", "sz", *good), "i", 1e-3, trials=32)
    assert found.scale == pytest.approx(2) and np.allclose(found.rotation, np.eye(3)) and np.allclose(found.translation, 1)


def test_grid_neighbours_where_points_are_dense(spark, monkeypatch):
    """More rows than a block holds, copies with ties, far points and rows without a place; no row per pair is made."""
    monkeypatch.setattr(nearest, "MOST_HELD", 300)
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.normal(size=(1500, 3)) / 8, np.tile(0.5, (400, 3)), [[90.0, -90, 1]]])
    b = np.concatenate([rng.normal(size=(1500, 3)) / 8, np.tile(0.5, (400, 3)), [[0.1, 700, 1]]])
    frame = lambda p: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)] + [(9000, None, 0.0, 0.0), (9001, 0.0, float("nan"), 0.0)], "i int, x double, y double, z double")
    out = nearest.grid_neighbours(frame(a), frame(b).withColumnRenamed("i", "j"), "i", "j", ["x", "y", "z"], 0.25)
    got = {r.i: (r.neighbour, r.distance) for r in out.collect()}
    d = np.sqrt(sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(3)))
    assert got == {i: (int(k), float(d[i, k])) for i, k in enumerate(d.argmin(axis=1))}
    assert nearest.grid_neighbours(frame(a), frame(b).where("i < 0"), "i", "i", ["x", "y", "z"], 0.25).isEmpty()
    assert nearest.grid_neighbours(frame(a).where("i < 0"), frame(b), "i", "i", ["x", "y", "z"], 0.25).isEmpty()


def test_grid_neighbours_make_no_row_per_pair(spark):
    """All points in one cell of the former grid, whose join made a row for each of 625 million pairs and ran for minutes."""
    p = spark.range(50_000).select("id", *(((F.xxhash64("id", F.lit(k)) % 100_000) / 500_000).alias(a) for k, a in enumerate("xyz")))
    stop = threading.Timer(40, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert nearest.grid_neighbours(p.where("id < 25000"), p.where("id >= 25000"), "id", "id", ["x", "y", "z"], 1.0).count() == 25_000
    finally:
        stop.cancel()


def _in_time(spark, seconds: float, run):
    stop = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        return run()
    finally:
        stop.cancel()


def _vectors(spark, tmp_path, n: int) -> np.ndarray:
    """``n`` vectors of 64 numbers as the table ``embeddings``; one in nine is a copy, and the first is null."""
    v = np.random.default_rng(12).normal(size=(n, 64)).astype(np.float32)
    v[::9] = v[4]
    import pyarrow as pa
    import pyarrow.parquet as pq

    lists = pa.array([None, *v[1:].tolist()], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists, "label": np.arange(n, dtype=np.int32) % 10}), tmp_path / "embeddings.parquet")
    return v.astype(float)


@pytest.mark.parametrize("name", ["chamfer_fscore", "nn_accuracy_completeness"])
def test_metrics_of_many_vectors(spark, tmp_path, name):
    """16,000 vectors, copies across the sides among them: the former plan took minutes for their 64 million pairs."""
    n = 16_000
    v = _vectors(spark, tmp_path, n)
    x, y = v[2:n:2], v[1:n:2]
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
    f, g = d.min(axis=1), d.min(axis=0)
    row = _in_time(spark, 25, lambda: registry.queries()[name](spark, str(tmp_path)).collect())[0]
    if name == "chamfer_fscore":
        p, r = (f <= 9).mean(), (g <= 9).mean()
        want = ((f.mean() + g.mean()) / 2, p, r, 2 * p * r / (p + r))
    else:
        want = (f.mean(), g.mean())
    assert tuple(row) == pytest.approx(want, abs=2e-6)


def test_neighbours_both_ways_are_exact(spark, monkeypatch):
    """Distances far below the products' error, ids of two kinds and ties, in several blocks, against plain differences."""
    monkeypatch.setattr(nearest, "MOST_HELD", 20)
    rng = np.random.default_rng(4)
    a = 1e4 + np.concatenate([rng.normal(size=(40, 16)), rng.integers(0, 4, (30, 16)) * 1e-9])
    b = np.concatenate([a[::3] + rng.integers(-2, 3, (24, 16)) * 1e-9, a[5:15], a[5:15]])
    x = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(a)], "i long, p array<double>")
    y = spark.createDataFrame([(f"{i:03}", p.tolist()) for i, p in enumerate(b)] + [("bad", None), ("nan", [float("nan")] * 16)], "j string, p array<double>")
    forward, backward = nearest.neighbours_both_ways(x, y, "i", "j", "p", blocks=2)
    d = np.sqrt(sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(16)))
    assert {r.i: (int(r.neighbour), r.distance) for r in forward.collect()} == {i: (int(k), float(d[i, k])) for i, k in enumerate(d.argmin(axis=1))}
    assert {int(r.j): (r.neighbour, r.distance) for r in backward.collect()} == {j: (int(k), float(d[k, j])) for j, k in enumerate(d.argmin(axis=0))}
