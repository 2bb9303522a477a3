"""GLB files and asset directories, made here."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.sources import assets, codecs, glb

H = "0" * 64


def packed(doc, data):
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    data += b"\x00" * (-len(data) % 4)
    body = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(data), b"BIN\x00") + data
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def scene(**more):
    """A square of two triangles, interleaved with normals, on a turned child of a moved node, with one animation."""
    rows = np.array([[x, y, 0, 0, 0, 1] for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))], "<f4").tobytes()
    index = np.array([0, 1, 2, 0, 2, 3], "<u2").tobytes()
    keys = np.array([0, 2], "<f4").tobytes() + np.array([[0, 0, 0], [1, 2, 3]], "<f4").tobytes()
    views = [(0, 96, 24), (96, 12, None), (108, 32, None)]
    doc = {
        "asset": {"version": "2.0"},
        "buffers": [{"byteLength": 140}],
        "bufferViews": [{"buffer": 0, "byteOffset": a, "byteLength": n} | ({"byteStride": s} if s else {}) for a, n, s in views],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 4},
            {"bufferView": 0, "byteOffset": 12, "componentType": 5126, "type": "VEC3", "count": 4},
            {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 6},
            {"bufferView": 2, "componentType": 5126, "type": "SCALAR", "count": 2},
            {"bufferView": 2, "byteOffset": 8, "componentType": 5126, "type": "VEC3", "count": 2},
        ],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "NORMAL": 1}, "indices": 2, "material": 0}]}],
        "nodes": [{"name": "root", "translation": [1, 2, 3], "children": [1]}, {"mesh": 0, "rotation": [0, 0, math.sqrt(0.5), math.sqrt(0.5)], "scale": [2, 1, 1]}],
        "animations": [{"channels": [{"sampler": 0, "target": {"node": 1, "path": "translation"}}], "samplers": [{"input": 3, "output": 4}]}],
        "materials": [{"pbrMetallicRoughness": {"baseColorTexture": {"index": 0}}}],
        "textures": [{"source": 0}],
        "images": [{"uri": "data:image/png;base64,AA=="}],
    } | more
    return packed(doc, rows + index + keys)


def test_glb_rows(spark):
    files = spark.createDataFrame([("a", bytearray(scene())), ("b", bytearray(packed({"asset": {}}, b"")))], "path string, content binary")
    vertices = glb.vertex_rows(files).orderBy("idx").collect()
    assert [v.pos for v in vertices] == [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]] and vertices[0].normal == [0, 0, 1] and vertices[0].uv is None
    assert [(t.a, t.b, t.c, t.material) for t in glb.triangle_rows(files).orderBy("idx").collect()] == [(0, 1, 2, 0), (0, 2, 3, 0)]
    root, child = glb.node_rows(files).orderBy("node").collect()
    assert (root.name, root.parent, child.parent, child.mesh) == ("root", None, 0, 0)
    # x is doubled, then turned by a quarter to y, then moved
    assert np.allclose(np.reshape(child.world, (4, 4)) @ [1, 0, 0, 1], [1, 4, 3, 1])
    assert [(k.seconds, k.value, k.interpolation) for k in glb.key_rows(files).orderBy("seconds").collect()] == [(0, [0, 0, 0], "LINEAR"), (2, [1, 2, 3], "LINEAR")]


@pytest.mark.parametrize(
    "raw",
    [
        b"",
        scene()[:-4],
        b"glTX" + scene()[4:],
        scene(images=[{"uri": "a.png"}]),
        scene(bufferViews=[{"buffer": 0, "byteOffset": 100, "byteLength": 96}]),
        scene(accessors=[{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 5}] * 3),
        scene(meshes=[{"primitives": [{"attributes": {"POSITION": 0}, "mode": 1}]}]),
        scene(meshes=[{"primitives": [{"attributes": {"NORMAL": 1}}]}]),
    ],
)
def test_glb_that_is_wrong(raw):
    with pytest.raises(ValueError):
        list(glb.Glb(raw).primitives())


def test_glb_nodes_that_are_wrong():
    for nodes in ([{"children": [1]}, {"children": [0]}], [{"children": [2]}, {"children": [2]}, {}], [{"children": [7]}]):
        with pytest.raises(ValueError):
            glb.Glb(scene(nodes=nodes)).worlds()


def camera(**more):
    pose = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    return {"id": "c", "sourceId": "s", "image": "a/b.png", "width": 4, "height": 3, "intrinsics": [1, 1, 2, 1.5], "cameraToWorld": pose, "confidence": 1} | more


def asset(root, *, mesh=None, cameras=None, confidence=None, **more):
    root.mkdir(parents=True)
    provider = {"name": "p", "version": "1", "inputSha256": H, "configurationSha256": H}
    doc = {
        "schemaVersion": 1, "name": root.name, "coordinateSystem": assets.AXES, "metersPerUnit": 1.0, "mesh": "m.glb", "cameras": "c.json",
        "geometryProvider": provider, "appearanceProvider": provider, "confidence": {"kind": "uniform", "value": 0.5},
    } | more
    (root / assets.MANIFEST).write_text(json.dumps(doc))
    (root / "m.glb").write_bytes(mesh or scene())
    (root / "c.json").write_text(json.dumps({"schemaVersion": 1, "cameras": [camera()] if cameras is None else cameras}))
    if confidence is not None:
        (root / "v.bin").write_bytes(codecs.encode_confidence(np.array(confidence)))


def test_assets(spark, tmp_path):
    own = {"kind": "per-vertex", "file": "v.bin"}
    asset(tmp_path / "sound")
    asset(tmp_path / "feet", metersPerUnit=0.3048)
    asset(tmp_path / "up", mesh=scene(), cameras=[camera(image="../x.png")])
    asset(tmp_path / "bare", mesh=scene(materials=[{}]))
    asset(tmp_path / "away", cameras=[camera(), camera()])
    for name, values in (("each", [0, 0.5, 1, 1]), ("short", [1.0])):
        asset(tmp_path / name, confidence=values)
        path = tmp_path / name / assets.MANIFEST
        path.write_text(json.dumps(json.loads(path.read_text()) | {"confidence": own}))
    (tmp_path / "each" / "more.json").write_text("{")
    asset(tmp_path / "text")
    (tmp_path / "text" / assets.MANIFEST).write_text("no JSON")
    got = {r.root.rsplit("/", 1)[-1]: r for r in assets.assets(spark, str(tmp_path)).collect()}
    assert {k: r.codes for k, r in got.items()} == {
        "sound": [], "each": [], "feet": ["manifest"], "up": ["cameras"], "bare": ["mesh"], "away": ["cameras"], "short": ["confidence"],
        "text": ["manifest", "mesh", "cameras"],
    }
    r = got["sound"]
    assert (r.name, r.cameras, r.vertices, r.triangles, r.materials, r.images, r.confidence) == ("sound", 1, 4, 2, 1, 1, 0.5)
    assert got["each"].confidence is None
    assert assets.assets(spark, str(tmp_path)).where(F.size("codes") == 0).count() == 2


def rigged(**more):
    """Three vertices with two joints and a target that moves them."""
    parts = [
        np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4"), np.array([[0, 1, 0, 0], [1, 0, 0, 0], [1, 1, 0, 0]], "u1"), np.array([[3, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0]], "<f4"),
        np.array([np.eye(4).ravel(), 2 * np.eye(4).ravel()], "<f4"), np.array([[0, 0, 1], [0, 0, 2], [0, 0, 3]], "<f4"),
    ]
    views, at = [], 0
    for x in parts:
        views.append({"buffer": 0, "byteOffset": at, "byteLength": x.nbytes})
        at += x.nbytes
    kinds = [(5126, "VEC3", 3), (5121, "VEC4", 3), (5126, "VEC4", 3), (5126, "MAT4", 2), (5126, "VEC3", 3)]
    doc = {
        "buffers": [{"byteLength": at}],
        "bufferViews": views,
        "accessors": [{"bufferView": k, "componentType": c, "type": t, "count": n} for k, (c, t, n) in enumerate(kinds)],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "JOINTS_0": 1, "WEIGHTS_0": 2}, "targets": [{"POSITION": 4}]}]}],
        "nodes": [{}, {}],
        "skins": [{"joints": [1, 0], "inverseBindMatrices": 3}, {"joints": [0]}],
        "materials": [{"name": "m", "pbrMetallicRoughness": {"baseColorFactor": [1, 0, 0, 1], "metallicFactor": 0, "baseColorTexture": {"index": 0}}}, {}],
        "textures": [{"source": 0}],
        "images": [{"uri": "data:image/png;base64,AA=="}],
    } | more
    return packed(doc, b"".join(x.tobytes() for x in parts))


def test_skins_morphs_and_materials(spark):
    files = spark.createDataFrame([("a", bytearray(rigged()))], "path string, content binary")
    joints = glb.joint_rows(files).orderBy("skin", "joint").collect()
    assert [(j.skin, j.joint, j.node, j.inverse[0]) for j in joints] == [(0, 0, 1, 1.0), (0, 1, 0, 2.0), (1, 0, 0, 1.0)]
    held = sorted((r.idx, r.joint, r.weight) for r in glb.influence_rows(files).collect())
    assert held == [(0, 0, 0.75), (0, 1, 0.25), (1, 1, 1.0)]
    assert [(r.target, r.idx, r.dpos, r.dnormal) for r in glb.morph_rows(files).orderBy("idx").collect()] == [(0, k, [0, 0, k + 1.0], None) for k in range(3)]
    one, two = glb.material_rows(files).orderBy("material").collect()
    assert (one.name, one.colour, one.metallic, one.roughness, one.image) == ("m", [1, 0, 0, 1], 0, 1, 0) and (two.name, two.colour, two.image) == (None, [1, 1, 1, 1], None)
    for make, bad in (
        (glb.joint_rows, {"skins": [{"joints": [0], "inverseBindMatrices": 3}]}),
        (glb.joint_rows, {"skins": [{"joints": [7]}]}),
        (glb.influence_rows, {"meshes": [{"primitives": [{"attributes": {"POSITION": 0, "JOINTS_0": 1}}]}]}),
        (glb.morph_rows, {"meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "targets": [{"POSITION": 3}]}]}]}),
        (glb.material_rows, {"textures": []}),
    ):
        with pytest.raises(Exception, match="ValueError"):
            make(spark.createDataFrame([("a", bytearray(rigged(**bad)))], "path string, content binary")).collect()
