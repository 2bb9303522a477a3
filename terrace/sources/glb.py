"""GLB files: meshes, morphs, skins, materials, nodes and animations of a scene as rows.

A file is one binary value, read in one task. Everything that a row refers to
is checked against the bytes that are there; what isn't raises ``ValueError``.
Sparse accessors and buffers or images outside the file are not read.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: magic, kinds of chunk, codes of numbers, numbers in an element, the mode of triangles.
MAGIC, JSON_CHUNK, BIN_CHUNK = b"glTF", b"JSON", b"BIN\x00"
NUMBERS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
TRIANGLES = 4
TEXTURES = ("normalTexture", "occlusionTexture", "emissiveTexture")
PBR_TEXTURES = ("baseColorTexture", "metallicRoughnessTexture")

VERTICES = "path string, mesh int, primitive int, idx long, pos array<double>, normal array<double>, uv array<double>"
FACES = "path string, mesh int, primitive int, material int, idx long, a long, b long, c long"
NODES = "path string, node int, parent int, name string, mesh int, world array<double>"
JOINTS = "path string, skin int, joint long, node int, inverse array<double>"
INFLUENCES = "path string, mesh int, primitive int, idx long, joint long, weight double"
MORPHS = "path string, mesh int, primitive int, target int, idx long, dpos array<double>, dnormal array<double>"
MATERIALS = "path string, material int, name string, colour array<double>, metallic double, roughness double, image int"
KEYS = "path string, animation int, node int, property string, interpolation string, seconds double, value array<double>"


class Glb:
    """The parsed content of one file."""

    def __init__(self, raw: bytes):
        if len(raw) < 20 or raw[:4] != MAGIC or struct.unpack_from("<II", raw, 4) != (2, len(raw)):
            raise ValueError("not a whole file of version 2")
        chunks, at = [], 12
        while at + 8 <= len(raw):
            size, kind = struct.unpack_from("<I4s", raw, at)
            if size > len(raw) - at - 8:
                raise ValueError("a chunk is cut off")
            chunks.append((kind, raw[at + 8 : at + 8 + size]))
            at += 8 + size
        if at != len(raw) or not chunks or chunks[0][0] != JSON_CHUNK:
            raise ValueError("the chunks don't fill the file, or don't start with JSON")
        try:
            self.doc = json.loads(chunks[0][1].rstrip(b" \x00"))
        except ValueError as e:
            raise ValueError("the JSON can't be read") from e
        if not isinstance(self.doc, dict):
            raise ValueError("the JSON is no object")
        self.bin = next((c for k, c in chunks[1:] if k == BIN_CHUNK), b"")
        for part in ("buffers", "images"):
            if any(not x.get("uri", "data:").startswith("data:") for x in self.doc.get(part, [])):
                raise ValueError(f"{part} lie outside the file")

    def part(self, kind: str, i: int) -> dict:
        parts = self.doc.get(kind, [])
        if not isinstance(i, int) or not 0 <= i < len(parts):
            raise ValueError(f"no {kind} {i}")
        return parts[i]

    def view(self, i: int) -> tuple[bytes, int | None]:
        v = self.part("bufferViews", i)
        buffer = self.part("buffers", v["buffer"])
        data = base64.b64decode(buffer["uri"].partition(",")[2]) if "uri" in buffer else self.bin
        at, size = v.get("byteOffset", 0), v["byteLength"]
        if at < 0 or size < 1 or at + size > min(len(data), buffer["byteLength"]):
            raise ValueError(f"view {i} is out of range")
        return data[at : at + size], v.get("byteStride")

    def accessor(self, i: int) -> np.ndarray:
        """Elements x numbers; integers marked as normalised come as fractions."""
        a = self.part("accessors", i)
        if "sparse" in a or a.get("componentType") not in NUMBERS or a.get("type") not in WIDTHS:
            raise ValueError(f"accessor {i} is of a kind that isn't read")
        kind, width, n = np.dtype(NUMBERS[a["componentType"]]), WIDTHS[a["type"]], a["count"]
        size = kind.itemsize * width
        if "bufferView" not in a:
            return np.zeros((n, width), kind)
        data, stride = self.view(a["bufferView"])
        stride, at = stride or size, a.get("byteOffset", 0)
        if n < 1 or at < 0 or stride < size or at + (n - 1) * stride + size > len(data):
            raise ValueError(f"accessor {i} is out of range")
        out = np.ndarray((n, width), kind, data, at, (stride, kind.itemsize))
        if kind.kind == "f" and not np.isfinite(out).all():
            raise ValueError(f"accessor {i} has a number that isn't finite")
        return np.maximum(out / np.iinfo(kind).max, -1.0) if a.get("normalized") else out

    def primitives(self) -> Iterator[tuple[int, int, dict, dict[str, np.ndarray], np.ndarray]]:
        """``(mesh, primitive, declaration, attributes, triangles)``."""
        for m, mesh in enumerate(self.doc.get("meshes", [])):
            for p, primitive in enumerate(mesh["primitives"]):
                if primitive.get("mode", TRIANGLES) != TRIANGLES:
                    raise ValueError("a primitive isn't made of triangles")
                places = {k: self.accessor(v) for k, v in primitive["attributes"].items() if k in ("POSITION", "NORMAL", "TEXCOORD_0")}
                if "POSITION" not in places or len({len(x) for x in places.values()}) > 1:
                    raise ValueError("a primitive lacks positions, or its attributes differ in number")
                n = len(places["POSITION"])
                flat = self.accessor(primitive["indices"]).ravel() if "indices" in primitive else np.arange(n)
                if len(flat) % 3 or flat.max() >= n or flat.min() < 0:
                    raise ValueError("an index is out of range")
                yield m, p, primitive, places, flat.reshape(-1, 3).astype(np.int64)

    def worlds(self) -> list[tuple[int, int | None, np.ndarray]]:
        """``(node, parent, matrix)``, parents first; raises for a node with two parents and for a cycle."""
        nodes = self.doc.get("nodes", [])
        parents: dict[int, int] = {}
        for i, node in enumerate(nodes):
            for child in node.get("children", []):
                self.part("nodes", child)
                if child in parents:
                    raise ValueError(f"node {child} has two parents")
                parents[child] = i
        out, done = [], {}
        todo = [i for i in range(len(nodes)) if i not in parents][::-1]
        while todo:
            i = todo.pop()
            up = parents.get(i)
            done[i] = local_matrix(nodes[i]) if up is None else done[up] @ local_matrix(nodes[i])
            out.append((i, up, done[i]))
            todo += nodes[i].get("children", [])[::-1]
        if len(out) != len(nodes):
            raise ValueError("the nodes have a cycle")
        return out

    def textured(self) -> bool:
        """Whether images lie in the file and a material uses one of its textures."""
        materials = self.doc.get("materials", [])
        bound = any(any(t in m for t in TEXTURES) or any(t in m.get("pbrMetallicRoughness", {}) for t in PBR_TEXTURES) for m in materials)
        return bound and bool(self.doc.get("images")) and bool(self.doc.get("textures"))


def local_matrix(node: dict) -> np.ndarray:
    """A node's own transform: its matrix, given by columns, or translation, rotation (x, y, z, w) and scale."""
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    v = np.array([x, y, z], float)
    across = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]], float)
    out = np.eye(4)
    turn = np.eye(3) * (w * w - v @ v) + 2 * np.outer(v, v) + 2 * w * across
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def _rows(files: DataFrame, schema: str, make: Callable[[str, Glb], Iterator[tuple]]) -> DataFrame:
    """Rows of ``make`` for each ``(path, content)``, at most 10,000 in a batch."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for row in make(path, Glb(raw.as_py())):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return files.select("path", "content").mapInArrow(run, schema)


def vertex_rows(files: DataFrame) -> DataFrame:
    """Vertices of every primitive, in its own coordinates; normal and texture place are null where not given."""

    def make(path: str, g: Glb) -> Iterator[tuple]:
        for m, p, _, places, _ in g.primitives():
            columns = [places[k].tolist() if k in places else [None] * len(places["POSITION"]) for k in ("POSITION", "NORMAL", "TEXCOORD_0")]
            for i, values in enumerate(zip(*columns, strict=True)):
                yield path, m, p, i, *values

    return _rows(files, VERTICES, make)


def triangle_rows(files: DataFrame) -> DataFrame:
    """Triangles of every primitive by their vertices' ``idx``."""

    def make(path: str, g: Glb) -> Iterator[tuple]:
        for m, p, primitive, _, triangles in g.primitives():
            for i, corners in enumerate(triangles.tolist()):
                yield path, m, p, primitive.get("material"), i, *corners

    return _rows(files, FACES, make)


def node_rows(files: DataFrame) -> DataFrame:
    """Nodes with their parent and world matrix, row by row."""

    def make(path: str, g: Glb) -> Iterator[tuple]:
        for i, up, world in g.worlds():
            node = g.part("nodes", i)
            yield path, i, up, node.get("name"), node.get("mesh"), world.ravel().tolist()

    return _rows(files, NODES, make)


def key_rows(files: DataFrame) -> DataFrame:
    """Keys of every animated property of a node; times must not go back."""

    def make(path: str, g: Glb) -> Iterator[tuple]:
        for a, animation in enumerate(g.doc.get("animations", [])):
            for channel in animation["channels"]:
                sampler = animation["samplers"][channel["sampler"]]
                times, values = g.accessor(sampler["input"]).ravel(), g.accessor(sampler["output"])
                if (np.diff(times) < 0).any() or len(values) % len(times):
                    raise ValueError("keys are out of order, or their values differ in number")
                target = channel["target"]
                for t, value in zip(times.tolist(), values.reshape(len(times), -1).tolist(), strict=True):
                    yield path, a, target.get("node"), target["path"], sampler.get("interpolation", "LINEAR"), t, value

    return _rows(files, KEYS, make)


def joint_rows(files: DataFrame) -> DataFrame:
    """Joints of every skin with their node and inverse bind matrix, column by column; the identity where a skin gives none."""

    def make(path: str, g: Glb) -> Iterator[tuple]:
        for s, skin in enumerate(g.doc.get("skins", [])):
            joints = skin["joints"]
            inverse = g.accessor(skin["inverseBindMatrices"]) if "inverseBindMatrices" in skin else np.tile(np.eye(4).ravel(), (len(joints), 1))
            if inverse.shape != (len(joints), 16):
                raise ValueError(f"skin {s} has another number of matrices than of joints")
            for j, (node, m) in enumerate(zip(joints, inverse.tolist(), strict=True)):
                g.part("nodes", node)
                yield path, s, j, node, m

    return _rows(files, JOINTS, make)


def influence_rows(files: DataFrame) -> DataFrame:
    """What joints move each vertex, with weights above 0 that add up to 1."""

    def make(path: str, g: Glb) -> Iterator[tuple]:
        for m, p, primitive, places, _ in g.primitives():
            given = primitive["attributes"]
            if ("JOINTS_0" in given) != ("WEIGHTS_0" in given):
                raise ValueError("joints come without weights, or weights without joints")
            if "JOINTS_0" not in given:
                continue
            joints, weights = g.accessor(given["JOINTS_0"]), np.asarray(g.accessor(given["WEIGHTS_0"]), float)
            if joints.shape != weights.shape or joints.shape != (len(places["POSITION"]), 4) or weights.min() < 0:
                raise ValueError("joints or weights don't belong to the vertices")
            total = weights.sum(axis=1, keepdims=True)
            weights = np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)
            for i, k in zip(*np.nonzero(weights), strict=True):
                yield path, m, p, int(i), int(joints[i, k]), float(weights[i, k])

    return _rows(files, INFLUENCES, make)


def morph_rows(files: DataFrame) -> DataFrame:
    """How far every target of a primitive moves each vertex, and its normal where given."""

    def make(path: str, g: Glb) -> Iterator[tuple]:
        for m, p, primitive, places, _ in g.primitives():
            for t, target in enumerate(primitive.get("targets", [])):
                moved = {k: g.accessor(target[k]) for k in ("POSITION", "NORMAL") if k in target}
                if any(x.shape != (len(places["POSITION"]), 3) for x in moved.values()):
                    raise ValueError("a target doesn't belong to the vertices")
                columns = [moved[k].tolist() if k in moved else [None] * len(places["POSITION"]) for k in ("POSITION", "NORMAL")]
                for i, values in enumerate(zip(*columns, strict=True)):
                    yield path, m, p, t, i, *values

    return _rows(files, MORPHS, make)


def material_rows(files: DataFrame) -> DataFrame:
    """Materials with their base colour, how metallic and rough they are, and the image of their colours."""

    def make(path: str, g: Glb) -> Iterator[tuple]:
        for i, material in enumerate(g.doc.get("materials", [])):
            look = material.get("pbrMetallicRoughness", {})
            image = None
            if "baseColorTexture" in look:
                image = g.part("textures", look["baseColorTexture"]["index"]).get("source")
                if image is not None:
                    g.part("images", image)
            colour = [float(x) for x in look.get("baseColorFactor", (1, 1, 1, 1))]
            yield path, i, material.get("name"), colour, float(look.get("metallicFactor", 1)), float(look.get("roughnessFactor", 1)), image

    return _rows(files, MATERIALS, make)
