"""Fixed-stride binary records: splats, proxy meshes, confidences and camera rigs, to and from rows.

Every block but a rig's, which has 64 bytes and a table of texts, has a header of 32 bytes (8 of magic, major and minor version u16,
stride u32, rows u64, and two numbers u32 that the kind gives a meaning), then
records of the stride, little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

HEAD = struct.Struct("<8sHHIQII")
#: Coefficients beside the first for each degree of spherical harmonics.
REST = {0: 0, 1: 9, 2: 24, 3: 45}
SPLAT = np.dtype({"names": ["pos", "log_scale", "rot", "opacity_logit", "dc", "rest", "rest_count"], "formats": ["3<f4", "3<f4", "4<f4", "<f4", "3<f4", "45<f4", "<u4"], "itemsize": 256})
VERTEX = np.dtype([("pos", "3<f4"), ("normal", "3<f4"), ("confidence", "<f4"), ("rgba", "<u4")])
MAGIC = {"splats": b"TERRSPL\x00", "mesh": b"TERRMSH\x00", "confidence": b"TERRCNF\x00"}


def _open(kind: str, raw: bytes, stride: int) -> tuple[int, int, int]:
    if len(raw) < HEAD.size:
        raise ValueError("the block is cut off")
    magic, major, _, got, rows, x, y = HEAD.unpack_from(raw)
    if magic != MAGIC[kind] or major != 1 or got != stride:
        raise ValueError(f"not a block of {kind}")
    return rows, x, y


def encode_splats(rows: np.ndarray, degree: int) -> bytes:
    """Records of dtype ``SPLAT``; raises for values that aren't finite or rotations without a length."""
    if degree not in REST or not len(rows):
        raise ValueError("splats need rows and a degree from 0 to 3")
    for name in ("pos", "log_scale", "rot", "opacity_logit", "dc", "rest"):
        if not np.isfinite(rows[name]).all():
            raise ValueError(f"{name} is not finite")
    if (np.linalg.norm(rows["rot"].astype(float), axis=1) < 1e-6).any():
        raise ValueError("a rotation has no length")
    out = np.zeros(len(rows), SPLAT)
    for name in SPLAT.names:
        out[name] = rows[name]
    out["rest_count"] = REST[degree]
    out["rest"][:, REST[degree] :] = 0
    return HEAD.pack(MAGIC["splats"], 1, 0, SPLAT.itemsize, len(out), degree, 0) + out.tobytes()


def decode_splats(raw: bytes) -> np.ndarray:
    rows, degree, _ = _open("splats", raw, SPLAT.itemsize)
    if degree not in REST or len(raw) != HEAD.size + rows * SPLAT.itemsize:
        raise ValueError("size or degree")
    out = np.frombuffer(raw, SPLAT, rows, HEAD.size)
    if (out["rest_count"] != REST[degree]).any():
        raise ValueError("rest count")
    return out


def encode_mesh(vertices: np.ndarray, triangles: np.ndarray) -> bytes:
    """Records of dtype ``VERTEX`` and an array of index triples."""
    flat = np.ascontiguousarray(triangles, "<u4").ravel()
    if len(flat) % 3 or (len(flat) and flat.max() >= len(vertices)):
        raise ValueError("an index is out of range")
    return HEAD.pack(MAGIC["mesh"], 1, 0, VERTEX.itemsize, len(vertices), len(flat), 0) + vertices.astype(VERTEX).tobytes() + flat.tobytes()


def decode_mesh(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, n, _ = _open("mesh", raw, VERTEX.itemsize)
    if len(raw) != HEAD.size + rows * VERTEX.itemsize + 4 * n or n % 3:
        raise ValueError("size")
    flat = np.frombuffer(raw, "<u4", n, HEAD.size + rows * VERTEX.itemsize)
    if n and flat.max() >= rows:
        raise ValueError("an index is out of range")
    return np.frombuffer(raw, VERTEX, rows, HEAD.size), flat.reshape(-1, 3)


def encode_confidence(values: np.ndarray) -> bytes:
    if not ((values >= 0) & (values <= 1)).all():
        raise ValueError("a confidence lies outside 0 to 1")
    return HEAD.pack(MAGIC["confidence"], 1, 0, 4, len(values), 0, 0) + values.astype("<f4").tobytes()


def decode_confidence(raw: bytes) -> np.ndarray:
    rows, _, _ = _open("confidence", raw, 4)
    if len(raw) != HEAD.size + 4 * rows:
        raise ValueError("size")
    return np.frombuffer(raw, "<f4", rows, HEAD.size)


def splat_rows(blocks: DataFrame, column: str = "content") -> DataFrame:
    """``(idx, pos, log_scale, rot, opacity_logit, dc, rest)`` of binary blocks, one task a block."""
    names = ["pos", "log_scale", "rot", "dc", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = decode_splats(raw)
                k = int(rows["rest_count"][0]) if len(rows) else 0
                lists = {n: (rows[n][:, :k] if n == "rest" else rows[n]).tolist() for n in names}
                columns = [pa.array(np.arange(len(rows))), *(pa.array(lists[n], pa.list_(pa.float32())) for n in names[:3])]
                columns += [pa.array(rows["opacity_logit"].copy()), *(pa.array(lists[n], pa.list_(pa.float32())) for n in names[3:])]
                yield pa.RecordBatch.from_arrays(columns, ["idx", "pos", "log_scale", "rot", "opacity_logit", "dc", "rest"])

    return blocks.select(column).mapInArrow(run, "idx long, pos array<float>, log_scale array<float>, rot array<float>, opacity_logit float, dc array<float>, rest array<float>")


#: A camera of a rig; texts are places in a table behind the records (fixed layout of the format).
CAMERA = np.dtype(
    [(f"{t}_{p}", f) for t in ("id", "source", "image") for p, f in (("at", "<u8"), ("bytes", "<u4"))]
    + [("width", "<u4"), ("height", "<u4"), ("intrinsics", "4<f8"), ("camera_to_world", "16<f8"), ("timestamp_ns", "<u8"), ("confidence", "<f8"), ("reserved", "<u4")]
)
RIG_HEAD = struct.Struct("<8sHHIQQ32x")
RIG_MAGIC = b"TERRCAM\x00"
#: Stands for a camera without a time.
NO_TIME = 2**64 - 1
RIG_TYPE = "id string, source string, image string, width long, height long, intrinsics array<double>, camera_to_world array<double>, timestamp_ns decimal(20,0), confidence double"


def check_rig(cameras: list[dict]) -> None:
    """Raises for what a rig must not hold; matrices are row by row and map a camera to the world."""
    if not cameras or len({c["id"] for c in cameras}) != len(cameras):
        raise ValueError("a rig needs cameras with ids of their own")
    for c in cameras:
        parts = c["image"].split("/")
        if not c["id"] or not c["source"] or c["image"].startswith("/") or any(p in ("", ".", "..") for p in parts):
            raise ValueError(f"camera {c['id']!r}: names")
        fx, fy, cx, cy = c["intrinsics"]
        if not np.isfinite(c["intrinsics"]).all() or min(c["width"], c["height"], fx, fy) <= 0 or not 0 <= c["confidence"] <= 1:
            raise ValueError(f"camera {c['id']!r}: size, intrinsics or confidence")
        m = np.asarray(c["camera_to_world"], float).reshape(4, 4)
        r = m[:3, :3]
        if not np.isfinite(m).all() or not np.allclose(m[3], [0, 0, 0, 1], atol=1e-6):
            raise ValueError(f"camera {c['id']!r}: not affine")
        if not np.allclose(r @ r.T, np.eye(3), atol=1e-3) or abs(np.linalg.det(r) - 1) > 1e-3:
            raise ValueError(f"camera {c['id']!r}: not a rotation")


def encode_rig(cameras: list[dict]) -> bytes:
    """A block of cameras with the fields of ``RIG_TYPE``; a time of None is kept as such."""
    check_rig(cameras)
    rows, texts = np.zeros(len(cameras), CAMERA), bytearray()
    for row, c in zip(rows, cameras, strict=True):
        for t in ("id", "source", "image"):
            raw = c[t].encode()
            row[f"{t}_at"], row[f"{t}_bytes"] = len(texts), len(raw)
            texts += raw
        for name in ("width", "height", "intrinsics", "camera_to_world", "confidence"):
            row[name] = c[name]
        row["timestamp_ns"] = NO_TIME if c.get("timestamp_ns") is None else c["timestamp_ns"]
    return RIG_HEAD.pack(RIG_MAGIC, 1, 0, CAMERA.itemsize, len(rows), len(texts)) + rows.tobytes() + bytes(texts)


def decode_rig(raw: bytes) -> list[dict]:
    if len(raw) < RIG_HEAD.size:
        raise ValueError("the block is cut off")
    magic, major, minor, stride, n, texts = RIG_HEAD.unpack_from(raw)
    start = RIG_HEAD.size + n * CAMERA.itemsize
    if (magic, major, minor, stride) != (RIG_MAGIC, 1, 0, CAMERA.itemsize) or len(raw) != start + texts:
        raise ValueError("not a block of cameras")
    out = []
    for row in np.frombuffer(raw, CAMERA, n, RIG_HEAD.size):
        c = {}
        for t in ("id", "source", "image"):
            at, end = int(row[f"{t}_at"]), int(row[f"{t}_at"]) + int(row[f"{t}_bytes"])
            if end > texts:
                raise ValueError("a text is out of range")
            c[t] = raw[start + at : start + end].decode()
        if row["reserved"]:
            raise ValueError("a reserved field is not zero")
        c |= {"width": int(row["width"]), "height": int(row["height"]), "confidence": float(row["confidence"])}
        c |= {name: row[name].tolist() for name in ("intrinsics", "camera_to_world")}
        time = int(row["timestamp_ns"])
        out.append(c | {"timestamp_ns": None if time == NO_TIME else time})
    check_rig(out)
    return out


def rig_rows(blocks: DataFrame, column: str = "content") -> DataFrame:
    """The cameras of binary blocks with the columns of ``RIG_TYPE``, one task a block."""
    names = [f.split()[0] for f in RIG_TYPE.split(", ")]
    doubles = pa.list_(pa.float64())
    types = [pa.string()] * 3 + [pa.int64()] * 2 + [doubles, doubles, pa.decimal128(20, 0), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                cameras = decode_rig(raw)
                arrays = [pa.array([c[n] for c in cameras], t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return blocks.select(column).mapInArrow(run, RIG_TYPE)
