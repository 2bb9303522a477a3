"""Asset directories: a manifest, a mesh, cameras and confidences that must fit each other."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.numeric import safe_path
from terrace.sources.codecs import check_rig, decode_confidence
from terrace.sources.glb import Glb

# Fixed values of the format.
MANIFEST = "canonical-asset.json"
AXES = "right-handed-y-up-negative-z-forward"
PROVIDER = "struct<name:string,version:string,inputSha256:string,configurationSha256:string>"
FIELDS = (
    "schemaVersion long, name string, coordinateSystem string, metersPerUnit double, mesh string, cameras string, "
    f"geometryProvider {PROVIDER}, appearanceProvider {PROVIDER}, confidence struct<kind:string,value:double,file:string>"
)
PART = "path string, error string, rows long, triangles long, materials long, images long"


def _mesh(raw: bytes) -> tuple:
    g = Glb(raw)
    vertices = triangles = 0
    for _, _, _, places, faces in g.primitives():
        vertices, triangles = vertices + len(places["POSITION"]), triangles + len(faces)
    if not g.textured():
        raise ValueError("no texture is bound")
    return vertices, triangles, len(g.doc.get("materials", [])), len(g.doc.get("images", []))


def _cameras(raw: bytes) -> tuple:
    doc = json.loads(raw)
    if doc["schemaVersion"] != 1:
        raise ValueError("version")
    check_rig([c | {"source": c["sourceId"], "intrinsics": c["intrinsics"], "camera_to_world": c["cameraToWorld"]} for c in doc["cameras"]])
    return len(doc["cameras"]), None, None, None


def _confidence(raw: bytes) -> tuple:
    return len(decode_confidence(raw)), None, None, None


READERS = {"mesh": _mesh, "cameras": _cameras, "confidence": _confidence}


def _parts(files: DataFrame, role: str) -> DataFrame:
    """What files ``(path, content)`` of one role hold, or what is wrong with them."""
    read = READERS[role]
    types = [pa.string(), pa.string(), *[pa.int64()] * 4]

    def row(path: str, raw: bytes) -> tuple:
        try:
            return path, None, *read(raw)
        except (ValueError, KeyError, TypeError, IndexError, AttributeError) as e:
            return path, f"{type(e).__name__}: {e}", None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(p, c.as_py()) for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            if rows:
                columns = zip(zip(*rows, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [f.split()[0] for f in PART.split(", ")])

    return files.mapInArrow(run, PART)


def _named(path: Column, ending: str) -> Column:
    return F.coalesce(safe_path(path) & path.endswith(ending), F.lit(False))


def _provider(p: Column) -> Column:
    said = (F.length(p["name"]) > 0) & (F.length(p["version"]) > 0)
    hashed = p["inputSha256"].rlike("^[0-9a-fA-F]{64}$") & p["configurationSha256"].rlike("^[0-9a-fA-F]{64}$")
    return F.coalesce(said & hashed, F.lit(False))


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """``(root, name, cameras, vertices, triangles, materials, images, confidence, codes)`` for each manifest under ``folder``.

    ``confidence`` is the one value of all vertices, null where each has its own.
    ``codes`` names what is wrong, in the order manifest, mesh, cameras,
    confidence; it is empty for a sound asset. Files are read where they lie and
    joined by path; nothing is collected. A manifest that is no JSON has the code
    ``manifest`` alone beside those of the files it does not name.
    """
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    text = F.from_json(F.col("content").cast("string"), FIELDS)
    manifests = content.option("pathGlobFilter", MANIFEST).load(folder).select(F.regexp_replace("path", "/[^/]*$", "").alias("root"), text.alias("d"))
    each = F.col("d.confidence.kind") == "per-vertex"
    uniform = (F.col("d.confidence.kind") == "uniform") & F.col("d.confidence.value").between(0.0, 1.0)
    sound = (
        (F.col("d.schemaVersion") == 1)
        & (F.length("d.name") > 0)
        & (F.col("d.coordinateSystem") == AXES)
        & (F.abs(F.col("d.metersPerUnit") - 1) <= 1e-12)
        & _named(F.col("d.mesh"), ".glb")
        & _named(F.col("d.cameras"), ".json")
        & _provider(F.col("d.geometryProvider"))
        & _provider(F.col("d.appearanceProvider"))
        & (uniform | (each & _named(F.col("d.confidence.file"), ".bin")))
    )
    out = manifests.select("*", F.coalesce(sound, F.lit(False)).alias("_sound"), F.coalesce(each, F.lit(False)).alias("_each"))
    for role, named, glob in (("mesh", "d.mesh", "*.glb"), ("cameras", "d.cameras", "*.json"), ("confidence", "d.confidence.file", "*.bin")):
        wanted = out.select(F.concat_ws("/", "root", named).alias("path")).where(F.col(named).isNotNull()).distinct()
        files = content.option("pathGlobFilter", glob).load(folder).select("path", "content").join(wanted, "path", "left_semi")
        seen = _parts(files, role).select(F.col("path").alias("_path"), F.struct("error", "rows", "triangles", "materials", "images").alias(f"_{role}"))
        out = out.join(seen, F.concat_ws("/", "root", named) == F.col("_path"), "left").drop("_path")
    vertices, own = F.col("_mesh.rows"), F.col("_confidence.rows")

    def bad(role: str) -> Column:
        return F.col(f"_{role}").isNull() | F.col(f"_{role}.error").isNotNull()

    codes = F.array(
        F.when(~F.col("_sound"), "manifest"),
        F.when(bad("mesh"), "mesh"),
        F.when(bad("cameras"), "cameras"),
        F.when(F.col("_each") & (bad("confidence") | F.coalesce(own != vertices, F.lit(False))), "confidence"),
    )
    return out.select(
        "root",
        F.col("d.name").alias("name"),
        F.col("_cameras.rows").alias("cameras"),
        vertices.alias("vertices"),
        *(F.col(f"_mesh.{c}").alias(c) for c in ("triangles", "materials", "images")),
        F.when(~F.col("_each"), F.col("d.confidence.value")).alias("confidence"),
        F.array_compact(codes).alias("codes"),
    )
