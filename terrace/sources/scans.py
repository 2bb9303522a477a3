"""Recordings of scanners: trajectories, camera files, images in folders, and manifests with poses as matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions import geometry as g
from terrace.functions import names
from terrace.functions.numeric import finite
from terrace.sources.manifest import plane_code


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != ""), lambda w: w.try_cast("double"))


def trajectory(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``at``, ``pose`` and ``code`` to lines of seven numbers: time, axis times angle, and movement, world to camera.

    ``pose`` is camera to world, 16 numbers column by column, of a camera that
    looks along -z with y up. Empty lines are left out; ``code`` marks lines that
    are not seven finite numbers.
    """
    rows = lines.where(F.trim(line) != "").withColumn("_n", _numbers(F.col(line)))
    good = (F.size("_n") == 7) & F.forall("_n", finite)
    n = [F.get("_n", F.lit(k)) for k in range(7)]
    r = g.axis_angle_matrix((n[1], n[2], n[3]))
    t = (n[4], n[5], n[6])
    zero = F.lit(0.0)
    # rows of r are columns of its inverse; the second and third axes are turned round
    axes = [x for k, sign in ((0, 1), (1, -1), (2, -1)) for x in (*(sign * c for c in r[k]), zero)]
    place = [-(r[0][k] * t[0] + r[1][k] * t[1] + r[2][k] * t[2]) for k in range(3)]
    pose = F.array(*axes, *place, F.lit(1.0))
    return rows.withColumn("at", F.when(good, n[0])).withColumn("pose", F.when(good, pose)).withColumn("code", F.when(~good, "fields")).drop("_n")


def pinhole(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``width, height, fx, fy, cx, cy, code`` to texts of six numbers; ``code`` says what is wrong with them."""
    rows = files.withColumn("_n", _numbers(F.col(text)))
    n = [F.get("_n", F.lit(k)) for k in range(6)]
    code = F.when((F.size("_n") != 6) | F.exists("_n", lambda x: x.isNull()), "fields").when(F.least(*n[:4]) <= 0, "bounds")
    rows = rows.withColumn("width", n[0].cast("int")).withColumn("height", n[1].cast("int"))
    for k, name in enumerate(("fx", "fy", "cx", "cy")):
        rows = rows.withColumn(name, n[k + 2])
    return rows.withColumn("code", code).drop("_n")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, bytes)`` of all images below a folder, in order of name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    root = folder.rstrip("/")
    name = F.regexp_replace("path", F.lit(f"^.*\\Q{root}\\E/"), F.lit(""))
    return files.where(names.is_image(F.col("path"))).select("path", name.alias("name"), "bytes").orderBy("name")


def manifests(spark: SparkSession, folder: str, version: int, fields: str) -> DataFrame:
    """One row per JSON file of a folder but ``schema.json``: its ``name``, ``fields`` and ``code``.

    ``fields`` is a schema with ``schemaVersion`` and ``id`` among others. ``code``
    says what is wrong: no JSON object, another version, an id that isn't the name.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    rows = files.select(F.regexp_extract("path", "([^/]*)\\.json$", 1).alias("name"), F.from_json(F.col("content").cast("string"), fields).alias("m")).where("name <> 'schema'")
    code = (
        F.when(F.col("m").isNull() | (F.col("m.schemaVersion").isNull() & F.col("m.id").isNull()), "json")
        .when(~F.coalesce(F.col("m.schemaVersion") == version, F.lit(False)), "version")
        .when(~F.coalesce(F.col("m.id") == F.col("name"), F.lit(False)), "identity")
    )
    return rows.select("name", "m.*", code.alias("code"))


#: What a manifest with poses as matrices must say of its axes and units (fixed values of the format).
CONVENTIONS = {
    "camera": "ARKit right-handed: +X right, +Y up, -Z forward",
    "pose": "column-major camera-to-world 4x4 matrix",
    "depthUnit": "metres",
    "intrinsics": "3x3 column-major pixels",
}
_PLANE = "struct<path:string,sha256:string,width:int,height:int,rowStrideBytes:int,pixelFormat:string,byteCount:bigint>"
_FRAME = (
    "struct<frameID:bigint,timestampNanoseconds:bigint,arTimestampSeconds:double,cameraTrackingState:string,nativeImageOrientation:string,"
    f"mirrored:boolean,calibration:struct<imageWidth:int,imageHeight:int,depthWidth:int,depthHeight:int>,luma:{_PLANE},chroma:{_PLANE},depth:{_PLANE},"
    f"confidence:{_PLANE},cameraToWorld:array<double>,exposure:struct<durationSeconds:double,exposureOffsetEV:double>>"
)
LIDAR = f"sourceID string, coordinateSystem struct<{','.join(f'{k}:string' for k in CONVENTIONS)}>, frames array<{_FRAME}>"
#: Bytes of a pixel by the format's name (fixed values of the format).
FORMATS = {"luma": ("y8", 1), "chroma": ("cbcr8x2", 2), "depth": ("depth-f32-metres", 4), "confidence": ("arkit-confidence-u8", 1)}


def lidar_frames(spark: SparkSession, path: str) -> DataFrame:
    """``(source_id, place, frame_id, at_ns, pose, code)`` of the frames of manifests with poses as matrices.

    ``pose`` is a unit quaternion and a place, camera to world, of a camera that
    looks along +z with y down. ``code`` says the first thing that is wrong, in
    this order: the conventions of the file, tracking, orientation, time, a
    missing part, a plane's record, the planes' sizes, the pose, exposure, order.
    """
    whole = spark.read.schema(LIDAR).option("multiLine", True).json(path)
    named = F.coalesce(F.forall(F.array(*(F.col(f"coordinateSystem.{k}") == v for k, v in CONVENTIONS.items())), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    rows = whole.select(F.col("sourceID").alias("source_id"), named.alias("_named"), F.posexplode("frames").alias("place", "f"))
    f = F.col("f")

    def plane(name: str) -> Column:
        p, (kind, size) = f[name], FORMATS[name]
        asked = F.struct(p["path"].alias("path"), p["sha256"].alias("sha256"), p["width"].alias("width"), p["height"].alias("height"), p["rowStrideBytes"].alias("row_stride"), F.lit(size).alias("bytes_per_pixel"), p["byteCount"].alias("byte_count"))
        return F.when(~F.coalesce(p["pixelFormat"] == kind, F.lit(False)), "format").otherwise(plane_code(asked))

    def size(name: str) -> Column:
        return F.struct(f[name]["width"].alias("w"), f[name]["height"].alias("h"))

    c = f["calibration"]
    whole_size, depth_size = F.struct(c["imageWidth"].alias("w"), c["imageHeight"].alias("h")), F.struct(c["depthWidth"].alias("w"), c["depthHeight"].alias("h"))
    half = F.struct((f["chroma"]["width"] * 2).alias("w"), (f["chroma"]["height"] * 2).alias("h"))
    sizes = (size("depth") == depth_size) & (size("luma") == whole_size) & (half == size("luma")) & (f["confidence"].isNull() | (size("confidence") == depth_size))
    parts = [f[n] for n in ("calibration", "luma", "chroma", "depth", "cameraToWorld")]
    order = Window.partitionBy("source_id").orderBy("place")
    code = (
        F.when(~F.col("_named"), "conventions")
        .when(~F.coalesce(f["cameraTrackingState"] == "normal", F.lit(False)), "tracking")
        .when(~F.coalesce((f["nativeImageOrientation"] == "landscapeRight") & ~f["mirrored"], F.lit(False)), "orientation")
        .when(~F.coalesce(f["arTimestampSeconds"].between(0, 2.0**63 / 1e9), F.lit(False)), "time")
        .when(F.greatest(*(p.isNull() for p in parts)), "incomplete")
        .when(F.coalesce(*(plane(n) for n in ("luma", "chroma", "depth")), F.when(f["confidence"].isNotNull(), plane("confidence"))).isNotNull(), "plane")
        .when(~F.coalesce(sizes, F.lit(False)), "sizes")
        .when(g.rigid_code(f["cameraToWorld"]).isNotNull(), "pose")
        .when(f["exposure"].isNotNull() & ~F.coalesce((f["exposure"]["durationSeconds"] >= 0) & f["exposure"]["exposureOffsetEV"].isNotNull(), F.lit(False)), "exposure")
        .when(F.col("_before") >= f["frameID"], "frame-order")
        .when(F.col("_then") > f["timestampNanoseconds"], "time-order")
    )
    seen = rows.withColumn("_before", F.lag("f.frameID").over(order)).withColumn("_then", F.lag("f.timestampNanoseconds").over(order)).withColumn("code", code)
    at = F.round(f["arTimestampSeconds"] * 1e9).cast("long")
    return seen.select("source_id", "place", f["frameID"].alias("frame_id"), at.alias("at_ns"), F.when(F.col("code").isNull(), g.image_pose(f["cameraToWorld"])).alias("pose"), "code")


def replay(frames: DataFrame, source: str, order: str, start: int = 0, most: int | None = None, broken: Column | None = None) -> DataFrame:
    """Each source's frames from place ``start`` on, ``most`` of them at most, up to the first that ``broken`` marks.

    A frame that is broken, and all after it, are not there: that is what a reader
    sees of a source that fails at it.
    """
    line = Window.partitionBy(source).orderBy(order)
    rows = frames.withColumn("_k", F.row_number().over(line) - 1).where(F.col("_k") >= start)
    if most is not None:
        rows = rows.where(F.col("_k") < start + most)
    if broken is not None:
        failed = F.max(F.coalesce(broken, F.lit(False)).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_failed", failed).where("_failed = 0").drop("_failed")
    return rows.drop("_k")
