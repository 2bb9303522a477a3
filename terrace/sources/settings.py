"""JSON settings beside a capture: camera paths, calibrations, camera groups and matches of cameras.

Each reader takes one file or a folder of files and returns rows with ``code``,
which names what is wrong with a row and is null if nothing is. A file that
isn't JSON of the kind yields one row with the code ``malformed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.numeric import finite, safe_path

# Field names and limits of the formats.
KEYFRAME = "struct<time:double,position:array<double>,rotation:array<double>,verticalFovRadians:double,exposureEv:double>"
CALIBRATION = (
    "id string, cameraMake string, cameraModel string, lensModel string, createdAt string, width int, height int, "
    "fx double, fy double, cx double, cy double, distortionModel string, distortion array<double>, calibrationRms double"
)
GROUP = "struct<id:string,relativeDirectory:string,device:string,lens:string,focalLengthMillimetres:double,calibrationId:string>"
PAIR = "struct<colmapImage:string,captureFrameId:bigint>"
MOST_GROUPS = 128


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(file, d)``: each file's fields, null where the text isn't JSON."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), F.from_json(F.col("content").cast("string"), schema).alias("d"))


def _listed(documents: DataFrame, items: str) -> DataFrame:
    """``(file, bad, place, i)``: the items of each file, one row without an item where a file has none."""
    held = F.col(f"d.{items}")
    bad = F.when(F.col("d.schemaVersion").isNull() | held.isNull(), "malformed").when(F.col("d.schemaVersion") != 1, "version").when(F.size(held) == 0, "empty")
    rows = documents.select("file", bad.alias("bad"), F.when(bad.isNull(), held).alias("_items"))
    return rows.select("file", "bad", F.posexplode_outer("_items").alias("place", "i"))


def _all_finite(values: Column, n: int) -> Column:
    return values.isNotNull() & (F.size(values) == n) & F.forall(values, finite)


def camera_paths(spark: SparkSession, path: str) -> DataFrame:
    """``(file, place, seconds, position, rotation, fov, exposure, code)``: keyframes in the file's order.

    Rotations ``x, y, z, w`` come back with length 1. ``time-order`` marks a
    keyframe that isn't later than the one before.
    """
    rows = _listed(_documents(spark, path, f"schemaVersion int, keyframes array<{KEYFRAME}>"), "keyframes")
    before = F.lag("i.time").over(Window.partitionBy("file").orderBy("place"))
    norm = F.sqrt(F.aggregate("i.rotation", F.lit(0.0), lambda a, v: a + v * v))
    code = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(~(finite(F.col("i.time")) & finite(F.col("i.verticalFovRadians")) & finite(F.col("i.exposureEv"))), "fields")
        .when(~_all_finite(F.col("i.position"), 3) | ~_all_finite(F.col("i.rotation"), 4), "fields")
        .when(norm <= 1e-12, "rotation")
        .when((F.col("i.verticalFovRadians") <= 0) | (F.col("i.verticalFovRadians") >= 3.141592653589793), "field-of-view")
        .when(F.col("i.time") <= before, "time-order")
    )
    unit = F.when(norm > 1e-12, F.transform("i.rotation", lambda v: v / norm))
    return rows.select(
        "file", "place", F.col("i.time").alias("seconds"), F.col("i.position").alias("position"), unit.alias("rotation"),
        F.col("i.verticalFovRadians").alias("fov"), F.col("i.exposureEv").alias("exposure"), code.alias("code"),
    )


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    """One row a file with the calibration's fields and ``code``; a repeated id is marked in each of its files."""
    rows = _documents(spark, path, CALIBRATION).select("file", F.col("d").isNull().alias("_none"), "d.*")
    numbers = [F.col(c) for c in ("fx", "fy", "cx", "cy")]
    ok = finite(numbers[0])
    for c in numbers[1:]:
        ok = ok & finite(c)
    model = F.col("distortionModel")
    code = (
        F.when(F.col("_none") | F.col("id").isNull() | (F.col("id") == ""), "malformed")
        .when(F.col("width").isNull() | F.col("height").isNull() | ~ok, "fields")
        .when((F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("fx") <= 0) | (F.col("fy") <= 0), "range")
        .when(model.isNotNull() & ~model.isin("None", "Radial", "Opencv"), "distortion-model")
        .when(F.col("distortion").isNotNull() & ~_all_finite(F.col("distortion"), 8), "distortion")
        .when(F.count("*").over(Window.partitionBy("id")) > 1, "duplicate")
    )
    return rows.withColumn("code", code).drop("_none")


def camera_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(file, id, relative_directory, device, lens, focal, calibration_id, code)``; ids and folders are unique in a file."""
    rows = _listed(_documents(spark, path, f"schemaVersion int, groups array<{GROUP}>"), "groups")
    whole, same = Window.partitionBy("file"), [Window.partitionBy("file", f"i.{c}") for c in ("id", "relativeDirectory")]
    empty = F.lit(False)
    for c in ("id", "device", "lens", "relativeDirectory"):
        empty = empty | F.col(f"i.{c}").isNull() | (F.col(f"i.{c}") == "")
    focal = F.col("i.focalLengthMillimetres")
    code = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.count("*").over(whole) > MOST_GROUPS, "too-many")
        .when(empty, "fields")
        .when(~safe_path(F.col("i.relativeDirectory")), "path")
        .when(focal.isNotNull() & (~finite(focal) | (focal <= 0)), "focal")
        .when((F.count("*").over(same[0]) > 1) | (F.count("*").over(same[1]) > 1), "duplicate")
    )
    return rows.select(
        "file", F.col("i.id").alias("id"), F.col("i.relativeDirectory").alias("relative_directory"), F.col("i.device").alias("device"), F.col("i.lens").alias("lens"),
        focal.alias("focal"), F.col("i.calibrationId").alias("calibration_id"), code.alias("code"),
    )


def camera_matches(spark: SparkSession, path: str) -> DataFrame:
    """``(file, image, frame_id, code)``: pairs of an image of a model and a frame of a capture, each in one pair only."""
    rows = _listed(_documents(spark, path, f"schemaVersion int, pairs array<{PAIR}>"), "pairs")
    image, frame = F.col("i.colmapImage"), F.col("i.captureFrameId")
    code = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(image.isNull() | (image == "") | frame.isNull() | (frame <= 0), "fields")
        .when(~safe_path(image), "path")
        .when((F.count("*").over(Window.partitionBy("file", image)) > 1) | (F.count("*").over(Window.partitionBy("file", frame)) > 1), "not-one-to-one")
    )
    return rows.select("file", image.alias("image"), frame.alias("frame_id"), code.alias("code"))
