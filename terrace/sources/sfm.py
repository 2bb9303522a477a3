"""Text exports of structure-from-motion models: cameras, images with observations, points with tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parameters of each camera model (fixed values of the format).
CAMERA_MODELS = {"SIMPLE_PINHOLE": 3, "PINHOLE": 4, "SIMPLE_RADIAL": 4, "RADIAL": 5, "OPENCV": 8}


def pairs_of(values: Column) -> Column:
    """Consecutive pairs of an array as ``struct<a, b>``; a last value without a partner is left out."""
    n = F.floor(F.size(values) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(F.get(values, 2 * k).alias("a"), F.get(values, 2 * k + 1).alias("b")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, line)`` of a text; a file is read whole, its lines keep their number."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.split(F.col("content").cast("string"), "\r?\n").alias("_l"))
    return files.select("file", F.posexplode("_l").alias("at", "line"))


def _fields(line: str = "line") -> Column:
    return F.filter(F.split(F.trim(F.col(line)), "\\s+"), lambda w: w != "")


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """``cameras_of`` the lines of texts."""
    return cameras_of(_lines(spark, path))


def cameras_of(lines: DataFrame) -> DataFrame:
    """``(camera_id, model, width, height, params, code)`` of rows ``(line)``; ``code`` names what is wrong with a line."""
    f = _fields()
    rows = lines.where("trim(line) <> '' and not startswith(line, '#')").select(f.alias("f"))
    want = F.lit(None).cast("int")
    for model, n in CAMERA_MODELS.items():
        want = F.when(F.get("f", F.lit(1)) == model, n).otherwise(want)
    code = F.when(want.isNull(), "unknown-model").when(F.size("f") != 4 + want, "parameters")
    return rows.select(
        F.get("f", F.lit(0)).try_cast("long").alias("camera_id"),
        F.get("f", F.lit(1)).alias("model"),
        F.get("f", F.lit(2)).try_cast("int").alias("width"),
        F.get("f", F.lit(3)).try_cast("int").alias("height"),
        F.transform(F.slice("f", 5, 64), lambda x: x.try_cast("double")).alias("params"),
        code.alias("code"),
    )


def images(spark: SparkSession, path: str) -> DataFrame:
    """``images_of`` the lines of texts."""
    return images_of(_lines(spark, path))


def images_of(lines: DataFrame) -> DataFrame:
    """``(image_id, qw.., tx.., camera_id, name, observations, code)`` of rows ``(file, at, line)``: records of two lines each."""
    kept = lines.where("not startswith(line, '#')")
    order = Window.partitionBy("file").orderBy("at")
    # comment lines fall out first; a record's second line may be empty, trailing empty lines are not records
    numbered = kept.withColumn("_n", F.row_number().over(order) - 1).withColumn("_next", F.lead("line").over(order))
    rows = numbered.where("_n % 2 = 0 and trim(line) <> ''").select(_fields().alias("f"), F.coalesce("_next", F.lit("")).alias("o"))
    g = [F.get("f", F.lit(k)) for k in range(10)]
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    values = [g[k + 1].try_cast("double").alias(n) for k, n in enumerate(names)]
    out = rows.select(
        g[0].try_cast("long").alias("image_id"), *values, g[8].try_cast("long").alias("camera_id"), g[9].alias("name"), F.floor(F.size(F.filter(F.split(F.trim("o"), "\\s+"), lambda w: w != "")) / 3).cast("int").alias("observations")
    )
    norm = F.sqrt(sum((F.col(q) * F.col(q) for q in names[:4]), F.lit(0.0)))
    same = Window.partitionBy("image_id")
    code = (
        F.when(F.col("image_id").isNull() | F.col("tz").isNull() | F.col("name").isNull(), "fields")
        .when(F.abs(norm - 1) > 1e-3, "quaternion")
        .when(F.contains("name", F.lit("..")) | F.col("name").startswith("/"), "path")
        .when(F.count("*").over(same) > 1, "duplicate")
    )
    return out.withColumn("code", code)


def points(spark: SparkSession, path: str) -> DataFrame:
    """``points_of`` the lines of texts."""
    return points_of(_lines(spark, path))


def points_of(lines: DataFrame) -> DataFrame:
    """``(point_id, x, y, z, r, g, b, error, track)`` of rows ``(line)``, ``track`` an array of ``(image_id, point2d)``."""
    rows = lines.where("trim(line) <> '' and not startswith(line, '#')").select(_fields().alias("f"))
    g = [F.get("f", F.lit(k)) for k in range(8)]
    track = F.transform(pairs_of(F.slice("f", 9, 1 << 20)), lambda p: F.struct(p["a"].try_cast("long").alias("image_id"), p["b"].try_cast("long").alias("point2d")))
    return rows.select(
        g[0].try_cast("long").alias("point_id"),
        *(g[k + 1].try_cast("double").alias(a) for k, a in enumerate("xyz")),
        *(g[k + 4].try_cast("int").alias(a) for k, a in enumerate("rgb")),
        g[7].try_cast("double").alias("error"),
        track.alias("track"),
    )
