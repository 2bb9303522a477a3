"""Recorded sequences: a JSON manifest of frames, binary planes beside it, and a journal that survives a crash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.numeric import safe_path
from terrace.operators.scan import numbered

PLANE = "struct<path:string,width:int,height:int,row_stride:int,bytes_per_pixel:int,byte_count:bigint,sha256:string>"
POSE = "struct<qw:double,qx:double,qy:double,qz:double,tx:double,ty:double,tz:double>"
FRAME = f"struct<frame_id:bigint,timestamp_ns:bigint,pose:{POSE},planes:array<{PLANE}>>"


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of manifests ``{"source_id": .., "frames": [..]}``, each with its place in the list."""
    kind = f"source_id string, frames array<{FRAME}>"
    whole = spark.read.schema(kind).option("multiLine", True).json(path)
    return whole.select("source_id", F.posexplode("frames").alias("place", "_f")).select("source_id", "place", "_f.*")


def plane_code(p: Column) -> Column:
    """What is wrong with a plane's record; null if nothing is."""
    return (
        F.when(~safe_path(p["path"]), "path")
        .when(~p["sha256"].rlike("^[0-9a-f]{64}$"), "sha256")
        .when((p["width"] <= 0) | (p["height"] <= 0) | (p["row_stride"] < p["width"] * p["bytes_per_pixel"]), "stride")
        .when(p["byte_count"] != p["row_stride"].cast("long") * p["height"], "size")
    )


def checked(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """``(source_id, frame_id, path, code)`` of every plane: records, order of frames, and content against size and hash.

    Contents are hashed where they are read and joined by path; no file is
    collected.
    """
    order = Window.partitionBy("source_id").orderBy("place")
    seen = rows.withColumn("_id", F.lag("frame_id").over(order)).withColumn("_t", F.lag("timestamp_ns").over(order))
    wrong = F.when(F.col("frame_id") <= F.col("_id"), "frame-order").when(F.col("timestamp_ns") < F.col("_t"), "time-order")
    planes = seen.withColumn("_order", wrong).select("source_id", "frame_id", "_order", F.explode("planes").alias("p"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    hashed = files.select(F.col("path").alias("_file"), F.length("content").alias("_n"), F.sha2("content", 256).alias("_sha"))
    root = F.lit(folder.rstrip("/"))
    hashed = hashed.withColumn("_path", F.regexp_replace("_file", F.concat(F.lit("^.*\\Q"), root, F.lit("\\E/")), F.lit("")))
    both = planes.join(hashed, F.col("p.path") == F.col("_path"), "left")
    code = F.coalesce(
        F.col("_order"),
        plane_code(F.col("p")),
        F.when(F.col("_n").isNull(), "missing").when(F.col("_n") != F.col("p.byte_count"), "file-size").when(F.col("_sha") != F.col("p.sha256"), "file-hash"),
    )
    return both.select("source_id", "frame_id", F.col("p.path").alias("path"), code.alias("code"))


def confidence(level: Column) -> Column:
    """Levels 0, 1, 2 as 0, 128, 255; anything else raises."""
    return F.when(level == 0, 0).when(level == 1, 128).when(level == 2, 255).otherwise(F.raise_error(F.lit("confidence level out of range")))


def tail_bytes(spark: SparkSession, path: str, step: int = 1 << 16) -> int:
    """How many bytes of a file come after its last line end; read from its end, ``step`` bytes at a time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = at = fs.getFileStatus(where).getLen()
    stream = fs.open(where)
    try:
        while at > 0:
            n = min(step, at)
            at -= n
            stream.seek(at)
            found = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)).rfind(b"\n")
            if found >= 0:
                return size - (at + found + 1)
    finally:
        stream.close()
    return size


def recovered(spark: SparkSession, path: str, schema: str = "frame_id long, timestamp_ns long") -> tuple[DataFrame, int]:
    """Frames of a journal of JSON lines and the bytes cut off at its end.

    Only lines with their line end count. Raises if one of these isn't a record,
    if ids don't go up by one from 1, or if time goes back. A large journal is read
    in parts, and lines are numbered by ranges of their places.
    """
    tail = tail_bytes(spark, path)
    text = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_in"))
    lines = numbered(text.where("value <> ''"), ["_at", "_in"], "_k")
    if tail:
        lines = lines.where(F.col("_k") < lines.count() - 1)
    rows = lines.select("_k", F.from_json("value", schema).alias("f")).select("_k", "f.*")
    after = rows.select((F.col("frame_id") + 1).alias("frame_id"), F.col("timestamp_ns").alias("_t"))
    back = rows.join(after, "frame_id").where("timestamp_ns < _t or timestamp_ns < 0")
    if not rows.where("frame_id is null or timestamp_ns is null or timestamp_ns < 0 or frame_id <> _k + 1").isEmpty() or not back.isEmpty():
        raise ValueError("the journal's frames are not in order")
    return rows.drop("_k"), tail
