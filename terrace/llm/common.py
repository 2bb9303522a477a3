"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row may be broadcast (a few MB when hashed, so that many fit a small driver).
BROADCAST_ROWS = 20_000
#: Bitmaps of 4 KB, for 32,768 row numbers each, up to which row numbers are broadcast (32 MB).
BROADCAST_BITMAPS = 8192

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; without one, a temporary folder if the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="terrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def _remove() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already; the folder is scratch
            return


atexit.register(_remove)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder.

    Cuts the lineage: an executor that is lost takes nothing with it, and no
    later step runs the plan behind ``df`` again. Removed when Python ends. The
    session's codec compresses it if none is named.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrace-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Delete the files behind a table of ``written`` once nothing reads it."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("terrace-"):
            drop_path(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1].rsplit("/", 1)[-1] != path.rsplit("/", 1)[-1]]


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``BROADCAST_ROWS`` rows, else as it is.

    Meant for tables of ``written``, where the count reads only file footers.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it the name of no column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def having(keyed: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose number ``key`` is in ``rows (key)``: a semi join that leaves wide rows where they are.

    The numbers, from ``monotonically_increasing_id``, become bitmaps, a row for
    each 32,768 numbers, which are broadcast up to ``BROADCAST_BITMAPS``, some 200
    million rows; a broadcast of the numbers themselves would end at far fewer.
    Beyond that the same semi join is shuffled.
    """
    number = F.col(key) + 1  # the functions below count buckets from 1
    bucket, held = free_name(keyed, "_bucket"), free_name(keyed, "_bits")
    named = rows.select(F.bitmap_bucket_number(number).alias(bucket), F.bitmap_bit_position(number).alias("_p"))
    bits = written(named.groupBy(bucket).agg(F.bitmap_construct_agg("_p").alias(held)))
    if bits.count() > BROADCAST_BITMAPS:
        return keyed.join(rows, key, "left_semi").select(*keyed.columns)
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(held, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return keyed.join(F.broadcast(bits), F.bitmap_bucket_number(number) == F.col(bucket)).where(is_set).select(*(F.col(c) for c in keyed.columns))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, part: int = 4000) -> DataFrame:
    """``rows`` joined with ``facts`` on ``key``, a key with very many rows spread over several tasks.

    Keys with more than ``part`` rows, and more than a 50,000th of all, are hot: by
    that bound there are fewer than 50,000 of them, so they may be broadcast. The
    rows of a hot key are dealt out by hash to parts of about ``part`` rows, and its
    facts are repeated for each part. A null key meets nothing. ``counts``, rows
    ``(key, n)``, saves counting; without it ``rows`` should be a table of ``written``.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    counts = written(counts.select(F.col(key).alias("_hot"), "n").where(F.col("n") > part))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return rows.join(facts, key, how)
    # a 50,000th of the rows of these keys alone bounds their number just as well
    most = max(part, total // 50_000)
    hot = F.broadcast(counts.where(F.col("n") > most).select("_hot", F.ceil(F.col("n") / part).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    own = F.pmod(F.xxhash64(*rows.columns), parts).cast("int")
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", own).drop("_hot", "_parts")
    right = facts.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it.

    A lambda that mentions a column expression runs that expression for each
    element; binding it as a lambda variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
