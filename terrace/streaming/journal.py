"""A journal of committed frames: JSON lines, a file for each micro-batch, and a record of the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.sources.records import read_json, write_json


def journal(folder: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes a batch as lines in order under ``batch=<id>``, then the checkpoint record.

    The batch is written under another name and renamed once whole; one that
    comes again after that is not written twice. Frames that are not in a whole
    batch are not in the journal.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        done, aside = path(f"{folder}/batch={batch_id:09d}"), path(f"{folder}/open-{batch_id:09d}")
        if not fs.exists(done):
            fs.delete(aside, True)
            lines = batch.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct(*sorted(batch.columns))).alias("value"))
            lines.write.text(f"{folder}/open-{batch_id:09d}")
            if not fs.rename(aside, done):
                raise OSError(f"batch {batch_id} could not be committed to {folder}")
        last = spark.read.json(f"{folder}/batch={batch_id:09d}", schema=f"{order} long").agg(F.max(order), F.count("*")).first()
        before = read_json(spark, f"{folder}/checkpoint.json") or {"batch": -1, "frames": 0, "last": None}
        if before["batch"] < batch_id:
            write_json(spark, f"{folder}/checkpoint.json", {"batch": batch_id, "frames": before["frames"] + last[1], "last": before["last"] if last[0] is None else last[0]})

    return run


def frames(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The journal's frames, those of whole batches alone."""
    return spark.read.schema(schema).json(f"{folder}/batch=*")
