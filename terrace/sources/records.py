"""Small records as JSON files on any store, each there whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, record: dict) -> None:
    """Writes a record aside and renames it; one that is there before is replaced."""
    aside = f"{path}.{uuid.uuid4().hex}"
    (there, fs), (here, _) = _at(spark, path), _at(spark, aside)
    out = fs.create(here, False)
    try:
        out.write(bytearray((json.dumps(record, sort_keys=True) + "\n").encode()))
    finally:
        out.close()
    if fs.exists(there):
        fs.delete(there, False)
    if not fs.rename(here, there):
        fs.delete(here, False)
        raise OSError(f"{path} could not be written")


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The record of a file; None if there is none."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
