"""Quality gates: rules become issue rows, thresholds lists of failures, statuses a roll-up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def issues(df: DataFrame, rules: dict[str, tuple[str, Column]], context: list[str]) -> DataFrame:
    """A row ``(severity, code, *context)`` for each rule ``code: (severity, fails)`` that a row fails."""
    found = F.array_compact(F.array(*(F.when(fails, F.struct(F.lit(level).alias("severity"), F.lit(code).alias("code"))) for code, (level, fails) in rules.items())))
    return df.select(*context, F.explode(found).alias("_i")).select("_i.severity", "_i.code", *context)


def failures(rules: dict[str, Column]) -> Column:
    """Names of the thresholds that a row misses, comma-joined, in the order given."""
    return F.concat_ws(",", *(F.when(fails, F.lit(name)) for name, fails in rules.items()))


def rolled_up(df: DataFrame, by: list[str], status: str, order: tuple[str, ...]) -> DataFrame:
    """``(*by, status, steps, failed)``: the gravest status of each group; ``order`` goes from mild to grave."""
    rank = F.lit(-1)
    for i, name in enumerate(order):
        rank = F.when(F.col(status) == name, i).otherwise(rank)
    out = df.groupBy(*by).agg(F.max(rank).alias("_r"), F.count("*").alias("steps"), F.bool_or(F.col(status) == order[-1]).alias("failed"))
    return out.select(*by, F.get(F.array(*(F.lit(n) for n in order)), F.col("_r")).alias("status"), "steps", "failed")


def fingerprint(df: DataFrame, by: list[str], order: str, fields: list[str], out: str = "fingerprint") -> DataFrame:
    """``(*by, fingerprint)``: SHA-256 of each group's rows in order, every field ended by a NUL.

    Rows stream through a digest, so a group may have any number of them.
    """
    row = F.concat(*(F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\u0000")) for f in fields))
    rows = df.select(*by, F.col(order).alias("_o"), row.alias("_r"))
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "_o", "_r").drop("_o")
    n = len(by)
    kinds = [(name, rows.schema[name].dataType) for name in by]
    schema = ", ".join([*(f"`{name}` {kind.simpleString()}" for name, kind in kinds), f"`{out}` string"])
    arrow = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kinds), (out, pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, digest.hexdigest()), arrow, strict=True)], schema=arrow)

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)
            for k, text in zip(keys, batch.column(n).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield ended()
                    key, digest = k, hashlib.sha256()
                digest.update(text.encode())
        if key is not None:
            yield ended()

    return dealt.mapInArrow(run, schema)


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A report table of all rows, which come to the driver one partition at a time."""
    line = "| {} |".format
    rows = (line(" | ".join(str(v) for v in r)) for r in df.select(*columns).toLocalIterator())
    return "\n".join([line(" | ".join(columns)), line(" | ".join("---" for _ in columns)), *rows])
