"""Contiguous shards of nearly equal size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import written

#: Bytes that a document costs besides its text.
OVERHEAD = 8


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``docs``.

    The documents in order of id lie end to end on a line of their sizes (UTF-8
    bytes of the text plus ``OVERHEAD``), which equal cuts divide into
    ``shards`` parts; a document belongs to the part in which its middle lies,
    so no shard is off its target by more than half a document at either end.
    ``slot`` counts a shard's documents from 0 in the same order. The law is
    ``bytes``; ``grown_shard`` is null, as it is for any law but ``key``.

    One scan of the texts leaves a few numbers a document, written down before
    ranges are sampled from them. These are dealt out by ranges, each range is summed, the sums of all ranges (one row each) give
    every range its offset, and running sums inside the ranges do the rest: no
    task sees more than one range. Rows of one id are dealt out by checksum,
    size and place of origin, so that a repeated id doesn't fill one range.

    Null texts have size ``OVERHEAD`` and checksum 0; null ids come first; rows
    that are equal in id, checksum and size are interchangeable. More shards
    than documents leave shards empty; an empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = written(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_origin"),
    ))
    order = ["doc_id", "text_crc32", "size", "_origin"]
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    offsets = sums.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.sum("_bytes").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    start = F.col("_bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    # twice the middle against twice the total, in whole numbers
    shard = F.least(F.lit(shards - 1), F.expr(f"(2 * _start + size) * {shards} div (2 * _total)").cast("int"))
    placed = (
        dealt.join(F.broadcast(offsets), "_range")
        .withColumn("_start", start)
        .withColumn("_in_range", F.row_number().over(inside))
        .withColumn("shard", shard)
    )
    # a shard's rows in a range are consecutive, so their slots need only each range's counts per shard
    counts = placed.groupBy("_range", "shard").agg(F.min("_in_range").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_range", "shard", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    return placed.join(base, ["_range", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_in_range") + F.col("_base")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle(shards: int) -> str:
    """DuckDB SQL for ``byte_shards`` over ``documents``; the checksum is the reflected polynomial's fold over bytes."""
    return f"""
with recursive bits as (
  select n::bigint as n, n::bigint as c, 0 as k from range(256) as t(n)
  union all
  select n, case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by n) as tab from bits where k = 8),
sized as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} as size, hex(encode(coalesce(text, ''))) as h from documents),
summed as (
  select *, sum(size) over (order by doc_id rows unbounded preceding) - size as start, sum(size) over () as total from sized),
placed as (
  select *, least({shards - 1}, ((2 * start + size) * {shards}) // (2 * total))::int as shard from summed)
select doc_id, size::bigint as size,
  xor(4294967295::bigint, list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
    lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)]), 4294967295::bigint)) as text_crc32,
  'bytes' as law, shard, (row_number() over (partition by shard order by doc_id) - 1)::bigint as slot, null::int as grown_shard
from placed, tab"""
