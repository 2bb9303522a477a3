"""From raw documents to shards: quality, near-duplicates, benchmark passages, mixture, shards.

Each stage takes the documents that the one before left, written as Parquet, and
all but the last return the columns of ``documents``. Rows are judged one by one:
a stage gives each row of its input a key, so that rows that share an id, or have
none, each get a verdict of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import contamination, minhash, mixing, quality, sharding
from terrace.llm.common import free_name, having, table, written

#: Shards of the last stage.
SHARDS = 24
#: Words of a shingle, and the similarity in percent from which documents are near-duplicates.
SHINGLE, SIMILARITY = 5, 80


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique key, fixed by writing it down with the texts, and the key's name, which no column has."""
    name = free_name(docs, "_row")
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "zstd"), name


def _only(keyed: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """The documents whose key is among ``rows``."""
    return having(keyed, name, written(rows)).drop(name)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and wordless texts fail; long ones are judged whole. Each row has a
    verdict of its own, also where it shares its id, has none, or comes again. A
    null source is a host. No documents give none; other columns come along.
    """
    keyed, row = _keyed(docs)
    return _only(keyed, row, quality.judged(keyed, row).where("kept").select(F.col("doc_id").alias(row)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, a null id only where there is no other.

    Rows are linked by their own texts, whatever their ids, so of repeated rows one
    stays. Of rows that share the smallest id, one stays, by a hash of text, language
    and source. Null and wordless texts are like no other and stay, each of them; long
    texts are compared whole. No documents give none; other columns come along.
    """
    keyed, row = _keyed(docs)
    groups = minhash.near_duplicates(keyed, SHINGLE, SIMILARITY, row).select(F.col("doc_id").alias(row), "component_id")
    names = keyed.select(row, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text", "lang", "source").alias("_hash"))
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash", row)
    return _only(keyed, row, names.join(groups, row).groupBy("component_id").agg(F.min(order).alias("_first")).select(f"_first.{row}"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window.

    Each row has a verdict of its own. Null and wordless texts have no such word and
    stay; long ones are searched whole. No documents give none, no benchmark leaves
    all; other columns come along.
    """
    keyed, row = _keyed(docs)
    found = contamination.contaminated(keyed.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _only(keyed, row, found.where("not contaminated").select(F.col("doc_id").alias(row)))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, each at most once and whole.

    The document in which a quota ends is the last one drawn of its leaf, and comes
    whole. Rows of one id or none are drawn one by one; a null language or source is
    the name ``?``. Texts without words cost nothing and are drawn if they come before
    their leaf's end. No documents give none; other columns come along.
    """
    keyed, row = _keyed(docs)
    return _only(keyed, row, mixing.production(keyed, max_epochs=1, row_col=row).select(row))


def balanced_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, in order of id; null ids first, null texts of size 8, repeated rows each by itself."""
    return sharding.byte_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("mixture", target_mix),
    ("sharding", balanced_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


#: SQL has no MinHash; the pipeline is tested against a brute-force version.
ORACLE_SQL = None
