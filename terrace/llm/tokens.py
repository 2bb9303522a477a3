"""Token totals kept by deltas: signed changes, additive sums, idempotent batches."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import shared_dir

#: Where the tokenizers' vocabulary files lie on every machine.
TOKENIZERS = "/opt/tokenizers"
#: The split into pieces that byte-level vocabularies of this kind are made for (a fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of the pattern's white space (a fixed value) that it could not take as one.
LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
KEY = ["source", "lang", "tokenizer"]
COUNTS = "doc_id long, tokenizer string, source string, lang string, n_tokens long"
STATE = "doc_id long, tokenizer string, source string, lang string, n_docs long, n_tokens long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Parts of the state table by document unless named; a batch rewrites only those that its documents lie in.
BUCKETS = 64


def words_counter() -> Callable[[str], int]:
    """Counts runs of anything but ASCII white space."""
    return lambda text: len(text.encode().split())


def bpe_counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a byte-level vocabulary given as ranks.

    The whole text is encoded at once, but for runs of white space too long for
    the pattern's stack. Such a run is two pieces whatever surrounds it, its last
    character, which belongs to what follows, and all before; so it is cut there.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        n = at = 0
        for run in LONG_BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end].encode()))
            at = end
        return n + len(encoding.encode_ordinary(text[at:]))

    return count


def counted(docs: DataFrame, tokenizer: str, make: Callable[[], Callable[[str], int]]) -> DataFrame:
    """``COUNTS`` rows, one per row of ``docs``: its tokens by one tokenizer.

    Whole texts are counted, however long; a null or empty text has no tokens.
    Repeated rows count each; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for batch in batches:
            n = [count(t.as_py() or "") for t in batch.column(3)]
            columns = [batch.column(0), pa.array([tokenizer] * len(n), pa.string()), batch.column(1), batch.column(2), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokenizer", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text"))
    return rows.mapInArrow(run, COUNTS)


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version, under a folder.

    ``commit(batch_id, changes)`` takes rows ``(op, doc_id, tokenizer, source,
    lang, n_tokens)``, op one of ``insert``, ``revise`` (both: this is what the
    document counts from now on) and ``delete``. What a document counted before
    the batch comes from the state table, so what is added to the totals is
    signed: what it counts now less what it counted. Only these sums are added up.

    A batch is the folder ``<number>-<id>`` with its deltas, the totals after it
    and the parts of the state that it touched, written under another name and
    renamed once whole: it counts fully or not at all, and a batch whose id has
    been committed changes nothing, whatever it holds. The state lies in
    ``buckets`` parts, as many for the folder's whole life: enough that one of them
    is a few GB at most. Of each part the newest batch that has it is the true one,
    and older ones go after the commit. One writer at a time.

    The rows of one id and tokenizer in a batch are one document that counts all
    of them, in each source and language they name; with a ``delete`` among them
    it is gone. Rows without an id are one document, too. Null counts are 0; rows
    without a tokenizer are left out; null sources and languages are groups of
    their own. Deleting what isn't there changes nothing; an empty batch is a
    commit like others. Groups are summed before the shuffle, so an id with a
    third of all rows is a few rows a task.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path(".").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id", "tokenizer"), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        fs, top = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []

    def batches(self) -> list[str]:
        """Ids of committed batches, oldest first."""
        return [n.split("-", 1)[1] for n in self._names("log")]

    def _parts(self) -> dict[str, list[str]]:
        """Folders of the state by bucket, oldest first."""
        found: dict[str, list[str]] = {}
        for batch in self._names("log"):
            for bucket in self._names(f"log/{batch}/state"):
                if bucket.startswith("bucket="):
                    found.setdefault(bucket, []).append(f"log/{batch}/state/{bucket}")
        return found

    def state(self) -> DataFrame:
        """What every document counts as of the last batch."""
        return self._state(self._parts())

    def _state(self, parts: dict[str, list[str]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*(f"{self.folder}/{p[-1]}" for p in parts.values()))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch was new."""
        done = self._names("log")
        if batch_id in (n.split("-", 1)[1] for n in done):
            return False
        room = f"open-{uuid.uuid4().hex}"
        group = ["doc_id", "tokenizer", "source", "lang"]
        gone = F.col("op") == "delete"
        (
            changes.where(F.col("tokenizer").isNotNull())
            .groupBy(*group)
            .agg(
                F.sum((~gone).cast("long")).alias("n_docs"),
                F.sum(F.when(gone, 0).otherwise(F.coalesce(F.col("n_tokens"), F.lit(0)))).cast("long").alias("n_tokens"),
                F.max(gone).alias("gone"),
            )
            .withColumn("bucket", self._bucket())
            .write.parquet(f"{self.folder}/{room}/new")
        )
        new = self.spark.read.parquet(f"{self.folder}/{room}/new")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # a row a bucket at most
        parts = self._parts()
        old = self._state({b: parts[b] for b in (f"bucket={k}" for k in touched) if b in parts})
        named = new.groupBy("doc_id", "tokenizer", "bucket").agg(F.max("gone").alias("_gone"))
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc_id", "tokenizer")]
        stays = old.alias("x").join(named.alias("y"), same, "left_anti")
        leaves = old.alias("x").join(named.alias("y"), same, "left_semi")
        comes = new.alias("x").join(named.where("not _gone").alias("y"), same, "left_semi").where("n_docs > 0").select(*group, "n_docs", "n_tokens")
        after = stays.unionByName(comes).withColumn("bucket", self._bucket())
        after.repartition("bucket", F.pmod(F.xxhash64(*group), F.lit(8))).write.partitionBy("bucket").parquet(f"{self.folder}/{room}/state")
        fs = self._fs()
        for k in touched:  # a part that has become empty stands for itself
            fs.mkdirs(self._path(f"{room}/state/bucket={k}"))
        signed = leaves.select(*KEY, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")).unionByName(comes.select(*KEY, "n_docs", "n_tokens"))
        _added(signed).write.parquet(f"{self.folder}/{room}/deltas")
        deltas = self.spark.read.schema(TOTALS).parquet(f"{self.folder}/{room}/deltas")
        _added(self.totals().unionByName(deltas)).where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.folder}/{room}/totals")
        fs.delete(self._path(f"{room}/new"), True)
        fs.mkdirs(self._path("log"))
        if not fs.rename(self._path(room), self._path(f"log/{len(done):09d}-{batch_id}")):
            raise RuntimeError(f"batch {batch_id} could not be committed to {self.folder}")
        for older in self._parts().values():
            for path in older[:-1]:
                fs.delete(self._path(path), True)
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)``: all deltas added up; groups without documents are gone."""
        done = self._names("log")
        if not done:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.folder}/log/{done[-1]}/totals")


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


def production(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Totals of all documents, kept over four batches.

    Rough counts of words (characters over four) are inserted; then byte-level
    BPE counts; the first batch comes again and is ignored; then true counts of
    words revise the rough ones.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, f"{shared_dir(spark)}/terrace-{uuid.uuid4().hex}")
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"
    words = counted(docs, "words/1", words_counter)
    rough = docs.select("doc_id", F.lit("words/1").alias("tokenizer"), "source", "lang", F.expr("length(coalesce(text, '')) div 4").alias("n_tokens"))
    rollup.commit("rough", rough.withColumn("op", F.lit("insert")))
    rollup.commit("bpe", counted(docs, "byte_bpe_50k/1", lambda: bpe_counter(path)).withColumn("op", F.lit("insert")))
    rollup.commit("rough", rough.withColumn("op", F.lit("insert")))
    rollup.commit("words", words.withColumn("op", F.lit("revise")))
    return rollup.totals()
