"""Benchmark passages in documents, by a prefix-filtered join of word windows.

Each window of an item is known by its rarest word, its prefix. A document is
read once: where a prefix stands, the windows that could lie around it there are
hashed, and those whose hash an item's window has too are joined with the items'
windows and compared word by word. What the readers of documents hold of the
benchmark are two filters and a table of counts, each of a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import small, spread_join, written
from terrace.llm.hashing import hashed_words, mixed

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Bits of each filter, and buckets in which words are counted for their rarity; collisions cost time, not results.
FILTER_BITS, COUNT_BITS = 24, 18
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20

#: A-Z to a-z, other ASCII but digits to blanks; bytes above belong to words.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return raw.translate(_WORD).split()


class Words:
    """The words of some texts, end to end: ``owner`` is each one's text, ``first`` each text's first word."""

    def __init__(self, texts: list[bytes]):
        self.blob = b" ".join(texts).translate(_WORD) + b" "
        data = np.frombuffer(self.blob, np.uint8)
        self.starts, self.ends, self.hashes = hashed_words(data, data == 32)
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, edges)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def window_hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the windows of ``n`` words from the words ``at``."""
        with np.errstate(over="ignore"):
            out = np.full(len(at), n, np.uint64)
            for k in range(n):
                out = mixed(out * np.uint64(3) + self.hashes[at + k])
        return out

    def text(self, at: int, n: int) -> bytes:
        """The words of a window with one blank between them."""
        return b" ".join(self.blob[self.starts[at] : self.ends[at + n - 1]].split())


def _in_chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches of about ``CHUNK`` bytes of text, with the texts; null texts are empty."""
    for batch in batches:
        begin, held, texts = 0, 0, []
        for i, value in enumerate(batch.column(text)):
            raw = value.as_buffer()
            texts.append(b"" if raw is None else raw.to_pybytes())
            held += len(texts[-1])
            if held >= CHUNK:
                yield batch.slice(begin, i + 1 - begin), texts
                begin, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(begin), texts


def rarity_of(benchmark: DataFrame, bits: int) -> np.ndarray:
    """How often words stand in the benchmark, by the low ``bits`` bits of their hashes."""
    buckets = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, texts in _in_chunks(batches, 0):
            counts += np.bincount((Words(texts).hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    counted = benchmark.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # one row a bucket at most
        out[row["bucket"]] = row["n"]
    return out


def windows_of(benchmark: DataFrame, size: int, count_bits: int = COUNT_BITS) -> DataFrame:
    """``(item_id, n, k, prefix, hash, words)``: an item's windows, each with its rarest word and where in it that stands."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    rarity = rarity_of(items.select("text"), count_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _in_chunks(batches, 1):
            words = Words(texts)
            spans = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
            owner = np.repeat(np.arange(len(texts)), spans)
            at = words.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
            length = np.minimum(words.counts, size)[owner]
            hashes, prefix, place = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                hashes[mine] = words.window_hashes(at[mine], int(n))
                least = np.full(len(mine), np.iinfo(np.int64).max)
                for k in range(int(n)):
                    word = words.hashes[at[mine] + k]
                    count = rarity[(word & np.uint64(len(rarity) - 1)).astype(np.int64)]
                    rarer = (count < least) | ((count == least) & (word < prefix[mine]))
                    least = np.where(rarer, count, least)
                    prefix[mine] = np.where(rarer, word, prefix[mine])
                    place[mine] = np.where(rarer, k, place[mine])
            columns = [
                part.column(0).take(pa.array(owner)), pa.array(length, pa.int32()), pa.array(place, pa.int32()), pa.array(prefix.view(np.int64)),
                pa.array(hashes.view(np.int64)), pa.array([words.text(a, n) for a, n in zip(at, length, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "n", "k", "prefix", "hash", "words"])

    return items.mapInArrow(run, "item_id long, n int, k int, prefix long, hash long, words binary")


def bits_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``2 ** bits`` bits in which those are set that the column ``h`` names by its low bits."""
    bit = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = hashes.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, int(h & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for row in rows.collect():  # one row for 64 bits at most
        out[row["w"]] = row["b"]
    return out


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(64 * len(bits) - 1)
    return (bits.view(np.uint64)[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0


CANDIDATES = "_row long, doc_id long, n_words long, found array<struct<hash: long, n: int, words: binary, starts: array<int>>>"


def candidates(docs: DataFrame, prefixes: np.ndarray, hashes: np.ndarray, places: dict[int, list[int]]) -> DataFrame:
    """``CANDIDATES`` of rows ``(_row, doc_id, text)``: windows whose hash and prefix the filters hold.

    ``places`` has, for each length of a window, the places at which prefixes
    stand. A window must lie within its document: it starts no earlier than the
    first word and ends no later than the last.
    """
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int32()), ("words", pa.binary()), ("starts", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _in_chunks(batches, 2):
            words = Words(texts)
            found: list[dict] = [{} for _ in texts]
            total = len(words.hashes)
            prefix = np.flatnonzero(_held(prefixes, words.hashes))
            for n, offsets in places.items():
                may = np.zeros(total, bool)
                for k in offsets:
                    may[prefix[prefix >= k] - k] = True
                at = np.flatnonzero(may[: max(0, total - n + 1)])
                at = at[words.owner[at] == words.owner[at + n - 1]]
                window = words.window_hashes(at, n)
                for a, h in zip(*((x[_held(hashes, window)].tolist()) for x in (at, window.view(np.int64))), strict=True):
                    doc = int(words.owner[a])
                    text = words.text(a, n)
                    found[doc].setdefault((h, n, text), []).append(a - int(words.first[doc]))
            rows = [[{"hash": h, "n": n, "words": w, "starts": s} for (h, n, w), s in f.items()] for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(words.counts, pa.int64()), pa.array(rows, kind)], ["_row", "doc_id", "n_words", "found"]
            )

    return docs.select("_row", "doc_id", F.col("text").cast("binary")).mapInArrow(run, CANDIDATES)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, filter_bits: int = FILTER_BITS, count_bits: int = COUNT_BITS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items)``, one row per row of ``docs``.

    A window is ``size`` consecutive words of an item, or all words of a shorter
    one; ``n_hit`` counts a document's words inside any occurrence of a window,
    ``items`` are those whose windows occur, sorted as strings, and
    ``items_sha256`` is the digest of their ids with commas between. Containment
    is checked word by word over whole texts.

    One scan of the documents, whatever the benchmark's size: it leaves a row a
    document with its candidates, which are joined with the items' windows by
    hash, those that very many documents have spread over tasks, and compared by
    their words. The filters have a fixed size; a benchmark that fills them makes
    more candidates, not other results.

    Null or wordless texts have no words and no hits; long texts are read whole.
    Items without an id, text or words have no windows; rows that share an item
    id are one item. Repeated documents and null ids count each; empty tables
    give an empty result or no hits; other columns are ignored.
    """
    index = written(windows_of(benchmark, size, count_bits).distinct())
    places: dict[int, list[int]] = {}
    for row in index.select("n", "k").distinct().collect():  # at most size * (size + 1) / 2 rows
        places.setdefault(row["n"], []).append(row["k"])
    prefixes, hashes = (bits_of(index.select(F.col(c).alias("h")), filter_bits) for c in ("prefix", "hash"))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(candidates(rows, prefixes, hashes, places))
    windows = index.groupBy("hash", "n", "words").agg(F.collect_set("item_id").alias("of"))
    seen = written(found.where(F.size("found") > 0).select("_row", F.inline("found")))
    same = windows.select("hash", F.col("n").alias("_n"), F.col("words").alias("_words"), "of")
    hits = spread_join(seen, same, "hash").where("n = _n and words = _words")
    spans = F.array_sort(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("n")).alias("e"))))))
    met = hits.groupBy("_row").agg(spans.alias("_spans"), F.array_distinct(F.flatten(F.collect_list("of"))).alias("items"))
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )
    met = small(written(met.select("_row", covered.alias("n_hit"), F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("items"))))
    out = found.select("_row", "doc_id", "n_words").join(met, "_row", "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        items.alias("items"),
    )


def digest_of(items: set[int]) -> str:
    """``items_sha256`` of a set of item ids."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def oracle(size: int = WINDOW) -> str:
    """DuckDB SQL for ``contaminated`` with windows of ``size`` words."""
    word = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with items as (select item_id, {word} as w from benchmark where item_id is not null),
windows as (
  select distinct item_id, least({size}, len(w)) as n, array_to_string(w[i:i + least({size}, len(w)) - 1], ' ') as t
  from (select *, unnest(range(1, greatest(1, len(w) - {size - 1}) + 1)) as i from items where len(w) > 0)),
docs as (select row_number() over () as r, doc_id, {word} as w from documents),
lengths as (select distinct n from windows),
spans as (select r, n, unnest(range(1, len(w) - n + 2)) as i, w from docs, lengths where len(w) >= n),
hits as (select r, spans.n, i, item_id from (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as t from spans) as spans join windows on windows.n = spans.n and windows.t = spans.t),
places as (select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
named as (select r, list(distinct item_id::varchar order by item_id::varchar) as items from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(items, []) as items
from docs left join places using (r) left join named using (r)"""
