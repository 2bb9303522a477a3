"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles gets ``HASHES`` minima. Bands of whole
minima name the buckets in which candidates meet; of the minima themselves only
the low ``BITS`` bits stay, packed into words, and the number of equal groups of
bits, corrected for groups that are equal by chance, estimates the similarity
of a candidate pair. Pairs well below the threshold go; all others are
confirmed on the full sets of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import released, small, spread_join, written
from terrace.llm.components import components
from terrace.llm.hashing import hashed_words, mixed, stream

#: 38 bands of 5: a pair of similarity 0.8 meets in none with probability 3e-7.
BANDS, ROWS, HASHES, BITS = 38, 5, 192, 2
#: Further minima and their low bits, for the documents that the short signatures leave in doubt.
LONG, LONG_BITS = 4096, 2
#: A pair goes unconfirmed only if its estimate is so many standard errors below the threshold.
SLACK = 4.5
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
#: Rounds in which a bucket's members are held against one of them, before all pairs left are.
STAR_ROUNDS = 2
#: Members that a hub is held against in one task.
HUB_PART = 256
#: Members of a bucket that are compared at a time when its pairs are.
BLOCK = 2048

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)

_TIMES = stream(HASHES, 13) | np.uint64(1)
_PLUS = stream(HASHES, 14)
_BAND = stream(BANDS * ROWS, 15) | np.uint64(1)
_LONG_TIMES = stream(LONG, 16) | np.uint64(1)
_LONG_PLUS = stream(LONG, 17)


class Hasher:
    """Shingle hashes of many texts at once."""

    def __init__(self, width: int):
        self.width = width

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingle hashes of each text, ascending and end to end, and how many each has."""
        data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
        starts, _, words = hashed_words(data, _SPACE[data])
        if not len(words):
            return words, np.zeros(len(texts), np.int64)
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, edges)
        counts = np.diff(first)
        spans = np.where(counts >= self.width, counts - self.width + 1, np.minimum(counts, 1))
        owner = np.repeat(np.arange(len(texts)), spans)
        at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
        length = np.minimum(counts, self.width)[owner]
        got = length.astype(np.uint64) * _STEP
        for k in range(self.width):
            there = k < length
            got = np.where(there, mixed(got * np.uint64(3) + words[np.minimum(at + k, len(words) - 1)]), got)
        order = np.lexsort((got, owner))
        got, owner = got[order], owner[order]
        new = np.ones(len(got), bool)
        new[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
        return got[new], np.bincount(owner[new], minlength=len(texts))


def minima(values: np.ndarray, counts: np.ndarray, times: np.ndarray = _TIMES, plus: np.ndarray = _PLUS) -> np.ndarray:
    """Hashes x documents: the 32-bit minima of each document's part of ``values``; no part may be empty."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(times), len(counts)), np.uint32)
    shift, room = np.uint64(32), np.empty(len(values), np.uint64)
    for k in range(len(times)):
        np.multiply(values, times[k], out=room)
        np.add(room, plus[k], out=room)
        np.right_shift(room, shift, out=room)
        out[k] = np.minimum.reduceat(room.astype(np.uint32), starts)
    return out


def packed(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Documents x words: the low bits of the minima, one plane of a bit for each hash after the other."""
    planes = [np.packbits(((low >> np.uint32(b)) & np.uint32(1)).astype(np.uint8).T, axis=1) for b in range(bits)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def digest_of(raw: bytes) -> bytes:
    """128 bits of a cryptographic hash of a text's words in order: texts that share it have equal sets."""
    return blake2b(b" ".join(words_of(raw)), digest_size=16).digest()


def _signed(texts: list[bytes], hasher: Hasher) -> list:
    values, counts = hasher.sets(texts)
    some = counts > 0
    n = len(texts)
    keys = np.zeros((n, BANDS), np.int64)
    sig = np.zeros((n, HASHES * BITS // 64), np.int64)
    if some.any():
        low = minima(values, counts[some])
        wide = low[: BANDS * ROWS].astype(np.uint64) * _BAND[:, None]
        wide = mixed(wide).reshape(BANDS, ROWS, -1)
        band = np.zeros((BANDS, wide.shape[2]), np.uint64)
        for r in range(ROWS):
            band = mixed(band * np.uint64(5) + wide[:, r])
        keys[some] = band.T.view(np.int64)
        sig[some] = packed(low)
    return [counts, [digest_of(t) if k else None for t, k in zip(texts, counts, strict=True)], keys, sig]


SIGNED = "doc_id long, n_shingles long, digest binary, keys array<long>, sig array<long>"


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its set's size, the digest of its words, band keys and packed low bits."""

    def lists(a: np.ndarray) -> pa.Array:
        flat = pa.array(np.ascontiguousarray(a).ravel(), pa.int64())
        return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)

        def emit(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            counts, digests, keys, sig = _signed(texts, hasher)
            columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists(keys), lists(sig)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "keys", "sig"])

        with np.errstate(over="ignore"):
            for batch in batches:
                ids, texts, held = [], [], 0
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = text.as_buffer()
                    raw = b"" if raw is None else raw.to_pybytes()
                    ids.append(i)
                    texts.append(raw)
                    held += len(raw)
                    if held >= CHUNK:
                        yield emit(ids, texts)
                        ids, texts, held = [], [], 0
                if ids:
                    yield emit(ids, texts)

    from_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return from_docs.mapInArrow(run, SIGNED)


def long_signatures(texts: DataFrame, width: int) -> DataFrame:
    """``(doc_id, digest, long_sig)``: low bits of each of ``LONG`` minima for rows ``(doc_id, digest, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    values, counts = hasher.sets(part.column(2).to_pylist())
                    sig = packed(minima(values, counts, _LONG_TIMES, _LONG_PLUS), LONG_BITS)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array([row.tobytes() for row in sig], pa.binary())], ["doc_id", "digest", "long_sig"]
                    )

    return texts.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, long_sig binary")


def estimate(a: Column, b: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """The similarity behind two packed signatures: equal groups of low bits, less those equal by chance."""
    words = hashes // 64
    differ = None
    for w in range(words):
        plane = None
        for k in range(bits):
            x = a[k * words + w].bitwiseXOR(b[k * words + w])
            plane = x if plane is None else plane.bitwiseOR(x)
        count = F.bit_count(plane)
        differ = count if differ is None else differ + count
    chance = 2.0**-bits
    return ((1 - differ / F.lit(float(hashes))) - chance) / (1 - chance)


def floor_of(percent: int, hashes: int = HASHES, bits: int = BITS) -> float:
    """The estimate that a pair at the threshold falls short of only by ``SLACK`` standard errors."""
    chance, j = 2.0**-bits, percent / 100
    p = j + (1 - j) * chance
    return j - SLACK * math.sqrt(p * (1 - p) / hashes) / (1 - chance)


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def shingle_set(raw: bytes, width: int) -> set:
    words = words_of(raw)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs ``(a, digest_a, b, digest_b)`` of nodes, the links ``(a, b)``: those whose full sets are similar enough.

    A hub ``a`` and its members ``b`` come to one task, or, from ``HUB_PART``
    members on, to as many as it takes; the hub's text goes once to each, ahead
    of the members, and its set is made once there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: set = set()
        for batch in batches:
            out_a, out_b = [], []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                own = shingle_set(batch.column(2)[k].as_buffer().to_pybytes(), width)
                if b[k] is None:
                    hub = own
                    continue
                same = len(hub & own)
                if 100 * same >= percent * (len(hub) + len(own) - same):
                    out_a.append(a[k])
                    out_b.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    pairs = written(pairs)
    hub = ["a", "digest_a"]
    big = pairs.groupBy(*hub).agg(F.ceil(F.count("*") / HUB_PART).cast("int").alias("parts")).where("parts > 1")
    dealt = written(
        pairs.join(small(written(big)), hub, "left").withColumn("part", F.pmod(F.xxhash64("b", "digest_b"), F.coalesce(F.col("parts"), F.lit(1))).cast("int")).drop("parts")
    )
    released(pairs)
    members = dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("digest").alias("digest_b"), "text"), ["b", "digest_b"])
    hubs = dealt.select(*hub, "part").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("digest").alias("digest_a"), "text"), hub)
    full = members.select(*hub, "part", "b", "text").unionByName(hubs.select(*hub, "part", F.lit(None).cast("long").alias("b"), "text"))
    met = full.repartition(*hub, "part").sortWithinPartitions(*hub, "part", F.col("b").asc_nulls_first())
    return met.select("a", "b", "text").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their sets
    of ``width``-word shingles (words: runs of anything but ASCII white space,
    A-Z lower-cased; a text of fewer words is one shingle). ``component_id`` is
    the smallest id reachable over links and ``kept`` marks that document.

    Texts of equal words in equal order, by a 128-bit cryptographic digest, are
    one node from the start, whatever their number; all other links are
    confirmed on full sets. In each bucket all members are held against one, its hub, so a bucket costs its
    size; buckets whose members still lie in several components get a second
    hub, and after ``STAR_ROUNDS`` every pair that lies in two components is
    compared. No bucket is cut short.

    Null or wordless texts have an empty set and are linked with nothing. A very
    long text is held by one task at a time, with its set. Rows that share an id are one document that has the links of all of them. Rows
    without an id get a null component and are kept. Other columns are ignored;
    an empty table gives an empty result.
    """
    sign = written(signatures(docs, width, id_col, text_col))
    some = sign.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = written(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    reps = written(
        some.join(small(classes.select(F.col("rep").alias("doc_id"), "digest")), ["doc_id", "digest"], "left_semi")
        .select("doc_id", "n_shingles", "digest", "keys", "sig")
        .dropDuplicates(["doc_id", "digest"])
    )
    several = classes.where("n > 1")
    copies = (
        spread_join(some.select("doc_id", "digest"), several.select("digest", "rep"), "digest", counts=several.select("digest", "n"))
        .where(F.col("doc_id") != F.col("rep"))
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )

    met = reps.select(F.explode("keys").alias("key"), "doc_id")
    shared = written(met.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("hub < last").drop("last"))
    buckets = written(spread_join(met, shared.select("key", "hub"), "key", counts=shared.select("key", "n")))
    released(shared)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    texts = written(
        raw.join(small(written(buckets.select("doc_id").distinct())), "doc_id", "left_semi").mapInArrow(
            _with_digest, "doc_id long, digest binary, text binary"
        )
    )
    facts = reps.select("doc_id", "n_shingles", "digest", "sig")

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs ``(a, b)``."""
        x = facts.select(F.col("doc_id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("n_shingles", "digest", "sig")))
        y = facts.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("n_shingles", "digest", "sig")))
        pairs = written(pairs)
        likely = (
            spread_join(pairs, x, "a")
            .join(y, "b")
            .where(100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
            .where(estimate(F.col("sig_a"), F.col("sig_b")) >= floor_of(percent))
            .select("a", "digest_a", "b", "digest_b")
        )
        out = written(_confirmed(likely, texts, width, percent))
        released(pairs)
        return out

    links = checked(
        buckets.where(F.col("doc_id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    )
    left = buckets.where(F.col("doc_id") != F.col("hub")).select("key", "doc_id")
    for done in range(STAR_ROUNDS):
        joined = components(links)
        placed = left.join(joined, F.col("doc_id") == F.col("id"), "left").select(
            "key", "doc_id", F.coalesce("component", "doc_id").alias("component")
        )
        placed = written(placed)
        parts = (
            placed.groupBy("key")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("doc_id", "component")).alias("hub"), F.count("*").alias("n"))
            .where("low < high")
        )
        parts = written(parts)
        open_ = written(spread_join(placed, parts.select("key", "hub"), "key", counts=parts.select("key", "n")))
        if open_.isEmpty():
            break
        if done < STAR_ROUNDS - 1:
            pairs = open_.where("component != hub.component").select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"))
            left = open_.where("doc_id != hub.doc_id").select("key", "doc_id")
        else:
            pairs = _pairs_left(open_, reps, texts, width, percent)
        links = links.unionByName(checked(pairs.distinct()))
    found = written(components(links.unionByName(copies)))
    rows = sign.select("doc_id", "n_shingles").join(small(found), F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _pairs_left(members: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate pairs ``(a, b)`` of members ``(key, doc_id, component, hub)`` of one bucket in two components.

    Long signatures, made for these members alone, leave few pairs that are not
    links. Of two members in two components one lies outside the hub's, so those
    outside are held against all, both dealt out in blocks of ``BLOCK``: a task
    has one block of either at a time, and only pairs that pass come out, each in
    the first bucket that its members share.
    """
    ids = written(members.select("doc_id").distinct())
    sure = long_signatures(texts.join(small(ids), "doc_id", "left_semi"), width)
    facts = reps.join(small(ids), "doc_id", "left_semi").select("doc_id", "digest", "n_shingles", "keys").join(sure, ["doc_id", "digest"]).drop("digest")
    outside = (F.col("component") != F.col("hub.component")).alias("outside")
    sizes = written(members.groupBy("key").agg(
        F.count("*").alias("n"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks_y"),
        F.ceil(F.sum((F.col("component") != F.col("hub.component")).cast("long")) / BLOCK).cast("int").alias("blocks_x"),
    ))
    dealt = spread_join(members.select("key", "doc_id", "component", outside), sizes.drop("n"), "key", counts=sizes.select("key", "n"))
    full = dealt.join(written(facts), "doc_id")
    own = F.xxhash64("doc_id")
    keep = ["key", "doc_id", "component", "n_shingles", "keys", "long_sig"]
    x = full.where("outside").select(
        *keep, F.lit(0).alias("side"), F.pmod(own, "blocks_x").cast("int").alias("bx"), F.explode(F.expr("sequence(0, blocks_y - 1)")).alias("by")
    )
    y = full.select(
        *keep, F.when(F.col("outside"), 2).otherwise(1).alias("side"), F.explode(F.expr("sequence(0, blocks_x - 1)")).alias("bx"), F.pmod(own, "blocks_y").cast("int").alias("by")
    )
    block = ["key", "bx", "by"]
    least, chance = floor_of(percent, LONG, LONG_BITS), 2.0**-LONG_BITS

    def compared(key: int, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        side, ids, parts, sizes, keys, sigs = rows
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        sigs = sigs.reshape(len(ids), LONG_BITS, -1)
        band = int(np.argmax(keys[0] == key))
        out = [np.empty((2, 0), np.int64)]
        step = max(1, (1 << 20) // max(1, len(y)))
        for at in range(0, len(x), step):
            i = x[at : at + step]
            likely = parts[i][:, None] != parts[y][None, :]
            likely &= 100 * np.minimum(sizes[i][:, None], sizes[y][None, :]) >= percent * np.maximum(sizes[i][:, None], sizes[y][None, :])
            likely &= (side[y] == 1)[None, :] | (ids[i][:, None] < ids[y][None, :])  # two outside: once
            for b in range(band):  # in the first bucket that they share: once
                likely &= keys[i, b][:, None] != keys[y, b][None, :]
            p, q = np.nonzero(likely)
            p, q = i[p], y[q]
            for k in range(0, len(p), 1 << 13):
                m, n = p[k : k + (1 << 13)], q[k : k + (1 << 13)]
                plane = sigs[m, 0] ^ sigs[n, 0]
                for b in range(1, LONG_BITS):
                    plane |= sigs[m, b] ^ sigs[n, b]
                differ = np.bitwise_count(plane).sum(axis=1, dtype=np.int64)
                near = ((1 - differ / LONG) - chance) / (1 - chance) >= least
                out.append(np.stack([ids[m[near]], ids[n[near]]]))
        both = np.concatenate(out, axis=1)
        return both.min(axis=0), both.max(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        name = None

        def done() -> pa.RecordBatch:
            a, b = compared(name[0], [np.concatenate(c) for c in zip(*held, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            side, ids, parts, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7))
            keys = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            sigs = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(len(ids), -1)
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                this = tuple(key[:, start])
                if this != name and held:
                    yield done()
                    held = []
                name = this
                held.append([c[start:end] for c in (side, ids, parts, sizes, keys, sigs)])
        if held:
            yield done()

    dealt = x.unionByName(y).select(*block, "side", "doc_id", "component", "n_shingles", "keys", "long_sig").repartition(*block).sortWithinPartitions(*block)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each text the digest by which rows that share an id are told apart."""
    for batch in batches:
        digests = [digest_of(b"" if t is None else t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), batch.column(1)], ["doc_id", "digest", "text"])


def oracle(width: int, percent: int = 80) -> str:
    """DuckDB SQL for ``near_duplicates`` of ``documents`` without null or repeated ids: all shared shingles, then reachability."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""
with recursive split as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') as w from documents),
shingles as (
  select distinct doc_id, {shingle} as s from (select doc_id, w, unnest(range(1, len(w) - {width - 2})) as i from split where len(w) >= {width})
  union select doc_id, array_to_string(w, ' ') from split where len(w) between 1 and {width - 1}),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
linked as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
ways as (select a, b from linked union all select b, a from linked),
reached as (select doc_id as id, doc_id as low from documents union select b, low from reached join ways on a = id where low < b)
select doc_id, coalesce(n, 0)::bigint as n_shingles, low::bigint as component_id, doc_id = low as kept
from documents join (select id, min(low) as low from reached group by id) on id = doc_id left join sizes using (doc_id)"""
