"""A package of typed chunks in one file: aligned, hashed, and compressed where that pays.

Layout, little-endian: a header of 64 bytes (8 of magic, major and minor version
u16, u32 0, table offset u64, chunks u32, u32 0, SHA-256 of all that follows);
chunks at multiples of 64 bytes; a table of 64 bytes a chunk (type u32, flags
u32, offset, stored size and size u64, SHA-256 of the content).
"""

from __future__ import annotations

import hashlib
import os
import struct
from dataclasses import dataclass

MAGIC = b"TERRPKG\x00"
HEADER, ENTRY = struct.Struct("<8sHHIQII32s"), struct.Struct("<IIQQQ32s")
REQUIRED, ZSTD = 1, 2
ALIGN, MOST_RATIO, LEVEL = 64, 256, 3


@dataclass(frozen=True)
class Chunk:
    type: int
    content: bytes
    required: bool = True
    compress: bool = False


class Corrupt(ValueError):
    """The file breaks a rule of the format."""


def write_chunks(path: str, chunks: list[Chunk]) -> None:
    """Writes a package; types must differ. A chunk is compressed if that makes it smaller, but not beyond ``MOST_RATIO``."""
    import zstandard

    if not chunks or len({c.type for c in chunks}) != len(chunks):
        raise ValueError("a package needs chunks of different types")
    body, table = bytearray(), bytearray()
    for c in chunks:
        body += bytes(-len(body) % ALIGN)
        stored, flags = c.content, REQUIRED * c.required
        if c.compress:
            small = zstandard.ZstdCompressor(level=LEVEL).compress(c.content)
            if len(small) < len(stored) and len(stored) <= MOST_RATIO * len(small):
                stored, flags = small, flags | ZSTD
        table += ENTRY.pack(c.type, flags, HEADER.size + len(body), len(stored), len(c.content), hashlib.sha256(c.content).digest())
        body += stored
    body += bytes(-len(body) % ALIGN)
    offset = HEADER.size + len(body)
    body += table
    head = HEADER.pack(MAGIC, 1, 0, 0, offset, len(chunks), 0, hashlib.sha256(body).digest())
    with open(f"{path}.tmp", "wb") as f:
        f.write(head + body)
    os.replace(f"{path}.tmp", path)


def read_chunks(raw: bytes, known: set[int] | None = None, most_bytes: int = 1 << 43) -> list[Chunk]:
    """The chunks of a package; raises ``Corrupt`` naming the broken rule. Unknown chunks pass unless required."""
    import zstandard

    if len(raw) < HEADER.size:
        raise Corrupt("size")
    magic, major, _, _, offset, n, _, digest = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise Corrupt("magic")
    if major != 1:
        raise Corrupt("version")
    if not n or offset < HEADER.size or offset + n * ENTRY.size > len(raw):
        raise Corrupt("table")
    if hashlib.sha256(raw[HEADER.size :]).digest() != digest:
        raise Corrupt("content hash")
    entries = [ENTRY.unpack_from(raw, offset + k * ENTRY.size) for k in range(n)]
    if len({e[0] for e in entries}) != n:
        raise Corrupt("duplicate type")
    ends = HEADER.size
    for _, _, start, stored, _, _ in sorted(entries, key=lambda e: e[2]):
        if start < ends or start + stored > offset:
            raise Corrupt("overlap")
        ends = start + stored
    out = []
    for kind, flags, start, stored, size, sha in entries:
        if known is not None and kind not in known and flags & REQUIRED:
            raise Corrupt("unknown required chunk")
        if size > most_bytes or (stored and size > MOST_RATIO * stored):
            raise Corrupt("ratio")
        content = raw[start : start + stored]
        if flags & ZSTD:
            try:
                content = zstandard.ZstdDecompressor().decompress(content, max_output_size=size)
            except zstandard.ZstdError as e:
                raise Corrupt("compression") from e
        if len(content) != size or hashlib.sha256(content).digest() != sha:
            raise Corrupt("chunk hash")
        out.append(Chunk(kind, content, bool(flags & REQUIRED), bool(flags & ZSTD)))
    return out


def chunk_rows(spark, path: str):
    """``(file, type, required, compressed, content)`` of all packages under a path, one task a file."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [(f, c.type, c.required, c.compress, c.content) for f, raw in zip(batch["path"], batch["content"], strict=True) for c in read_chunks(raw)]
            yield pd.DataFrame(rows, columns=["file", "type", "required", "compressed", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, type long, required boolean, compressed boolean, content binary")
