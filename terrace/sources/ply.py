"""PLY files of vertices and triangles as a Spark data source, and their writer."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Scalar types of the format: struct code and whether a whole number (fixed values).
SCALARS = {"char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d"}
ALIASES = {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "float64": "double"}


#: Rows that are read at a time.
BATCH = 1 << 17


@dataclass
class Element:
    """A table of a PLY file: its rows, scalar columns, and whether it is a list of indices."""

    name: str
    rows: int
    columns: list[tuple[str, str]] = field(default_factory=list)
    listed: tuple[str, str, str] | None = None

    @property
    def stride(self) -> int:
        return sum(struct.calcsize("<" + SCALARS[t]) for _, t in self.columns)


@dataclass
class Header:
    binary: bool
    elements: list[Element]
    size: int


def read_header(path: str) -> Header:
    """The header of a file; raises ``ValueError`` for what the format or this reader doesn't know."""
    with open(path, "rb") as f:
        raw = f.read(1 << 20)
    end = raw.find(b"end_header\n")
    if not raw.startswith(b"ply\n") or end < 0:
        raise ValueError("not a PLY file with Unix line ends")
    kind, elements = None, []
    for line in raw[:end].decode("ascii").split("\n")[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            kind = words[1]
        elif words[0] == "element":
            elements.append(Element(words[1], int(words[2])))
        elif words[0] == "property" and elements:
            types = [ALIASES.get(w, w) for w in words[1:-1] if w != "list"]
            if any(t not in SCALARS for t in types):
                raise ValueError(f"unknown type in: {line}")
            if words[1] == "list":
                elements[-1].listed = (words[-1], types[0], types[1])
            else:
                elements[-1].columns.append((words[-1], types[0]))
        else:
            raise ValueError(f"unknown header line: {line}")
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"unsupported format {kind}")
    return Header(kind != "ascii", elements, end + len(b"end_header\n"))


class PlyDataSource(DataSource):
    """``spark.read.format("ply").option("element", "vertex").load(path)``: rows with their ``idx``.

    Vertices and triangles ``a, b, c`` of a binary file have a fixed size, so byte
    ranges of them are read in parallel, as arrays; a text file is read in order.
    The path must be readable on every machine.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _element(self) -> tuple[Header, Element]:
        header = read_header(self.options["path"])
        name = self.options.get("element", "vertex")
        for e in header.elements:
            if e.name == name:
                return header, e
        raise ValueError(f"no element {name}")

    def schema(self) -> StructType:
        _, e = self._element()
        if e.listed:
            return StructType([StructField(n, LongType()) for n in ("idx", "a", "b", "c")])
        return StructType([StructField("idx", LongType()), *(StructField(n, DoubleType() if t in ("float", "double") else LongType()) for n, t in e.columns)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(self.options["path"], *self._element(), int(self.options.get("rowsPerPartition", "1000000")))


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PlyReader(DataSourceReader):
    def __init__(self, path: str, header: Header, element: Element, step: int):
        self.path, self.header, self.element, self.step = path, header, element, step

    def partitions(self) -> list[InputPartition]:
        n = self.element.rows
        if not self.header.binary:
            return [Rows(0, n)]
        return [Rows(k, min(n, k + self.step)) for k in range(0, n, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        yield from (self._binary if self.header.binary else self._text)(partition)

    def _before(self) -> list[Element]:
        return self.header.elements[: self.header.elements.index(self.element)]

    def _text(self, partition: Rows) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(self.header.size)
            lines = (x for x in f.read().decode("ascii").split("\n") if x.strip())
            for _ in range(sum(e.rows for e in self._before())):
                next(lines)
            for k in range(self.element.rows):
                words = next(lines, "").split()
                if self.element.listed:
                    yield (k, *_triangle([int(w) for w in words]))
                elif len(words) != len(self.element.columns):
                    raise ValueError(f"row {k} has {len(words)} values")
                else:
                    yield (k, *(float(w) if t in ("float", "double") else int(w) for w, (_, t) in zip(words, self.element.columns, strict=True)))

    def _binary(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        e = self.element
        if any(x.listed for x in self._before()):
            raise ValueError("an element behind a list can't be found without reading it")
        if e.listed:
            kind = np.dtype([("n", "<" + SCALARS[e.listed[1]]), ("abc", "<" + SCALARS[e.listed[2]], 3)])
        else:
            kind = np.dtype([(name, "<" + SCALARS[t]) for name, t in e.columns])
        start = self.header.size + sum(x.stride * x.rows for x in self._before())
        with open(self.path, "rb") as f:
            f.seek(start + partition.first * kind.itemsize)
            for k in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - k)
                rows = np.frombuffer(_exactly(f, n * kind.itemsize), kind)
                if e.listed and (rows["n"] != 3).any():
                    raise ValueError("only triangles are supported")
                if e.listed:
                    columns = {name: rows["abc"][:, i].astype(np.int64) for i, name in enumerate("abc")}
                else:
                    columns = {name: rows[name].astype(np.float64 if t in ("float", "double") else np.int64) for name, t in e.columns}
                yield pa.RecordBatch.from_pydict({"idx": np.arange(k, k + n), **columns})


def _exactly(f, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) != n:
        raise ValueError("the file is cut off")
    return raw


def _triangle(values: list[int]) -> tuple[int, int, int]:
    if values[:1] != [3] or len(values) != 4:
        raise ValueError("only triangles are supported")
    return values[1], values[2], values[3]


#: Columns of a cloud of splats (fixed values of the format), and how many colour terms may follow them.
SPLAT = ("x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
COLOUR_TERMS = (0, 9, 24, 45)


def splat_columns(names: list[str]) -> tuple[int, list[str]]:
    """How many further colour terms a cloud of splats has, and its unknown columns; raises if it is none.

    All of ``SPLAT`` must be there, each name once; terms ``f_rest_0`` on must be
    as many as some degree has, without a gap.
    """
    missing = [c for c in SPLAT if c not in names]
    if missing or len(set(names)) != len(names):
        raise ValueError(f"columns are missing or come twice: {missing or names}")
    terms = {n for n in names if n.startswith("f_rest_")}
    if len(terms) not in COLOUR_TERMS or terms != {f"f_rest_{k}" for k in range(len(terms))}:
        raise ValueError(f"{len(terms)} colour terms belong to no degree, or have a gap")
    return len(terms), [n for n in names if n not in SPLAT and n not in terms]


def splats(df: DataFrame) -> DataFrame:
    """Rows of a cloud of splats with ``rest``, an array of the further colour terms, in place of their columns; unknown ones go."""
    terms, _ = splat_columns([c for c in df.columns if c != "idx"])
    rest = F.array(*(F.col(f"f_rest_{k}") for k in range(terms))) if terms else F.array().cast("array<double>")
    return df.select("idx", *SPLAT, rest.alias("rest"))


def write_ply(path: str, vertices: list[tuple], triangles: list[tuple[int, int, int]], columns: tuple[str, ...] = ("x", "y", "z")) -> None:
    """A binary file of float columns and triangles; written aside and renamed once whole."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(vertices)}", *(f"property float {c}" for c in columns)]
    head += [f"element face {len(triangles)}", "property list uchar int vertex_indices", "end_header", ""]
    with open(f"{path}.tmp", "wb") as f:
        f.write("\n".join(head).encode())
        for v in vertices:
            f.write(struct.pack(f"<{len(columns)}f", *v))
        for t in triangles:
            f.write(struct.pack("<B3i", 3, *t))
    os.replace(f"{path}.tmp", path)
