"""Containers, strings and dynamic symbols of binaries.

Reading a container needs its bytes as a whole, so these run in Arrow batches on a binary column.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes of formats.
MAGIC = (
    ("zip", b"PK\x03\x04"), ("gz", b"\x1f\x8b"), ("bz2", b"BZh"), ("xz", b"\xfd7zXZ\x00"), ("elf", b"\x7fELF"),
    ("dex", b"dex\n"), ("class", b"\xca\xfe\xba\xbe"), ("7z", b"7z\xbc\xaf\x27\x1c"), ("rar", b"Rar!\x1a\x07"),
)
#: Containers in containers are opened this deep, and a member is read up to this many bytes; larger ones fail the job by name.
MAX_DEPTH, MAX_MEMBER = 8, 1 << 30


def kind_of(data: bytes) -> str:
    """A format's name by its first bytes; ``tar`` by its header, else ``other``."""
    for name, head in MAGIC:
        if data.startswith(head):
            return name
    return "tar" if data[257:262] == b"ustar" else "other"


def _members(data: bytes, kind: str) -> Iterator[tuple[str, bytes]]:
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    if info.file_size > MAX_MEMBER:
                        raise ValueError(f"member too large: {info.filename}")
                    yield info.filename, z.read(info)
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile():
                    if info.size > MAX_MEMBER:
                        raise ValueError(f"member too large: {info.name}")
                    yield info.name, t.extractfile(info).read()
    else:
        opened = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[kind](io.BytesIO(data))
        inner = opened.read(MAX_MEMBER + 1)
        if len(inner) > MAX_MEMBER:
            raise ValueError("member too large")
        yield "", inner


def components(data: bytes, path: str = "", depth: int = 0) -> Iterator[tuple[str, str, str, int, bytes]]:
    """(digest, kind, inner path, size, content) of all that a file holds, containers opened in turn; the file itself if it is none."""
    kind = kind_of(data)
    if kind in ("zip", "tar", "gz", "bz2", "xz") and depth < MAX_DEPTH:
        for name, inner in _members(data, kind):
            yield from components(inner, "/".join(x for x in (path, name) if x), depth + 1)
    else:
        yield hashlib.sha1(data).hexdigest(), kind, path, len(data), data


def extract(files: DataFrame, id_col: str, content_col: str, with_content: bool = False) -> DataFrame:
    """One row per component of each file: id, digest, kind, inner_path, size. Null content: no row."""
    id_type = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                for digest, kind, path, size, inner in components(data) if data is not None else ():
                    cols = [batch.column(0).slice(i, 1), pa.array([digest]), pa.array([kind]), pa.array([path]), pa.array([size], pa.int64())]
                    names = ["id", "digest", "kind", "inner_path", "size"]
                    if with_content:
                        cols.append(pa.array([inner], pa.binary()))
                        names.append("content")
                    yield pa.RecordBatch.from_arrays(cols, names)

    picked = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{content_col}`").alias("content"))
    return picked.mapInArrow(run, f"id {id_type}, digest string, kind string, inner_path string, size long" + ", content binary" * with_content)


def distinct_components(found: DataFrame) -> DataFrame:
    """Each component once, with all places it was found in."""
    return found.groupBy("digest", "kind").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("inner_path")).alias("inner_paths"), F.count_distinct("id").alias("n_files"))


_RUN = re.compile(rb"[\x20-\x7f][^\x00]*")


def strings_in(data: bytes, least: int = 3) -> list[str]:
    """Constants of a read-only data section: runs from a printable byte up to a zero byte."""
    return [s.decode("latin-1") for s in _RUN.findall(data) if len(s) >= least]


def dynamic_symbols(data: bytes) -> list[tuple[str, str]]:
    """(name, function or object) of the defined symbols in an ELF file's dynamic table; none for other files."""
    if data[:4] != b"\x7fELF":
        return []
    wide, end = data[4] == 2, "<" if data[5] == 1 else ">"
    header = struct.unpack_from(end + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), data, 16)
    at, size, count = header[5], header[10], header[11]
    layout = end + ("IIQQQQIIQQ" if wide else "10I")
    sections = [struct.unpack_from(layout, data, at + i * size) for i in range(count)]
    out = []
    for s in sections:
        if s[1] != 11:  # the dynamic symbol table
            continue
        names = sections[s[6]]
        for k in range(s[5] // s[9]):
            if wide:
                name, info, _, where, _, _ = struct.unpack_from(end + "IBBHQQ", data, s[4] + k * s[9])
            else:
                name, _, _, info, _, where = struct.unpack_from(end + "IIIBBH", data, s[4] + k * s[9])
            kind = {1: "object", 2: "function"}.get(info & 15)
            if kind and where:
                start = names[4] + name
                out.append((data[start : data.index(b"\0", start)].decode("latin-1"), kind))
    return out


def binary_features(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, kind (str, function or object), value of every constant and dynamic symbol of a binary."""
    id_type = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                rows = [("str", s) for s in strings_in(data)] + [(k, n) for n, k in dynamic_symbols(data)] if data else []
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), pa.array([k for k, _ in rows]), pa.array([v for _, v in rows])], ["id", "kind", "value"])

    return files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{content_col}`").alias("content")).mapInArrow(run, f"id {id_type}, kind string, value string")


def is_arm_library(head: Column) -> Column:
    """Whether a file's first bytes are those of a 32-bit ARM shared object, of either byte order."""
    hexed = F.hex(head)
    small = hexed.rlike("^7F454C46" + "01" + "01.{20}" + "0300" + "2800")
    return F.coalesce(small | hexed.rlike("^7F454C46" + "01" + "02.{20}" + "0003" + "0028"), F.lit(False))
