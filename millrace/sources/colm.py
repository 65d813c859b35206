"""The uncompressed columnar exchange format as a Spark data source: ``spark.read.format("colm")``.

Only needed to exchange files; Parquet is the store. A file is read with one partition for
each row group; a folder is read as all its ``.colm`` files. Option ``columns`` (comma
separated) limits what is read. A write makes one file for each task.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format: magic, version, rows of a group, and the types by id.
MAGIC = b"COLM"
VERSION = 1
GROUP_ROWS = 65_536
TYPES = {
    1: (T.ShortType(), pa.int16(), "<i2"),
    2: (T.IntegerType(), pa.int32(), "<i4"),
    3: (T.LongType(), pa.int64(), "<i8"),
    4: (T.StringType(), pa.string(), None),
    5: (T.DateType(), pa.date32(), "<i4"),
    6: (T.TimestampNTZType(), pa.timestamp("us"), "<i8"),
}
_IDS = {type(spark): i for i, (spark, _, _) in TYPES.items()}


@dataclass
class Footer:
    columns: list[tuple[str, int]]
    groups: list[tuple[int, list[tuple[int, int]]]]  # rows, and (offset, size) of each column


def pack_footer(footer: Footer) -> bytes:
    out = [struct.pack("<H", len(footer.columns))]
    for name, kind in footer.columns:
        raw = name.encode()
        out.append(struct.pack("<H", len(raw)) + raw + struct.pack("<B", kind))
    out.append(struct.pack("<I", len(footer.groups)))
    for rows, chunks in footer.groups:
        out.append(struct.pack("<I", rows) + b"".join(struct.pack("<QQ", *c) for c in chunks))
    return b"".join(out)


def unpack_footer(raw: bytes) -> Footer:
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from("<" + form, raw, at)
        at += struct.calcsize("<" + form)
        return out

    columns, groups = [], []
    for _ in range(take("H")[0]):
        (n,) = take("H")
        name = raw[at : at + n].decode()
        at += n
        columns.append((name, take("B")[0]))
    for _ in range(take("I")[0]):
        (rows,) = take("I")
        groups.append((rows, [take("QQ") for _ in columns]))
    return Footer(columns, groups)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a URI (``file:/x`` too) or a local path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def read_footer(path: str) -> Footer:
    system, inner = place(path)
    with system.open_input_file(inner) as f:
        size = f.size()
        if size < 24 or f.read_at(4, 0) != MAGIC:
            raise ValueError(f"{path}: not a COLM file")
        at, magic = struct.unpack("<Q4s", f.read_at(12, size - 12))
        if magic != MAGIC or at > size - 12:
            raise ValueError(f"{path}: damaged trailer")
        return unpack_footer(f.read_at(size - 12 - at, at))


def files_of(path: str) -> list[str]:
    system, inner = place(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in found if x.base_name.endswith(".colm"))


def unpack_chunk(raw: bytes, kind: int, rows: int) -> pa.Array:
    _, arrow, form = TYPES[kind]
    if form:
        return pa.Array.from_buffers(arrow, rows, [None, pa.py_buffer(raw[: rows * np.dtype(form).itemsize])])
    (n,) = struct.unpack_from("<I", raw)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(raw[4 : 8 + 4 * n]), pa.py_buffer(raw[8 + 4 * n :])]).cast(pa.string())


def pack_chunk(column: pa.Array, kind: int) -> bytes:
    if column.null_count:
        raise ValueError("the format has no NULLs; fill defaults before writing")
    _, arrow, form = TYPES[kind]
    if form:
        plain = column.cast(arrow).cast({4: pa.int32(), 8: pa.int64(), 2: pa.int16()}[np.dtype(form).itemsize])
        return plain.to_numpy(zero_copy_only=False).astype(form).tobytes()
    wide = column.cast(pa.large_string()).cast(pa.large_binary())
    _, starts, data = wide.buffers()
    offsets = np.frombuffer(starts, "<i8", len(wide) + 1, wide.offset * 8) if starts is not None and starts.size else np.zeros(1, "<i8")
    first, last = int(offsets[0]), int(offsets[-1])
    if last - first >= 1 << 32:
        raise ValueError("a text chunk of 4 GiB or more")
    body = data.slice(first, last - first).to_pybytes() if data is not None else b""
    return struct.pack("<I", len(wide)) + (offsets - first).astype("<u4").tobytes() + body


@dataclass
class Group(InputPartition):
    path: str
    rows: int
    chunks: list[tuple[int, int, int]]  # type, offset, size


class ColmReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[Group]:
        out = []
        for f in files_of(self.path):
            footer = read_footer(f)
            at = {name: i for i, (name, _) in enumerate(footer.columns)}
            for rows, chunks in footer.groups:
                out.append(Group(f, rows, [(footer.columns[at[c]][1], *chunks[at[c]]) for c in self.columns]))
        return out

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, inner = place(partition.path)
        with system.open_input_file(inner) as f:
            arrays = [unpack_chunk(f.read_at(size, offset), kind, partition.rows) for kind, offset, size in partition.chunks]
        yield pa.RecordBatch.from_arrays(arrays, names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    path: str


class ColmWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.columns = path, [(f.name, _IDS[type(f.dataType)]) for f in schema.fields]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inner = place(self.path)
        system.create_dir(inner, recursive=True)
        target, groups, held = f"{inner}/part-{uuid.uuid4().hex}.colm", [], []
        with system.open_output_stream(target) as out:
            out.write(MAGIC + struct.pack("<HHI", VERSION, len(self.columns), 0))

            def flush(rows: pa.Table) -> None:
                chunks = []
                for i, (_, kind) in enumerate(self.columns):
                    raw = pack_chunk(rows.column(i).combine_chunks(), kind)
                    chunks.append((out.tell(), len(raw)))
                    out.write(raw)
                groups.append((rows.num_rows, chunks))

            for b in batches:
                held.append(b)
                while (n := sum(x.num_rows for x in held)) >= GROUP_ROWS:
                    table = pa.Table.from_batches(held)
                    flush(table.slice(0, GROUP_ROWS))
                    held = table.slice(GROUP_ROWS).to_batches() if n > GROUP_ROWS else []
            if any(x.num_rows for x in held):
                flush(pa.Table.from_batches(held))
            at = out.tell()
            out.write(pack_footer(Footer(self.columns, groups)) + struct.pack("<Q", at) + MAGIC)
        return Written(target)

    def abort(self, messages: list) -> None:
        system, _ = place(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class ColmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "colm"

    def _columns(self) -> list[str] | None:
        chosen = self.options.get("columns")
        return [c.strip() for c in chosen.split(",")] if chosen else None

    def schema(self) -> T.StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']}: no COLM file")
        kinds = dict(read_footer(files[0]).columns)
        return T.StructType([T.StructField(c, TYPES[kinds[c]][0]) for c in self._columns() or kinds])

    def reader(self, schema: T.StructType) -> ColmReader:
        return ColmReader(self.options["path"], schema.fieldNames())

    def writer(self, schema: T.StructType, overwrite: bool) -> ColmWriter:
        if overwrite:
            system, inner = place(self.options["path"])
            if system.get_file_info(inner).type == fs.FileType.Directory:
                for f in files_of(self.options["path"]):
                    system.delete_file(place(f)[1])
        return ColmWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ColmSource)
