"""FASTA as a Spark data source and as single files, in plain, gzip, bzip2, xz or zstd form.

Reading tells the form by the first bytes of a file, not by its name; tasks look at them, the driver only lists names. Files
without the name of a compressed one are split between tasks by byte ranges, and a record belongs to the range where its '>'
stands; the first range of one that is compressed nevertheless reads it whole. ord is that place, in the uncompressed bytes,
so (file, ord) is the input order. Rows travel in Arrow batches. Files are opened by pyarrow: local paths and the stores it
knows.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ringseq.deploy import ship
from ringseq.functions.exprs import fasta_id, normalize_dna

SCHEMA = "file string, ord bigint, head string, raw_seq string, seq string"
#: First bytes of the compressed forms (fixed values).
MAGIC = {b"\x1f\x8b": "gz", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zst"}
LEVELS = {"gz": 6, "bz2": 9, "xz": 6, "zst": 1}
SPLIT_BYTES = 64 << 20
#: Characters and rows of a batch.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 8192


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" not in path:
        import os

        path = os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    """Files at or below a path, or matching a pattern of names, with their sizes; names that begin with '.' or '_' don't count."""
    from fnmatch import fnmatch

    from pyarrow import fs

    store, inner = _store(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(scheme + inner, info.size)]
    base, pattern = (inner, "*") if info.type == fs.FileType.Directory else inner.rsplit("/", 1)
    if info.type == fs.FileType.NotFound and not any(c in pattern for c in "*?["):
        raise FileNotFoundError(f"No such file or directory: {path}")
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=info.type == fs.FileType.Directory))
    hidden = lambda x: any(name[:1] in (".", "_") for name in x.path[len(base) :].split("/"))
    return sorted((scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch(x.base_name, pattern) and not hidden(x))


def form_of(start: bytes) -> str:
    return next((form for magic, form in MAGIC.items() if start.startswith(magic)), "")


def decoded(raw: BinaryIO, form: str) -> BinaryIO:
    if form == "gz":
        return gzip.open(raw, "rb")
    if form == "bz2":
        return bz2.open(raw, "rb")
    if form == "xz":
        return lzma.open(raw, "rb")
    if form == "zst":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def encoded(raw: BinaryIO, form: str) -> BinaryIO:
    if form == "gz":
        return gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=LEVELS["gz"], mtime=0)
    if form == "bz2":
        return bz2.BZ2File(raw, "wb", compresslevel=LEVELS["bz2"])
    if form == "xz":
        return lzma.LZMAFile(raw, "wb", preset=LEVELS["xz"])
    if form == "zst":
        import zstandard

        return zstandard.ZstdCompressor(level=LEVELS["zst"]).stream_writer(raw, closefd=False)
    if form:
        raise ValueError(f"unknown compression {form!r}")
    return raw


def form_of_name(path: str) -> str:
    end = path.rsplit(".", 1)[-1]
    return end if end in LEVELS else ""


def records(lines: Iterator[bytes], at: int = 0, upto: int | None = None) -> Iterator[tuple[int, str, str, str]]:
    """(place, head, raw_seq, seq) of the records that begin before `upto`. Text before a first '>' is an error."""
    head, body, place = None, [], at
    for line in lines:
        if line.startswith(b">"):
            if head is not None:
                yield _record(place, head, body)
            if upto is not None and at >= upto:
                return
            head, body, place = line[1:].rstrip(b"\r\n"), [], at
        elif head is None:
            if line.strip():
                raise ValueError(f"expected '>' at byte {at}, found {line[:20]!r}")
        else:
            body.append(line.rstrip(b"\r\n"))
        at += len(line)
    if head is not None:
        yield _record(place, head, body)


def _record(place: int, head: bytes, body: list[bytes]) -> tuple[int, str, str, str]:
    while body and not body[-1]:
        body.pop()
    return place, head.decode(), b"\n".join(body).decode(), b"".join(body).decode()


def batches(found: Iterable[tuple[int, str, str, str]], path: str) -> Iterator[pa.RecordBatch]:
    """Records as batches of the schema."""
    rows, held = [], 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.string()] * 3)))], ["file", "ord", "head", "raw_seq", "seq"])
    for row in found:
        rows.append(row)
        held += len(row[2]) + len(row[3])
        if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield give()
            rows, held = [], 0
    if rows:
        yield give()


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """The records that begin in a range of a plain file; all of a compressed one, for the range at its start."""
    store, inner = _store(part.path)
    with store.open_input_file(inner) as raw:
        form = form_of(raw.read(6))
        raw.seek(0)
        if form:
            if not part.start:
                yield from batches(records(io.BufferedReader(_Raw(decoded(raw, form)))), part.path)
            return
        at = max(0, part.start - 1)
        raw.seek(at)
        file = io.BufferedReader(_Raw(raw), 1 << 20)
        if not part.start:
            yield from batches(records(file, 0, part.end), part.path)
            return
        # on to the first line that begins in this range, and there to a record
        at += len(file.readline())
        line = file.readline()
        while line and not line.startswith(b">"):
            at += len(line)
            line = file.readline()
        if line and at < part.end:
            yield from batches(records(_chain(line, file), at, part.end), part.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in _files(self.path):
            step = max(1, size) if form_of_name(path) else max(1, self.split)
            out += [Range(path, i, min(size, i + step)) for i in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return read_range(part) if part.path else iter(())


def _chain(first: bytes, rest: BinaryIO) -> Iterator[bytes]:
    yield first
    yield from rest


class _Raw(io.RawIOBase):
    """Any object with read() as a raw stream."""

    def __init__(self, source):
        self.source = source

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.source.read(len(b))
        b[: len(data)] = data
        return len(data)


@dataclass
class _Done(WriterCommitMessage):
    open_path: str
    path: str


class _Writer(DataSourceArrowWriter):
    """Tasks write to a hidden folder of the job; commit moves their files up, and the folder goes with all that failed tasks left."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.form, self.overwrite, self.job = options["path"], options.get("compression", ""), overwrite, f".job-{uuid.uuid4().hex}"
        self.head, self.seq = names.index("head"), names.index("seq")

    def write(self, rows: Iterator[pa.RecordBatch]) -> _Done:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.fasta" + (f".{self.form}" if self.form else "")
        store, inner = _store(self.path)
        store.create_dir(f"{inner}/{self.job}", recursive=True)
        hidden = f"{inner}/{self.job}/{name}"
        with store.open_output_stream(hidden, compression=None) as raw:
            _put(raw, self.form, (r for b in rows for r in zip(b.column(self.head).to_pylist(), b.column(self.seq).to_pylist())))
        return _Done(hidden, f"{inner}/{name}")

    def commit(self, messages: list[_Done]) -> None:
        from pyarrow import fs

        store, inner = _store(self.path)
        store.create_dir(f"{inner}/{self.job}", recursive=True)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(inner)):
                if x.type == fs.FileType.File and x.base_name.startswith("part-"):
                    store.delete_file(x.path)
        for m in messages:
            if m:
                store.move(m.open_path, m.path)
        store.delete_dir(f"{inner}/{self.job}")

    def abort(self, messages: list[_Done]) -> None:
        from pyarrow import fs

        store, inner = _store(self.path)
        if store.get_file_info(f"{inner}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/{self.job}")


def _put(raw: BinaryIO, form: str, rows: Iterator[tuple[str, str]]) -> None:
    out = encoded(raw, form)
    for head, seq in rows:
        out.write(f">{head or ''}\n{seq or ''}\n".encode())
    if out is not raw:
        out.close()


class FastaDataSource(DataSource):
    """spark.read.format("fasta").load(path); df.write.format("fasta").option("compression", "xz").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FastaDataSource)


def read_fasta(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """file, ord, head, id, raw_seq (with its line breaks), seq."""
    register(spark)
    if "://" not in path:
        _files(path)  # a missing file is an error now, not when the job runs
    df = spark.read.format("fasta").load(path)
    seq = normalize_dna(F.col("seq")) if normalize else F.col("seq")
    return df.select("file", "ord", "head", fasta_id(F.col("head")).alias("id"), "raw_seq", seq.alias("seq"))


def read_stdin(spark: SparkSession, source: BinaryIO | None = None) -> DataFrame:
    """The same from standard input, for the command line; it is read by the driver."""
    if source is None:
        if sys.stdin.isatty():
            raise ValueError("no input: give a file, or pipe FASTA in")
        source = sys.stdin.buffer
    start = io.BufferedReader(_Raw(source), 1 << 20)
    form = form_of(start.peek(6)[:6])
    rows = [("", *r) for r in records(io.BufferedReader(_Raw(decoded(start, form))))]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("file", "ord", "head", fasta_id(F.col("head")).alias("id"), "raw_seq", "seq")


def write_fasta(df: DataFrame, path: str | None, single_file: bool = True, compression: str | None = None) -> None:
    """Records '>head', newline, seq, newline. One file streamed through the driver (compressed by its suffix; None: standard
    output), or a folder of parts written by the executors."""
    if single_file:
        rows = df.select("head", "seq")
        if path is None:
            _put(sys.stdout.buffer, "", ((r[0], r[1]) for r in rows.toLocalIterator()))
            sys.stdout.buffer.flush()
            return
        import os

        if os.path.isdir(path):
            raise IsADirectoryError(f"{path} is a directory: give the name of a file")
        with open(path, "wb") as raw:
            _put(raw, form_of_name(path), ((r[0], r[1]) for r in rows.toLocalIterator()))
        return
    register(df.sparkSession)
    df.select("head", "seq").write.format("fasta").mode("overwrite").option("compression", compression or "").save(path)


def write_table(df: DataFrame, path: str) -> None:
    """Comma-separated, or by tabs for .tsv; the header comes with the first row, so no rows give an empty file."""
    with open(path, "w", newline="") as f:
        out, first = csv.writer(f, delimiter="\t" if path.endswith(".tsv") else ",", lineterminator="\n"), True
        for r in df.toLocalIterator():
            if first:
                out.writerow(df.columns)
                first = False
            out.writerow(["" if x is None else x for x in r])

