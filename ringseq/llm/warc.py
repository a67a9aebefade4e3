"""Web archives as a table of chunks.

A payload is a run of rows: record identifier, chunk number, bytes. write_chunks() makes archives of such a table, one for
each partition, each record a gzip member of its own as is usual for archives; write() does so from whole payloads, which it
takes one at a time, in slices of the batch that came, without a copy. read() gives the table back: one row for each chunk of
a record's payload, with the digest and length of the payload up to and with this chunk; the last chunk's are the whole
payload's, and a response whose declared digest is another is an error. Neither side ever holds a record that comes in chunks:
a writer keeps a batch of them, a reader one. Archives are split between tasks by file.

Records of equal payloads are written once (see roles()): the others are revisit records that name the first by its
identifier and carry its digest and length in their header.

Defined results: a null identifier is written empty and read as one; null payloads are empty; an empty payload is one chunk of no bytes; repeated rows (same identifier and
payload) are all responses if they are the one to keep; an empty table gives archives of no records; chunks that are missing,
or don't add up to the declared length, are an error.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_at_end, new_dir, save, ship

#: Lines of a WARC 1.1 record (fixed values).
VERSION = b"WARC/1.1\r\n"
SAME_DIGEST = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, record_type string, uri string, refers_to string, declared_digest string, declared_bytes long, chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean, headers map<string,string>"
_ID = re.compile(r"<urn:page:(.*)>", re.S)


def roles(pages: DataFrame, shared_from: int = 1000) -> DataFrame:
    """pages (page_id, uri, payload) with digest (SHA-1, hex), bytes, and refers_to: the largest page_id of equal payloads of at
    least shared_from bytes, null for that record itself and for all others.

    Only digests that several records share are joined back. They are written first, so that the join has exchanges of its
    own and adaptive execution can split a digest of very many records.
    """
    rows = pages.select("page_id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("bytes"))
    shared = rows.where(F.col("bytes") >= shared_from).groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = save(shared, "digests")
    joined = rows.join(shared, (rows["digest"] == shared["d"]) & (rows["bytes"] == shared["b"]), "left")
    return joined.select("page_id", "uri", "payload", "digest", "bytes", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def open_file(path: str, mode: str) -> BinaryIO:
    """A file of any store that pyarrow knows, by URI; one that ends in .gz is unpacked as it is read."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if mode == "rb":
        return gzip.GzipFile(fileobj=store.open_input_stream(inner, compression=None)) if path.endswith(".gz") else store.open_input_stream(inner, compression=None)
    return store.open_output_stream(inner, compression=None)


def rename(path: str, to: str) -> None:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    target = fs.FileSystem.from_uri(to)[1]
    if store.get_file_info(target).type != fs.FileType.NotFound:  # of an attempt whose executor was lost
        store.delete_file(target)
    store.move(inner, target)


def _clean(value: object) -> str:
    """A header's value on one line; %, CR and LF are written as in URIs."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _head(record_id: str, uri: str | None, digest: str, n: int, refers_to: str | None) -> bytes:
    revisit = refers_to is not None
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Bytes", n),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", 0 if revisit else n),
    ]
    if uri is not None:
        lines.append(("WARC-Target-URI", uri))
    if revisit:
        lines += [("WARC-Profile", SAME_DIGEST), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return VERSION + "".join(f"{k}: {_clean(v)}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n"


#: A row for the writer: record_id, uri, digest, bytes, refers_to, chunk, data.
Chunk = tuple[str | None, str | None, str, int, str | None, int, memoryview]


def write_records(out: BinaryIO, chunks: Iterable[Chunk], packed: bool = True) -> int:
    """Write records whose chunks come in order, each as a gzip member; the number of records."""
    n, member, left, due = 0, None, 0, 0

    def end() -> None:
        if left:
            raise ValueError(f"{left} bytes of a record are missing")
        member.write(b"\r\n\r\n")
        if packed:
            member.close()

    try:
        for record_id, uri, digest, size, refers_to, chunk, data in chunks:
            if chunk == 0:
                if member is not None:
                    end()
                member = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=3, mtime=0) if packed else out
                member.write(_head(record_id or "", uri, digest, size, refers_to))
                left, n = 0 if refers_to is not None else size, n + 1
            elif chunk != due:
                raise ValueError(f"chunk {due} of record {record_id} is missing")
            due = chunk + 1
            if refers_to is None:
                if len(data) > left:
                    raise ValueError(f"record {record_id} is longer than declared")
                member.write(data)
                left -= len(data)
        if member is not None:
            end()
    finally:
        if packed and member is not None:
            member.close()
    return n


_FILES = "file string, records long, bytes long"


def _archives(rows: DataFrame, path: str | None, chunks_of_batch: Callable[[pa.RecordBatch], Iterator[Chunk]]) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    own, path = path is None, path or new_dir(spark, "warc")
    _make(spark, path)
    if own:
        drop_at_end(spark, path)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        to = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        part = f"{to}.{uuid.uuid4().hex}.open"
        with open_file(part, "wb") as out:
            n = write_records(out, (c for b in batches for c in chunks_of_batch(b)))
            size = out.tell()
        rename(part, to)
        yield pa.RecordBatch.from_pydict({"file": [to], "records": [n], "bytes": [size]})

    done = rows.mapInArrow(f, _FILES)
    return spark.createDataFrame(done.collect(), done.schema)  # one row for each archive


def write(records: DataFrame, path: str | None = None, slice_bytes: int = 1 << 20) -> DataFrame:
    """records: page_id, uri, payload, digest, bytes, refers_to. Writes archives below path (in the shared folder by default)
    and returns their list: file, records, bytes. A task that runs again replaces its own file."""

    def chunks(b: pa.RecordBatch) -> Iterator[Chunk]:
        names = [c.to_pylist() for c in b.columns[1:]]
        for payload, *own in zip(b.column(0), *names):
            view = memoryview(payload.as_buffer())  # of the batch: no copy
            for k, i in enumerate(range(0, max(1, len(view)), slice_bytes)):
                yield *own, k, view[i : i + slice_bytes]

    rows = records.select("payload", F.col("page_id").cast("string").alias("record_id"), "uri", "digest", "bytes", F.col("refers_to").cast("string").alias("refers_to"))
    return _archives(rows, path, chunks)


def write_chunks(chunks: DataFrame, path: str | None = None) -> DataFrame:
    """The same from a table of chunks: record_id, uri, digest, bytes (of the whole payload), refers_to, chunk, data."""

    def rows(b: pa.RecordBatch) -> Iterator[Chunk]:
        names = [c.to_pylist() for c in b.columns[1:]]
        for data, *own in zip(b.column(0), *names):
            yield *own, memoryview(data.as_buffer() or b"")

    table = chunks.select(F.coalesce("data", F.lit(b"")).alias("data"), F.col("record_id").cast("string").alias("record_id"), "uri", "digest", F.col("bytes").cast("long").alias("bytes"), F.col("refers_to").cast("string").alias("refers_to"), F.col("chunk").cast("int").alias("chunk"))
    return _archives(table.repartition("record_id").sortWithinPartitions("record_id", "chunk"), path, rows)


def _make(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def chunks_of(file: BinaryIO, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of CHUNKS, streaming."""
    held = b""

    def line() -> bytes:
        nonlocal held
        while (i := held.find(b"\n")) < 0:
            more = file.read(1 << 16)
            if not more:
                out, held = held, b""
                return out
            held += more
        out, held = held[: i + 1], held[i + 1 :]
        return out

    def take(n: int) -> bytes:
        nonlocal held
        if len(held) < n:
            held += file.read(n - len(held))
        out, held = held[:n], held[n:]
        return out

    while True:
        start = line()
        while start.strip() == b"" and start:
            start = line()
        if not start:
            return
        if not start.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {start[:40]!r}")
        headers: dict[str, str] = {}
        while (h := line()).strip():
            k, _, v = h.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            headers[k.lower()] = _plain(v)
        left, n, so_far, digest = int(headers["content-length"]), 0, 0, hashlib.sha1()
        identifier = lambda k: (m := _ID.fullmatch(headers.get(k, ""))) and m[1]
        own = (identifier("warc-record-id") or "", headers.get("warc-type", ""), headers.get("warc-target-uri"), identifier("warc-refers-to"), headers.get("warc-payload-digest", "").removeprefix("sha1:"), int(headers.get("x-payload-bytes", left)))
        while True:
            data = take(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise EOFError(f"record {own[0]} ends early")
            left -= len(data)
            so_far += len(data)
            digest.update(data)
            if not left and own[1] == "response" and own[4] and own[4] != digest.hexdigest():
                raise ValueError(f"the payload of record {own[0]} is not of its digest {own[4]}")
            yield (*own, n, data, so_far, digest.hexdigest(), left == 0, headers if n == 0 else None)
            n += 1
            if not left:
                break


def read(spark: SparkSession, files: DataFrame, chunk_bytes: int = 1 << 18, keep_data: bool = True) -> DataFrame:
    """The chunk table of archives; files has a column file. Without keep_data the bytes are digested and left out."""
    ship(spark)
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string())]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with open_file(path, "rb") as file:
                    for row in chunks_of(file, chunk_bytes):
                        rows.append((*row[:11], list(row[11].items()) if row[11] else None) if keep_data else (*row[:7], None, *row[8:11], None))
                        held += len(rows[-1][7] or b"") + 500
                        if held > 4 << 20:
                            yield give(rows)
                            rows, held = [], 0
                yield give(rows)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(f, CHUNKS)
