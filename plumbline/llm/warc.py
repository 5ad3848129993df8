"""WARC archives through a chunked record table.

Payloads move as rows of (record identifier, chunk number): a payload is cut into chunks in the JVM, the archive writer
streams the chunks of a record one after another into a gzip member, and the reader streams an archive back into chunk
rows that carry the digest so far, so no task ever holds a whole payload beside the row that it came in.

Archives are written to the shared folder: each task writes to a name of its own attempt and renames it when it is
complete, so a repeated task leaves no half archive; the rows that come back name the archives that count.

Of records with equal payloads of at least DEDUP_BYTES bytes, the one with the largest id is a response and the others
revisit it.  A null payload is an empty one.  Rows with equal ids are records of their own (told apart by a number);
those with equal payloads too are each a response.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, stash

CHUNK_BYTES = 64 << 10
DEDUP_BYTES = 1000
SALTS = 32


def decide(records: DataFrame) -> DataFrame:
    """Distinct id, bytes, digest -> with record_type and refers_to.  Groups of copies are salted on both sides."""
    large = records.where(F.col("bytes") >= DEDUP_BYTES)
    groups = large.groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = records.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(salted, ["digest", "bytes", "salt"], "left").select(
        "id", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def _clean(text: str | None) -> str:
    """A header value: no line ends, nothing outside a URI's characters that would break the header."""
    return "".join(c if c.isprintable() and c not in "\r\n" else "%" + format(ord(c) % 256, "02X") for c in text or "")


def _header(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:plumbline:{row['record']}>",
        f"WARC-Target-URI: {_clean(row['url'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Page-ID: {'' if row['id'] is None else row['id']}",
        f"X-Payload-Length: {row['bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else row['bytes']}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:plumbline:page:{row['refers_to']}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class _Archive:
    """A gzip file of one member for each record, written in pieces."""

    def __init__(self, folder: str, name: str):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.path, recursive=True)
        self.final, self.draft = f"{self.path}/{name}.warc.gz", f"{self.path}/_{name}-{uuid.uuid4().hex}"
        self.out, self.member = self.system.open_output_stream(self.draft, compression=None), None

    def begin(self) -> None:
        self.member = zlib.compressobj(3, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self.out.write(self.member.compress(data))

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        self.out.write(self.member.flush())

    def close(self) -> None:
        self.out.close()
        self.system.move(self.draft, self.final)


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes chunk rows (those of a record one after another) as archives; a row for each: archive, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, name, records, record = None, f"part-{TaskContext.get().partitionId():06d}", 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    archive = _Archive(folder, name)
                if row["record"] != record:
                    if record is not None:
                        archive.end()
                    record, records = row["record"], records + 1
                    archive.begin()
                    archive.write(_header(row))
                if row["record_type"] == "response":
                    archive.write(row["data"])
        if archive is not None:
            archive.end()
            archive.close()
            yield pa.RecordBatch.from_pydict({"archive": [archive.final], "records": [records]})

    return chunks.mapInArrow(run, "archive string, records long")


class _Stream:
    """Bytes of the members of a gzip file, read in pieces of bounded size."""

    def __init__(self, source):
        self.source, self.plain, self.raw, self.inflate = source, b"", b"", None

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(CHUNK_BYTES)
                if not self.raw:
                    return False
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(self.raw, CHUNK_BYTES)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            if got:
                self.plain += got
                return True

    def line(self) -> bytes | None:
        while (at := self.plain.find(b"\r\n")) < 0:
            if not self.fill():
                return None
        line, self.plain = self.plain[:at], self.plain[at + 2 :]
        return line

    def take(self, most: int) -> bytes:
        if not self.plain:
            self.fill()
        got, self.plain = self.plain[:most], self.plain[most:]
        return got


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Chunk rows of archives: record, id, url, record_type, refers_to, declared digest and length, chunk, data, and the
    bytes and SHA-1 so far; a record without payload has one chunk of no bytes."""
    names = ["record", "id", "url", "record_type", "refers_to", "declared_digest", "declared_bytes", "chunk", "data", "bytes_so_far", "digest_so_far", "last"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def records(path: str) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(path, compression=None) as source:
            stream = _Stream(source)
            while (line := stream.line()) is not None:
                if not line.startswith(b"WARC/"):
                    continue
                head = {}
                while line := stream.line():
                    key, _, value = line.decode().partition(": ")
                    head[key.lower()] = value
                refers = head.get("warc-refers-to", "").rpartition(":")[2].rstrip(">")
                fixed = (head["warc-record-id"][len("<urn:plumbline:") : -1], int(head["x-page-id"]) if head["x-page-id"] else None, head["warc-target-uri"], head["warc-type"], int(refers) if refers else None, head["warc-payload-digest"].partition(":")[2], int(head["x-payload-length"]))
                left, chunk, digest, done = int(head["content-length"]), 0, hashlib.sha1(), 0
                while left or not chunk:
                    data = stream.take(min(left, CHUNK_BYTES)) if left else b""
                    if left and not data:
                        raise EOFError(f"{path}: a record ends early")
                    left, done = left - len(data), done + len(data)
                    digest.update(data)
                    yield (*fixed, chunk, data, done, digest.hexdigest(), not left)
                    chunk += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in records(path):
                    rows.append(row)
                    size += len(row[8])
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    schema = "record string, id long, url string, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk long, data binary, bytes_so_far long, digest_so_far string, last boolean"
    return archives.select("archive").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Writes a record for every row of pages; the archives (archive, records) and the folder they are in."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    plan = stash(decide(rows.select("id", "bytes", "digest").distinct()), "warc-plan")
    plan = plan.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "record_type", "refers_to")
    records = rows.join(plan, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).drop("_id", "_digest")
    # The number only tells rows apart; a record's chunks follow each other in its task, so the writer needs no sort.
    records = records.withColumn("record", F.concat_ws(":", F.lit("page"), F.col("id").cast("string"), F.monotonically_increasing_id().cast("string")))
    last = F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / CHUNK_BYTES))
    chunks = records.withColumn("chunk", F.explode(F.when(F.col("record_type") == "revisit", F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), last))))
    data = F.when(F.col("record_type") == "response", F.substring(F.col("payload"), F.col("chunk").cast("int") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES))).otherwise(F.lit(b""))
    chunks = chunks.select("record", "id", "url", "bytes", "digest", "record_type", "refers_to", "chunk", data.alias("data"))
    return stash(write_archives(chunks, uri), "warc-archives"), uri


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives that it writes.

    Payload and digest of a response are those of the bytes read; of a revisit, those that its record declares.
    """
    archives, folder = archive_pages(pages)
    read = read_archives(archives.repartition(F.col("archive")), folder).where("last")
    own = F.col("record_type") == "response"
    return read.select(
        F.col("id").alias("page_id"),
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
