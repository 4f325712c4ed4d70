"""WARC archives with revisit resolution.

Headers (page id, digest, length), not payloads, are shuffled by payload digest: of the records with
one payload the largest page id is the original, and a join gives every other header the original it
revisits. Payloads then move once, by page id and digest, so that no frequent payload meets in one
task, and are written to compressed archives with fresh headers; a revisit record has the headers of
its response and no payload. Each record is a gzip member of its
own. A task writes files of bounded size, and one row of the catalogue per file once it is complete:
what an interrupted attempt leaves is in no catalogue and never read.

Defined results: a null html is an empty payload. Payloads under MIN_REVISIT_BYTES are always
responses. Rows that repeat the original's page id and payload are responses too. A null page_id is
smaller than any other; a null url is written as ``urn:page:<id>``. Columns other than page_id, url
and html are passed by. An empty table gives an empty catalogue.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import new_work_dir, slices, table, written

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def _same() -> Column:
    """What tells payloads apart: a hash without known collisions, and the length."""
    return F.concat(F.sha2(_payload(), 256), F.lit(":"), F.octet_length(_payload()).cast("string"))


def resolve(pages: DataFrame) -> DataFrame:
    """payload_key, page_id, original of every page that revisits another one.

    Only keys that occur twice or more are joined; the grouped maximum is taken in every map task
    first, so a payload that a third of the pages share is no load.
    """
    headers = pages.select("page_id", F.octet_length(_payload()).alias("n"), _same().alias("key"))
    large = headers.where(F.col("n") >= MIN_REVISIT_BYTES).select("key", "page_id")
    originals = (
        large.groupBy("key")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("times"))
        .where("times > 1")
        .select("key", "original")
    )
    return large.join(originals, "key").where(~F.col("page_id").eqNullSafe(F.col("original")))


def record_id(page_id: object, digest: str) -> str:
    """The same page and payload always get the same record id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: object, url: str | None, payload: bytes, original: object | None) -> bytes:
    """One WARC record, not compressed; with an original it is a revisit without payload."""
    digest = hashlib.sha1(payload).hexdigest()
    target = (url or f"urn:page:{page_id}").replace("\r", "").replace("\n", "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if original is not None else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        lines += [
            f"WARC-Profile: {_PROFILE}",
            f"WARC-Refers-To: {record_id(original, digest)}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Archive:
    """Files of about FILE_BYTES of compressed records, under names no other attempt uses."""

    def __init__(self, folder: str):
        self._fs, self._folder = fs.FileSystem.from_uri(folder)
        self._uri = folder
        self._stream = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, data: bytes) -> None:
        if self._stream is None:
            self._name = f"{uuid.uuid4().hex}.warc.gz"
            self._size = self._records = 0
            self._stream = self._fs.open_output_stream(
                f"{self._folder}/{self._name}", compression=None
            )
        member = gzip.compress(data, compresslevel=5, mtime=0)
        self._stream.write(member)
        self._size += len(member)
        self._records += 1
        if self._size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self._stream is not None:
            self._stream.close()
            self.done.append((f"{self._uri}/{self._name}", self._size, self._records))
            self._stream = None


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a record below ``folder``; returns the catalogue: path, bytes, records.

    ``folder`` is a URI that every executor can reach.
    """
    revisits = resolve(pages).groupBy("key", "page_id").agg(F.first("original").alias("original"))
    keyed = pages.select("page_id", "url", _payload().alias("payload"), _same().alias("key"))
    found = revisits.select(
        F.col("page_id").alias("by"), F.col("key").alias("by_key"), "original"
    )
    joined = keyed.join(
        found, F.col("page_id").eqNullSafe(F.col("by")) & (F.col("key") == F.col("by_key")), "left"
    ).select("page_id", "url", "payload", "original")
    home = _uri(f"{folder}/archives")
    base, path = fs.FileSystem.from_uri(home)
    base.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(home)
        for part in slices(batches, "payload"):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                archive.add(record(*row))
        archive.close()
        if archive.done:
            paths, sizes, records = zip(*archive.done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(sizes, pa.int64()), pa.array(records, pa.int64())],
                ["path", "bytes", "records"],
            )

    catalogue = joined.mapInArrow(write, "path string, bytes long, records long")
    return written(catalogue, f"{folder}/catalogue")


def _members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, one decompressed record at a time."""
    pending = stream.read(size)
    while pending:
        member, out = zlib.decompressobj(31), io.BytesIO()
        while not member.eof:
            if not pending:
                raise ValueError("an archive ends within a record")
            out.write(member.decompress(pending))
            pending = member.unused_data or (b"" if member.eof else stream.read(size))
        yield out.getvalue()
        pending = pending or stream.read(size)


def parse(data: bytes) -> dict[str, object]:
    """Named fields of one record, and its payload if it has one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, object] = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    fields["payload_bytes"] = int(declared[0].split(b":")[1])
    fields["payload"] = payload if fields["WARC-Type"] == "response" else None
    return fields


_READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "record_id string, refers_to_id string, payload binary"
)


def read_archives(spark: SparkSession, catalogue: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives; a response's payload must have the digest its header states."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for data in _members(stream):
                        r = parse(data)
                        digest = str(r["WARC-Payload-Digest"]).removeprefix("sha1:")
                        if r["payload"] is not None:
                            if hashlib.sha1(r["payload"]).hexdigest() != digest:
                                raise ValueError(f"a payload in {path} is not what its header says")
                        page = r["WARC-Page-ID"]
                        kept = r["payload"] if payloads else None
                        rows.append(
                            (int(page) if page else None, r["WARC-Target-URI"], r["payload_bytes"],
                             digest, r["WARC-Type"], r["WARC-Record-ID"], r.get("WARC-Refers-To"),
                             kept)
                        )
                        held += len(kept or b"")
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return catalogue.select("path").repartition(n, "path").mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary())
    names = [x.split()[0] for x in _READ.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def resolved(records: DataFrame) -> DataFrame:
    """Records with refers_to: the page id of the response a revisit names by record id."""
    responses = (
        records.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.max("page_id").alias("refers_to"))
    )
    return records.join(responses, "refers_to_id", "left")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_work_dir(spark, "warc")
    catalogue = write_archives(spark, table(spark, sf_dir, "pages"), folder)
    return resolved(read_archives(spark, catalogue, payloads=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP6_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n
    FROM pages
), o AS (SELECT html, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
    CASE WHEN o.original IS NULL OR o.original = p.page_id THEN 'response' ELSE 'revisit' END
        AS record_type,
    CASE WHEN o.original <> p.page_id THEN o.original END AS refers_to
FROM p LEFT JOIN o ON p.html = o.html AND p.n >= 1000
"""
