"""Web archives: one gzip member per record, written once per partition, read sequentially with bounded memory."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import shared_dir

READ_BYTES = 1 << 20
_STREAM = 1 << 16
_BREAK = b"\r\n"


class ArchiveError(ValueError):
    """A record that is not framed as announced, or whose digest differs from its bytes."""


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """Bytes of one record: header lines, blank line, block of the announced length, two line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, block = ("response", http + payload) if refers_to is None else ("revisit", http)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"Content-Length: {len(block)}",
             "Content-Type: application/http; msgtype=response", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + 2 * _BREAK + block + 2 * _BREAK


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class _Members:
    """Decompressed bytes of consecutive gzip members, read piece by piece."""

    def __init__(self, stream):
        self.stream, self.raw, self.out, self.open = stream, b"", b"", zlib.decompressobj(31)
        self.ended = False

    def _more(self) -> bool:
        """Decompress a further piece; false at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(_STREAM)
                if not self.raw:
                    return False
            piece = self.open.decompress(self.raw, READ_BYTES)
            self.raw = self.open.unconsumed_tail or self.open.unused_data
            if self.open.eof:
                self.ended, self.open = True, zlib.decompressobj(31)
            self.out += piece
            if piece or self.ended:
                return True

    def line(self) -> bytes:
        while (at := self.out.find(_BREAK)) < 0:
            if self.ended or not self._more():
                raise ArchiveError("a header line does not end")
        line, self.out = self.out[:at], self.out[at + 2:]
        return line

    def take(self, n: int) -> bytes:
        parts, have = [self.out[:n]], min(n, len(self.out))
        self.out = self.out[n:]
        while have < n:
            if self.ended or not self._more():
                raise ArchiveError("a block is shorter than its content length")
            parts.append(self.out[:n - have])
            have += len(parts[-1])
            self.out = self.out[len(parts[-1]):]
        return b"".join(parts)

    def begin(self) -> bool:
        """Go to the next member; false at the end of the file."""
        self.ended = False
        while not self.out:
            if not self._more():
                return False
        return True

    def finish(self) -> None:
        """The member must end here."""
        while not self.ended:
            if not self._more():
                raise ArchiveError("the archive is cut off")
            if self.out:
                break
        if self.out:
            raise ArchiveError("bytes after the end of a record")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, payload) of every record of an open archive; framing and digests are verified.

    Only one record is held at a time. A revisit has an empty payload and keeps the digest of the original.
    """
    members = _Members(stream)
    while members.begin():
        if not members.line().startswith(b"WARC/"):
            raise ArchiveError("no record begins here")
        header = {}
        while line := members.line():
            name, _, value = line.decode().partition(": ")
            header[name.lower()] = value
        block = members.take(int(header["content-length"]))
        if members.take(4) != 2 * _BREAK:
            raise ArchiveError("a record does not end after its block")
        members.finish()
        if header["warc-block-digest"] != f"sha1:{_digest(block)}":
            raise ArchiveError(f"block digest of {header['warc-record-id']} differs")
        http, _, payload = block.partition(2 * _BREAK)
        header["payload-length"] = next(x[16:].decode() for x in http.split(_BREAK) if x.lower().startswith(b"content-length: "))
        if header["warc-type"] == "response" and header["warc-payload-digest"] != f"sha1:{_digest(payload)}":
            raise ArchiveError(f"payload digest of {header['warc-record-id']} differs")
        yield header, payload


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name, out, n = None, None, 0
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        for batch in batches:
            for page, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                if out is None:
                    name, out = batch.column(0)[0].as_py(), files.open_output_stream(draft, compression=None)
                out.write(_member(_record(page, url, payload, refers_to)))
                n += 1
        if out is not None:
            out.close()
            final = f"{root}/pages-{name:05d}.warc.gz"
            files.move(draft, final)
            yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_bytes: int = 0) -> DataFrame:
    """(path, records) of the archives written to ``folder``, a location that every executor reaches.

    Of records with equal payloads of at least ``least_bytes``, the one with the largest id is written as a response
    and the others as revisits of it; shorter payloads are all responses. Each task writes one archive under a name of
    its own and moves it to its final name at the end, so a task that is tried again replaces nothing but its own
    work. Null payloads are empty. Every row is a record: rows that repeat an id are written as often, and a row with a
    null id is a response or a revisit like any other but never what others refer to. Empty tables write nothing.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    wide = rows.where(F.length("payload") >= least_bytes).select("page", F.sha1("payload").alias("sha1"))
    groups = wide.groupBy("sha1").agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = wide.join(groups, "sha1").where("not page <=> response").select(F.col("page").alias("_page"), "sha1", F.col("response").alias("refers_to")).distinct()
    ready = rows.join(known, F.col("page").eqNullSafe(F.col("_page")) & (F.sha1("payload") == F.col("sha1")), "left")
    ready = ready.withColumn("part", F.spark_partition_id())
    return ready.select("part", "page", "url", "payload", "refers_to").mapInArrow(_write(folder), "path string, records bigint")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for header, payload in read_records(stream):
                        refers = header.get("warc-refers-to")
                        rows.append((_page(header["warc-record-id"]), int(header["payload-length"]), header["warc-payload-digest"].removeprefix("sha1:"),
                                     header["warc-type"], refers and _page(refers), header.get("warc-target-uri"), payload))
                        held += len(payload)
                        if held > READ_BYTES or len(rows) >= 1000:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return run


def _page(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """Records of the archives listed in ``archives`` (path), one archive per task at a time.

    page_id, payload_bytes and payload_digest (both of the full payload, for revisits too), record_type, refers_to,
    url, payload (empty for revisits).
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(width, "path").mapInArrow(_read(folder), (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    base = shared_dir(spark)
    folder = f"{base if ':' in base else 'file://' + base}/archives-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder
