"""WARC archives: written by tasks with one gzip member a record, read back by a sequential reader.

``spark.read.format("skyloom_warc").load(folder)`` gives a row a record.  A task reads one archive after the other as a stream: each member
is decompressed a slice at a time, header lines end at the first empty one, Content-Length tells how many bytes of block follow (and
within the block, of an HTTP message's body), and what follows must be the two line ends that end the record and the member.  Block and
payload are digested as they pass and compared with the record's digests; anything amiss raises a ValueError that names file
and record.  Memory is one slice and one batch of rows, and with the option ``payload`` those rows' payloads, never an archive.

``archive`` writes a response for each page, or a revisit (headers and the digest, no payload) where an earlier page, by
page_id, has the same payload of at least ``least`` bytes.  Which pages those are is found by digests alone; a payload that a large share of
the pages have meets its first page by broadcast, so it isn't gathered in one task.

Nulls: a null html is an empty payload; a null url an empty target; a null page_id stays null and is never the one that others
revisit (pages with null ids alone are responses).  Repeated rows: each has its record; those with the smallest page_id of a payload
are all responses.  Texts of any length go whole (a row is a record).  An empty table gives an empty list of files and no rows.  page_id, url and html
are read alone, so clashing column names don't matter.  White space in a url is percent-encoded in the header.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyloom.llm.hot import with_facts
from skyloom.sources.staging import shared_path, written
from skyloom.sources.stores import FilesWriter, listed, store

SLICE = 1 << 16
BATCH = 1024
#: Fixed values of the format.
END, VERSION = b"\r\n", b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"

READ = "page_id long, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"


# writing ---------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member. ``payload`` is None for a revisit, of which ``size`` and ``digest`` tell what it was."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = hashlib.sha256(http)
    block.update(payload or b"")
    head = {
        "WARC-Type": "response" if payload is not None else "revisit", "WARC-Record-ID": f"<{NAME}{'' if page_id is None else page_id}>", "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url), "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{block.hexdigest()}",
    }
    if payload is None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{NAME}{refers_to}>"}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"Content-Length: %d" % (len(http) + len(payload or b"")), b"", b""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([z.compress(END.join(lines)), z.compress(http), z.compress(payload or b""), z.compress(2 * END), z.flush()])


class WarcWriter(FilesWriter):
    ending = ".warc.gz"

    def __init__(self, path: str, file_bytes: int, date: str):
        super().__init__(path)
        self.file_bytes, self.date = file_bytes, date

    def blobs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
        held = 0
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b[c][r].as_py() for c in ("page_id", "url", "payload", "size", "digest", "refers_to")}
                piece = record(**row, date=self.date)
                yield piece
                held += len(piece)
                if held >= self.file_bytes:
                    yield None
                    held = 0


# reading ---------------------------------------------------------------------------------------------------------


class Member:
    """One gzip member of a stream, decompressed as far as it is asked for."""

    def __init__(self, stream, raw: bytes):
        self.stream, self.raw, self.out, self.z = stream, raw, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        while not self.z.eof:
            got = self.z.decompress(self.raw, SLICE)
            self.raw = self.z.unconsumed_tail
            if got:
                self.out += got
                return True
            if not self.raw and not self.z.eof:
                self.raw = self.stream.read(SLICE)
                if not self.raw:
                    raise ValueError("the archive ends within a member")
        return False

    def line(self) -> bytes:
        at = 0
        while (end := self.out.find(END, at)) < 0:
            at = max(0, len(self.out) - 1)
            if not self.more():
                raise ValueError("the member ends within a header")
        out, self.out = self.out[:end], self.out[end + len(END) :]
        return out

    def headers(self) -> dict[str, str]:
        found: dict[str, str] = {}
        while line := self.line():
            name, colon, value = line.decode().partition(":")
            if not colon:
                raise ValueError(f"a header line has no colon: {line[:80]!r}")
            found[name.strip().lower()] = value.strip()
        return found

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.out and not self.more():
                raise ValueError(f"{size} bytes are missing")
            piece, self.out = self.out[:size], self.out[size:]
            size -= len(piece)
            yield piece

    def rest(self) -> bytes:
        """What follows the member in the stream; the member must be at its end."""
        if self.out or self.more():
            raise ValueError("there is more in the member than its record")
        return self.z.unused_data


class _Block:
    """A block's bytes as ``Member`` has them, digested as they pass, no more than Content-Length."""

    def __init__(self, member: Member, size: int):
        self.pieces, self.out, self.left, self.digest = member.take(size), b"", size, hashlib.sha256()

    def more(self) -> bool:
        piece = next(self.pieces, b"")
        self.digest.update(piece)
        self.left -= len(piece)
        self.out += piece
        return bool(piece)

    line, headers = Member.line, Member.headers


def _page(name: str) -> int | None:
    digits = name.strip("<>").removeprefix(NAME)
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def _told(head: dict[str, str], name: str) -> str | None:
    kind, _, value = head.get(name, "").partition(":")
    return value.lower() if kind.lower() == "sha256" else None


def records(stream, with_payload: bool = False) -> Iterator[tuple]:
    """A row of ``READ`` for each record of an archive, in order."""
    raw, number = b"", 0
    while raw := raw or stream.read(SLICE):
        try:
            member = Member(stream, raw)
            if member.line() != VERSION:
                raise ValueError("no WARC/1.1 record")
            head = member.headers()
            block = _Block(member, int(head["content-length"]))
            payload, digest, size = [], hashlib.sha256(), None
            if head.get("content-type", "").startswith("application/http"):
                block.line()
                size = int(block.headers().get("content-length", -1))
            body = 0
            while block.out or block.more():
                piece, block.out = block.out, b""
                digest.update(piece)
                body += len(piece)
                if with_payload:
                    payload.append(piece)
            for _ in range(2):
                if member.line():
                    raise ValueError("a block is longer than its Content-Length")
            raw = member.rest()
            if (told := _told(head, "warc-block-digest")) and told != block.digest.hexdigest():
                raise ValueError("the block's digest differs")
            own, told, revisit = digest.hexdigest(), _told(head, "warc-payload-digest"), head.get("warc-type") == "revisit"
            if not revisit and (told and told != own or size not in (None, -1, body)):
                raise ValueError("the payload's digest or length differs")
        except (ValueError, KeyError, zlib.error) as e:
            raise ValueError(f"record {number}: {e}") from e
        refers = _page(head["warc-refers-to"]) if "warc-refers-to" in head else None
        found = (told, size) if revisit else (own, body)
        yield _page(head.get("warc-record-id", "")), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), found[1], found[0], refers, b"".join(payload) if with_payload and not revisit else None
        number += 1


class Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p, _ in listed(self.path, ".warc.gz")] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in READ.split(", ")])
        with store(self.path)[0].open_input_stream(partition.path, compression=None) as stream:
            rows: list[tuple] = []
            try:
                for row in records(stream, self.with_payload):
                    rows.append(row)
                    if len(rows) == (16 if self.with_payload else BATCH):
                        yield batch(rows)
                        rows = []
            except ValueError as e:
                raise ValueError(f"{partition.path}: {e}") from e
            if rows:
                yield batch(rows)


class WarcSource(DataSource):
    """Options: path; reading: payload (true to have it); writing: file_bytes (of an archive, about), date (of the records)."""

    @classmethod
    def name(cls) -> str:
        return "skyloom_warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 1 << 28)), self.options.get("date", "2024-01-01T00:00:00Z"))


def archive(pages: DataFrame, out: str, least: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the pages' records to archives in the new folder ``out``."""
    pages.sparkSession.dataSource.register(WarcSource)
    text = F.coalesce(html, F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), text.cast("binary").alias("payload"), F.octet_length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("digest"))
    same = rows.filter(F.col("size") >= least).groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = written(same.filter("n > 1"), "payloads")
    rows = with_facts(rows.withColumn("same", F.when(F.col("size") >= least, F.col("digest"))), "same", same, "n", ["page_id", "url"])
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    rows = rows.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", F.when(again, F.col("first")).alias("refers_to"))
    rows.write.format("skyloom_warc").mode("append").save(out)


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("skyloom_warc").option("payload", str(payload).lower()).load(folder)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    out = shared_path(pages.sparkSession, "warc")
    archive(pages, out, least)
    return read(pages.sparkSession, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
