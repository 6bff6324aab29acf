import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import types as T

from skyloom.llm import warc
from skyloom.sources.staging import shared_path
from skyloom.sources.stores import listed

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("payload", "size", "digest", "same", "first", "_at"))])

LONG = "é" * 60
ROWS = [
    (1, "https://a.example/x", LONG), (2, "https://b.example/", LONG), (0, "https://c.example/ y\n", LONG + "!"), (3, None, None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "x" * 100), (8, "u", "x" * 100),
    (-3, "neg", "x" * 100), (None, "n", LONG), (None, "n", "z" * 200), (None, "n", "z" * 200), (9, "r", "r" * 300), (9, "r", "r" * 300), (10, "r", "r" * 300), (11, "big", "\r\n\r\nWARC/1.1\r\n" * 90_000), (12, "big", "\r\n\r\nWARC/1.1\r\n" * 90_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *("clash",) * 6) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    out = []
    for page, _, html in rows:
        blob = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        again = len(blob) >= 100 and first is not None and (page is None or page > first)
        out.append((page, len(blob), hashlib.sha256(blob).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[3:4], [(k, "same", "s" * 150) for k in range(3000)]])
def test_round_trip(spark, rows):
    assert sorted(map(tuple, warc.round_trip(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_archives_are_gzip_members_and_payloads_come_back(spark):
    out = shared_path(spark, "warc")
    warc.archive(frame(spark, ROWS), out)
    found = warc.read(spark, out, payload=True).collect()
    assert sorted((r.page_id, r.payload.decode()) for r in found if r.record_type == "response" and r.page_id is not None) == sorted((p, h or "") for p, _, h in ROWS if p in (0, 1, 3, 4, 5, 6, -3, 9, 11))
    assert all(r.payload is None for r in found if r.record_type == "revisit")
    assert "https://c.example/%20y%0A" in {r.url for r in found}
    plain = b"".join(gzip.decompress(open(p, "rb").read()) for p, _ in listed(out, ".warc.gz"))
    assert plain.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)


def one(payload=b"some html", page=1, **more):
    return warc.record(page, "u", payload, len(payload), hashlib.sha256(payload).hexdigest(), None, "2024-01-01T00:00:00Z")


def again(blob, change):
    return gzip.compress(change(zlib.decompress(blob, 31)))


class Slow(io.RawIOBase):
    """A stream that gives a few bytes at a time."""

    def __init__(self, blob):
        self.blob = blob

    def read(self, n=-1):
        out, self.blob = self.blob[:7], self.blob[7:]
        return out


def test_members_across_reads():
    blobs = [one(bytes([65 + k]) * (k * 40_000), k) for k in range(5)]
    for stream in (io.BytesIO(b"".join(blobs)), Slow(b"".join(blobs))):
        assert [(r[0], r[4]) for r in warc.records(stream)] == [(k, k * 40_000) for k in range(5)]
    assert list(warc.records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("blob,what", [
    (one()[:-9], "within a member"), (again(one(), lambda b: b.replace(b"html\r\n\r\n", b"htmL\r\n\r\n")), "digest"), (again(one(), lambda b: b[:-4] + b"xx\r\n\r\n"), "longer than its Content-Length"),
    (again(one(), lambda b: b + b"more"), "more in the member"), (again(one(), lambda b: b[:-30]), "missing"), (again(one(), lambda b: b.replace(b"WARC/1.1", b"HTTP/1.1", 1)), "no WARC"), (b"plain text", "header"),
    (again(one(), lambda b: b.replace(b"Content-Length: 9", b"Content-Length: 8")), "digest"), (gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), "content-length"), (again(one(), lambda b: b.replace(b"WARC-Type: ", b"WARC-Type ")), "colon"),
])
def test_what_is_amiss_raises(blob, what):
    good = one(page=7)
    with pytest.raises(ValueError, match=f"record 1: .*{what}"):
        list(warc.records(io.BytesIO(good + blob)))


def test_records_of_others():
    """No digests, other types, header names in other cases, several lines."""
    plain = b"WARC/1.1\r\nwarc-type: metadata\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    (row,) = warc.records(io.BytesIO(gzip.compress(plain)), with_payload=True)
    assert row == (None, "metadata", None, None, 5, hashlib.sha256(b"hello").hexdigest(), None, b"hello")
