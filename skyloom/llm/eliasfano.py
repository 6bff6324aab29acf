"""Token-id files with Elias-Fano coded document boundaries.

One file holds up to ``file_ids`` ids in ascending document order: the ids concatenated (two bytes each where the
vocabulary allows), the n+1 document boundaries and the document ids, both Elias-Fano coded.  A coded sequence keeps
the low bits of each value packed and the high bits as a unary bit vector, with the position of every 512th set bit
as a 32-bit number; ``select`` starts there and counts bits, so an offset is found without a 64-bit table and n
values below u take about n * (2 + log2(u / n)) bits.

Files are written by Spark's own writer (each task's files appear when its task commits, on any store) and end with
one line end, which is no part of the format.

Nulls: a null text is an empty document (its end id alone); null document ids come first and are counted in the
header.  Repeated rows are documents of their own, ordered by a hash of the text.  An empty table gives no rows.  Texts of any length go
whole: a document's ids lie in one file, which may be larger than ``file_ids`` by one document.  doc_id and text are read alone, so
clashing column names don't matter.  Where files begin is a running sum over one row a file, in one task.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import batched, chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skyloom.llm.pretokens import encoder
from skyloom.sources.staging import shared_path, written

MAGIC, EVERY = b"EFIDS1\0\0", 512
HEADER = struct.Struct("<8sIIQQQIIq")  # magic, part, file, documents, null ids, ids, bytes of an id, 0, first document id
LEAST = HEADER.size
PART = struct.Struct("<QBxxxIII")  # values, low bits, bytes of low bits, of high bits, samples


class EliasFano:
    """A non-decreasing sequence of numbers from 0."""

    def __init__(self, n: int, low: int, lows: bytes, highs: bytes, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        highs[at] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(highs, bitorder="little").tobytes(), at[::EVERY].astype("<u4"))

    def select(self, i: int) -> int:
        """The position of set bit i among the high bits."""
        at = int(self.samples[i // EVERY])
        left, byte = i % EVERY, at >> 3
        word = self.highs[byte] >> (at & 7) << (at & 7)
        while (here := word.bit_count()) <= left:
            left, byte = left - here, byte + 1
            word = self.highs[byte]
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        at = i * self.low
        window = int.from_bytes(self.lows[at >> 3 : (at + self.low + 7) >> 3], "little") >> (at & 7)
        return (self.select(i) - i) << self.low | window & ((1 << self.low) - 1)

    def blocks(self) -> Iterator[np.ndarray]:
        """The values in order, those of one sample at a time: select in a stream."""
        highs, lows, weights = np.frombuffer(self.highs, np.uint8), np.frombuffer(self.lows, np.uint8), np.int64(1) << np.arange(self.low, dtype=np.int64)
        stops = [*self.samples[1:].tolist(), 8 * len(highs)]
        for k, (at, stop) in enumerate(zip(self.samples.tolist(), stops)):
            count, byte = min(EVERY, self.n - k * EVERY), at >> 3
            bits = np.unpackbits(highs[byte : (stop + 7) >> 3], bitorder="little")
            bits[: at & 7] = 0
            high = np.flatnonzero(bits)[:count] + 8 * byte - np.arange(k * EVERY, k * EVERY + count)
            low = np.unpackbits(lows[k * EVERY * self.low // 8 :][: (count * self.low + 7) // 8], bitorder="little", count=count * self.low)
            yield high.astype(np.int64) << self.low | low.reshape(count, self.low).astype(np.int64) @ weights

    def decode(self) -> np.ndarray:
        highs = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little")) - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little", count=self.n * self.low)
        lows = bits.reshape(self.n, self.low).astype(np.int64) @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return highs.astype(np.int64) << self.low | lows

    def to_bytes(self) -> bytes:
        return PART.pack(self.n, self.low, len(self.lows), len(self.highs), len(self.samples)) + self.lows + self.highs + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, blob, at: int) -> tuple[EliasFano, int]:
        n, low, a, b, c = PART.unpack_from(blob, at)
        at += PART.size
        return cls(n, low, bytes(blob[at : at + a]), bytes(blob[at + a : at + a + b]), np.frombuffer(blob, "<u4", c, at + a + b)), at + a + b + 4 * c


def file_bytes(part: int, number: int, doc_ids: list, lengths: list[int], ids: bytes, wide: bool) -> bytes:
    """``ids``: the documents' ids as 32-bit numbers, in the order of ``doc_ids`` (nulls first, then ascending)."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    flat = np.frombuffer(ids, "<u4")
    head = HEADER.pack(MAGIC, part, number, len(doc_ids), len(doc_ids) - len(known), len(flat), 4 if wide else 2, 0, first)
    ends = EliasFano.encode(np.cumsum([0, *lengths]))
    return head + EliasFano.encode(known.astype(np.uint64) - np.uint64(first % 2**64)).to_bytes() + ends.to_bytes() + flat.astype("<u4" if wide else "<u2").tobytes()


class IdFile:
    """A file's documents by number."""

    def __init__(self, blob: bytes):
        magic, self.part, self.number, self.documents, self.nulls, self.n_ids, width, _, self.first = HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.names, at = EliasFano.from_bytes(blob, HEADER.size)
        self.ends, at = EliasFano.from_bytes(blob, at)
        self.ids = np.frombuffer(blob, f"<u{width}", self.n_ids, at)

    def doc_ids(self) -> list:
        return [None] * self.nulls + (self.names.decode() + self.first).tolist()

    def rows(self) -> Iterator[tuple]:
        """(document id, first id, end) of each document in order, without a table of the boundaries."""
        names = chain(repeat(None, self.nulls), chain.from_iterable((b + self.first).tolist() for b in self.names.blocks()))
        return ((name, a, z) for name, (a, z) in zip(names, pairwise(chain.from_iterable(b.tolist() for b in self.ends.blocks()))))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] : self.ends[i + 1]]


def write_files(docs: DataFrame, out: str, path: str, end_id: int, file_ids: int = 4_000_000) -> None:
    """Encodes every text and writes the files to the new folder ``out``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, end = encoder(path), array("I", [end_id]).tobytes()
        wide = pieces.library.get_vocab_size() > 65536
        names, lengths, blobs, held, number, part = [], [], [], 0, 0, TaskContext.get().partitionId()

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_bytes(part, number, names, lengths, b"".join(blobs), wide)], pa.binary())], ["blob"])

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                own = pieces.encode(text.as_py() or "") + end
                names.append(doc)
                lengths.append(len(own) // 4)
                blobs.append(own)
                held += len(own) // 4
                if held >= file_ids:
                    yield file()
                    names, lengths, blobs, held, number = [], [], [], 0, number + 1
        if names:
            yield file()

    order = ["doc_id", "_hash"]
    ranged = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    files = ranged.select("doc_id", "text").mapInArrow(fill, "blob binary")
    files.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(out)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b["content"]:
                if len(blob.as_buffer()) < LEAST:
                    continue  # what a task without rows leaves
                f = IdFile(blob.as_buffer())
                for some in batched(f.rows(), 8 * EVERY):
                    names, starts, ends = zip(*some)
                    crc = [zlib.crc32(f.ids[a:z].astype("<u4")) for a, z in zip(starts, ends)]
                    columns = [f.part] * len(some), [f.number] * len(some), names, starts, [z - a for a, z in zip(starts, ends)], crc
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").load(folder).select("content").mapInArrow(rows, "part long, number long, doc_id long, at long, n_tokens long, ids_crc32 long")
    found = written(found, "boundaries")
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("held"))
    before = files.select("part", "number", (F.sum("held").over(Window.orderBy("part", "number")) - F.col("held")).alias("before"))
    return found.join(before, ["part", "number"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    out = shared_path(docs.sparkSession, "ids")
    write_files(docs, out, path, end_id)
    return read_files(docs.sparkSession, out)
