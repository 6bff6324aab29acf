"""Bound-certified best-fit packing of documents into sequences of a fixed capacity.

A document is its ids and an end id; only one longer than the capacity is cut, into pieces of the capacity, of which
the first may be shorter.  Pieces are dealt evenly (by a number of the row, not by a key) to partitions of
``part_rows``; each is packed by best-fit decreasing, and dual-feasible functions give a lower bound of its bins:
a partition that meets its bound is certified.  Pieces in bins with slack of partitions with a gap, and those of every
partition's emptiest bin, are then exchanged: dealt anew and packed again, round after round.  A round that doesn't
lower the number of bins is not taken.

Nulls: a null text is an empty one (its end id alone); null ids are kept.  Repeated rows are packed each for itself.
An empty table gives no rows.  Texts of any length go whole; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyloom.llm.pretokens import encoder
from skyloom.llm.rowwise import spread
from skyloom.sources.staging import written


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Bins of equal room are held together, the rooms that occur in the bits of a number,
    so the tightest room is found in one step."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, opened = 0, 0
    for i, w in zip(order.tolist(), lengths[order].tolist()):
        fitting = present >> w
        if fitting:
            room = w + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            room, at, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = at, capacity - room
        if room > w:
            rooms[room - w].append(at)
            present |= 1 << (room - w)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 64) -> int:
    """The best of two families of dual-feasible functions: items under a threshold count nothing and those over its
    complement a whole bin; and lengths rounded down to the (k+1)-th parts of a bin."""
    if not len(lengths):
        return 0
    number = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    size = np.arange(capacity + 1)
    upto, mass = np.cumsum(number), np.cumsum(number * size)
    low = np.arange(1, capacity // 2 + 1)
    whole = upto[-1] - upto[capacity - low]
    best = int(np.max(whole + -(-(mass[capacity - low] - mass[low - 1]) // capacity)))
    best = max(best, -(-int(mass[-1]) // capacity))
    for k in range(1, most_k + 1):
        value = np.where((k + 1) * size % capacity == 0, k * size, capacity * ((k + 1) * size // capacity))
        best = max(best, -(-int((number * value).sum()) // (k * capacity)))
    return best


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``ids`` is null unless asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, array("I", [end_id]).tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (at, to) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[4 * at : 4 * to]
                    rows.append((doc, k, at, to - at, zlib.crc32(own), bytes(own) if with_ids else None))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(cut, PIECE)


PACKED = PIECE + ", deal long, part long, bin long, offset long, fill long, gap long, emptiest boolean"


def _pack_parts(table: DataFrame, capacity: int, part_rows: int, salt: int) -> DataFrame:
    parts = max(1, -(-table.count() // part_rows))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("deal", "ascending")])
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(filled) - lower_bound(lengths, capacity)
        more = {"bin": bins, "offset": offsets, "fill": filled[bins], "gap": np.full(len(bins), gap), "emptiest": bins == np.argmin(filled)}
        for name, values in more.items():
            group = group.append_column(name, pa.array(values))
        return group

    dealt = table.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(salt)), F.lit(parts)))
    return written(dealt.groupBy("part").applyInArrow(pack, PACKED), "packed")


def pack(docs: DataFrame, path: str, capacity: int, end_id: int, part_rows: int = 20_000, rounds: int = 3, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; also round, part and gap (bins of the part over its certified bound)."""
    cut = pieces(docs, path, capacity, end_id, with_ids)
    pool = written(cut.withColumn("deal", F.monotonically_increasing_id()), "pieces")
    kept: list[DataFrame] = []
    open_bins = (F.col("gap") > 0) & (F.col("fill") < capacity) | F.col("emptiest")
    bins = F.sum((F.col("offset") == 0).cast("long"))
    for turn in range(rounds + 1):
        packed = _pack_parts(pool, capacity, part_rows, turn).withColumn("turn", F.lit(turn))
        if turn and packed.agg(bins).first()[0] >= before:
            kept[-1] = last
            break
        last, again = packed, packed.filter(open_bins)
        before, parts = again.agg(bins, F.count_distinct("part")).first()
        if turn == rounds or parts <= 1 and turn:
            kept.append(packed)
            break
        kept.append(packed.filter(~open_bins))
        pool = again.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "deal")
        if not before:
            break
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    sequence = F.col("turn").cast("long") * (1 << 56) + F.col("part") * (1 << 28) + F.col("bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", F.col("turn").alias("round"), "part", "gap", *["ids"] * with_ids)
