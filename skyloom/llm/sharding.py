"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, text CRC, size), nulls first.  A keyed Feistel network permutes a
domain of the next even number of bits; a number that falls outside 0..N-1 is walked through the network again
until it falls inside, which makes the whole a permutation of 0..N-1.  Shard is the permuted number modulo the
number of shards and slot the quotient: anybody with N, the seed and a row number can compute both, and shard sizes
differ by one at most (law ``rows``).

Nulls: a null text has size 1 and CRC 0; null ids are numbered first.  Repeated rows get numbers of their own.
An empty table gives no rows.  Texts of any length are measured whole, where they lie.  Other columns are not looked at, so
clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyloom.sources.staging import written

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed & (2**64 - 1)], np.uint64), (2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64)[0]) for i in range(ROUNDS)]


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number of 0..n-1 in the seed's permutation."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), round_keys(seed)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & low)
        return (left << np.uint64(half)) | right

    out = network(rows.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def numbered(df: DataFrame, keys: list[str], to: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with global row numbers in the order of ``keys``, and a table of one row with their count ``n``.

    Range partitions are sorted and written; rows are numbered within each, and the running sum over the
    partitions' counts (one row for each) gives where each begins.
    """
    part = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    part = written(part.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = part.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    return part.join(before, "_part").withColumn(to, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), total


def shards(docs: DataFrame, n_shards: int = 8, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the row number before the shuffle."""
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows, total = numbered(written(narrow, "sizes"), ["doc_id", "text_crc32", "size"], "row_number")
    n = total.first()["n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = permute(b["row_number"].to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "at"])

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, row_number long, at long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("at") % n_shards).cast("int").alias("shard"), F.floor(F.col("at") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
