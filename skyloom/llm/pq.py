"""Vector codes: integer k-means codebooks for consecutive parts of the vectors, nearest entries by exponion search.

Components become floor(1024 * x).  Each part position has a codebook that starts as the parts of the first rows by vec_id; a
round assigns every part to its nearest entry and replaces entries by the floors of their parts' means.

A search starts at the entry that the part had before, at distance u.  An entry that is nearer to the part lies within 2u of that
entry (triangle inequality), so only the beginning of that entry's list of entries, sorted by their distance from it, is
scanned; as nearer entries turn up the radius shrinks to u plus the least distance found.  Distances are exact integers and
ties go to the lower index, so the result is that of a full scan.

Vectors and codes are rewritten by each round in the shared folder.  Entries' sums are gathered by task before they are shuffled; what
comes to the driver, and goes back, is the codebooks: at most 256 entries of the vectors' length, whatever the number of rows.

Nulls: rows without a vector, or whose vector holds a null, a NaN or an infinity, take no part; a null vec_id comes last, a null label is a
label of its own.  Ties: rows with equal vec_id are ordered by their components.  Repeated rows count each for itself.  With fewer rows
than entries the codebooks are as short.  Vectors of length 0 have code 00.. and error 0.  An empty table gives no rows.  Other columns are
dropped, so clashing names don't matter.  Vectors of different lengths, of a length that parts don't divide, or with components so large
that an error isn't a 64-bit number raise a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyloom.llm.rowwise import spread
from skyloom.sources.staging import discard_table, written

SCALE = 1024
#: Entries that the first step of a scan looks at; each later one takes twice as many.
STEP = 16
#: Tasks that the rows of one label are dealt to when they meet the label's sum.
SALT = 16


class Codebook:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = squared(entries, entries)
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each row of ``x``; ``start``: an entry to begin at."""
        at, best = start.astype(np.int64), ((x - self.entries[start]) ** 2).sum(1)
        by = np.argsort(start, kind="stable")
        y = self.entries
        if exact(x, y):
            x, y = x.astype(float), y.astype(float)
        parts = x, (x * x).sum(1), y, (y * y).sum(1)
        for rows in np.split(by, np.flatnonzero(np.diff(start[by])) + 1):
            if len(rows):
                at[rows], best[rows] = self._scan(parts, rows, int(start[rows[0]]), best[rows])
        return at, best

    def _scan(self, parts: tuple, rows: np.ndarray, a: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, gap, best, at = self.order[a], self.gap[a], u.copy(), np.full(len(rows), a)
        reach, low, step = np.searchsorted(gap, 4 * u, "right"), 0, STEP
        while len(live := np.flatnonzero(reach > low)):
            near = order[low : low + step]
            low, step = low + step, 2 * step
            d = self._distances(parts, rows[live], near)
            least = d.min(1)
            index = np.where(d == least[:, None], near, len(order)).min(1)
            better = (least < best[live]) | ((least == best[live]) & (index < at[live]))
            won = live[better]
            best[won], at[won] = least[better], index[better]
            # rounded up by far more than the roots' error
            radius = (np.sqrt(u[won].astype(float)) + np.sqrt(best[won].astype(float))) ** 2 * (1 + 1e-12) + 1
            reach[won] = np.minimum(reach[won], np.searchsorted(gap, radius, "right"))
        return at, best

    @staticmethod
    def _distances(parts: tuple, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
        x, xx, y, yy = parts
        return xx[rows, None] + yy[near] - 2 * (x[rows] @ y[near].T)


def exact(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether floating point holds every squared distance of rows of x and y, and what it is made of."""
    top = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    return x.shape[1] * top * top < 1 << 53


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and y."""
    if exact(x, y):
        x, y = x.astype(float), y.astype(float)
    return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)


@dataclass
class Codes:
    rows: DataFrame  # vec_id, label, code (one byte a part), error
    books: np.ndarray  # (parts, entries, length of a part)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


SCHEMA = "vec_id bigint, label {label}, q array<bigint>, code binary, error bigint"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors have {width} components, and others {lengths[lengths != width][0]}")
    flat = column.flatten().to_numpy().astype(np.int64)
    top = 2 * max(-int(flat.min(initial=0)), int(flat.max(initial=0)))
    if top * top * width >= 1 << 63:
        raise ValueError("components are too large for exact 64-bit distances")
    return flat.reshape(len(lengths), width)


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, q of the rows that take part."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return vectors.filter(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), q.alias("q"))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, **columns: str) -> Codes:
    """Codes of all vectors and the codebooks after ``rounds`` rounds; at most 256 entries, so a code is a byte a part."""
    if not 1 <= entries <= 256:
        raise ValueError("codebooks have 1 to 256 entries")
    rows = spread(integers(vectors, **columns))
    rows = written(rows.withColumn("code", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("long")), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").toArrow()["q"].to_pylist()
    width = len(first[0]) if first else 0
    if width % parts:
        raise ValueError(f"{parts} equal parts don't make {width} components")
    if any(len(q) != width for q in first):
        raise ValueError("vectors have different numbers of components")
    start = np.array(first, np.int64).reshape(len(first), parts, width // parts)
    books = np.ascontiguousarray(start.swapaxes(0, 1))
    for _ in range(rounds):
        before, rows = rows, written(assigned(rows, books), "vectors")
        discard_table(before)
        books = means(rows, books)
    before, rows = rows, written(assigned(rows, books).drop("q"), "codes")
    discard_table(before)
    return Codes(rows, books)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Every part's nearest entry, the search beginning at the entry that it has, if any."""
    sent, (parts, _, part) = rows.sparkSession.sparkContext.broadcast(books), books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in sent.value]
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b["q"], parts * part)
            code = np.zeros((len(x), parts), np.uint8)
            if not b["code"].null_count:
                code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(x), parts)
            found = [own[p].nearest(x[:, p * part : (p + 1) * part], code[:, p]) for p in range(parts)]
            if sum(int(d.max()) for _, d in found) >= 1 << 63:
                raise ValueError("an error isn't a 64-bit number")
            new = np.stack([at for at, _ in found], 1).astype(np.uint8)
            blobs = pa.array([r.tobytes() for r in new], pa.binary())
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["q"], blobs, pa.array(sum(d for _, d in found), pa.int64())], ["vec_id", "label", "q", "code", "error"])

    return rows.mapInArrow(run, SCHEMA.format(label=rows.schema["label"].dataType.simpleString()))


def means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry's floor of the mean of its parts; an entry without parts stays."""
    parts, entries, part = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, part + 1), np.int64)  # the last: how many
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b["q"], parts * part)
            code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                by = np.argsort(code[:, p], kind="stable")
                seen, at, count = np.unique(code[by, p], return_index=True, return_counts=True)
                if part:
                    sums[p, seen, :part] += np.add.reduceat(x[by, p * part : (p + 1) * part], at, axis=0)
                sums[p, seen, part] += count
        place = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.ravel()[place])], ["place", "s"])

    total = rows.mapInArrow(run, "place long, s long").groupBy("place").agg(F.sum("s").alias("s")).toArrow()  # one row for each component of each entry
    sums = np.zeros(parts * entries * (part + 1), np.int64)
    sums[total["place"].to_numpy()] = total["s"].to_numpy()
    sums = sums.reshape(parts, entries, part + 1)
    count = sums[..., part:]
    return np.where(count > 0, sums[..., :part] // np.maximum(count, 1), books)


def with_label_errors(codes: Codes) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error (the sum of errors of the same label) and the digest of the codebooks."""
    salted = codes.rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALT)))
    sums = codes.rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    out = salted.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_part")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))
