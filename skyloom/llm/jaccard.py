"""N-gram Jaccard join by vertical partitioning, whole and without all pairs of a group.

A document's set holds the 64-bit hashes of its distinct word n-grams; the order of the hashes is the global n-gram
order.  Documents with equal sets (128 bits of digest) form a class, and the join runs between classes:

1. A fragment of the order (three eighths) is counted first.  A link needs three quarters of a set shared, so a class
   with more than a quarter of its set found nowhere else, even in this fragment alone, has no partner and drops out.
2. Star rounds.  Every n-gram nominates one leader among its classes, the one that shares most of its own set; partial overlaps of
   (class, leader) are counted in each fragment of the order for itself and summed per pair.  The sum never exceeds the true
   overlap, so pairs over the threshold are links.  N-grams whose classes have come
   together in one component can't add anything; a class that keeps less than three quarters of its set in other
   n-grams is settled and leaves.
3. What is left is joined exactly: prefix and position filters over the order (frequency, hash) give candidate pairs
   of different components; both sets are cut into fragments, overlaps are counted in each and summed per pair.
   Positions count the n-grams that no other component has, so pairs that can't reach the threshold are never made.

Every step is either exact or drops only what cannot link, so components are those of the full join.

Nulls and empty texts: no set, linked with nothing, component_id is the own doc_id.  Null ids are kept and never
are a component's smallest id unless all of its ids are null (then it is null).  Repeated rows are one class.  Fewer
words than n: the whole sequence is the one n-gram.  Texts of any length go whole: a worker holds the sets of ``SLICE`` rows.  Classes whose
first 64 bits are equal get other numbers (``_parted``).  Other columns are not looked at, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.llm.components import components
from skyloom.llm.pretokens import Table, release
from skyloom.llm.rowwise import spread
from skyloom.sources.staging import discard_table, written

FRAGMENTS = 8
#: A broadcast table of class representatives has so many rows at most (of 8 bytes); larger ones are joined by shuffle.
BROADCAST_ROWS = 1 << 18
_FIRST = np.uint64(3 << 61)

#: Rows that a worker holds sets of at a time.
SLICE = 500

_words = Table(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), 120_000)


def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    """Hashes of the distinct n-grams, ascending. Words are runs of other than ASCII white space; A-Z are lowered."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    _words.turn()
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    count = len(w) - size + 1
    h = np.full(count, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def class_of(grams: np.ndarray) -> tuple[int, int]:
    """The two halves of the set's digest."""
    return struct.unpack("<qq", hashlib.blake2b(grams.tobytes(), digest_size=16).digest())


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)])
    flat = np.concatenate([a for a in arrays if a is not None and len(a)] or [np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _features(docs: DataFrame, n: int) -> DataFrame:
    """For each row: size of its set, its class, and the set's n-grams in the first fragment (null for most copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[tuple[int, int]] = set()
        for b in _slices(batches):
            seen = seen if len(seen) < 100_000 else set()
            sizes, classes, others, first = [], [], [], []
            for text in b["text"]:
                grams = ngram_set(text.as_py(), n)
                c = class_of(grams)
                sizes.append(len(grams))
                classes.append(c[0])
                others.append(c[1])
                first.append(None if c in seen else grams[: np.searchsorted(grams, _FIRST)])
                seen.add(c)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], *(pa.array(x, pa.int64()) for x in (sizes, classes, others)), _lists(first)], ["doc_id", "key", "n", "c", "c2", "first"])

    return docs.mapInArrow(run, "doc_id long, key string, n long, c long, c2 long, first array<bigint>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in _slices(batches):
            grams = [ngram_set(text.as_py(), n) for text in b["text"]]
            c = [class_of(g) for g in grams]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in c], pa.int64()) for k in (0, 1)), pa.array([len(g) for g in grams], pa.int64()), _lists(grams)], ["c", "c2", "n", "grams"])

    return docs.select("text").mapInArrow(run, "c long, c2 long, n long, grams array<bigint>")


def _parted(classes: DataFrame) -> DataFrame | None:
    """(c, c2, x): numbers of their own for all but one of the classes that share c; None where no two do. Only at billions of classes
    some may: the table stays small."""
    alike = classes.groupBy("c").count().filter("count > 1")
    if alike.isEmpty():
        return None
    place = F.row_number().over(Window.partitionBy("c").orderBy("c2"))
    several = written(classes.select("c", "c2").join(alike.select("c"), "c").withColumn("place", place).filter("place > 1"), "alike")
    taken = classes.select(F.col("c").alias("x"))
    for salt in range(64):
        moved = written(several.select("c", "c2", F.xxhash64("c2", "c", F.lit(salt)).alias("x")), "moved")
        if moved.join(taken, "x", "left_semi").isEmpty() and moved.groupBy("x").count().filter("count > 1").isEmpty():
            return moved
    raise AssertionError("no free numbers for classes")


def _numbered(table: DataFrame, moved: DataFrame | None) -> DataFrame:
    """``table`` with x, the class's number, in place of c and c2."""
    if moved is None:
        return table.withColumn("x", F.col("c")).drop("c", "c2")
    return table.join(moved, ["c", "c2"], "left").withColumn("x", F.coalesce("x", "c")).drop("c", "c2")


def _small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a class, for broadcast while it has ``BROADCAST_ROWS`` rows at most."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _links(overlap: Column, n: Column, m: Column) -> Column:
    return 100 * overlap >= 75 * (n + m - overlap)


def _prior(lonely: Column, turn: int) -> Column:
    """Smaller for classes that share more of their set: the centres of their groups. The rest of the bits are a hash."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), lonely))
    return F.shiftleft((share * (1 << 14)).cast("long"), 48).bitwiseOR(F.xxhash64("x", F.lit(turn)).bitwiseAND(F.lit((1 << 48) - 1)))


def _fragment(h: str) -> Column:
    """The stretch of the global order that an n-gram lies in."""
    return F.shiftrightunsigned(h, 64 - FRAGMENTS.bit_length() + 1).cast("int")


def _star_round(sets: DataFrame, first: bool) -> DataFrame:
    """(x, l, k): k n-grams of x that some other component has, too, nominate l, which has the least ``prior``."""
    grams = sets.select("x", "label", "prior", F.explode("grams").alias("h"))
    lead = F.min_by("x", "prior").alias("l")
    if first:  # every class is its own component
        leads = grams.groupBy("h").agg(lead, F.count(F.lit(1)).alias("n")).filter("n > 1")
    else:
        leads = grams.groupBy("h").agg(lead, F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    partial = grams.select("x", "h").join(leads.select("h", "l"), "h").groupBy("x", "l", _fragment("h").alias("f")).agg(F.count(F.lit(1)).alias("part"))
    return written(partial.groupBy("x", "l").agg(F.sum("part").alias("k")), "stars")


def _exact(sets: DataFrame) -> DataFrame:
    """All links (u, v) between classes of different labels."""
    grams = sets.select("x", "label", F.explode("grams").alias("h"))
    shared = grams.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    order = grams.select("x", "h").join(shared.select("h", "df"), "h").groupBy("x").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
    own = F.col("n") - F.size("order")
    prefix = F.floor(F.col("n") / 4) + 1 - own
    row = order.join(sets.select("x", "n", "label"), "x").filter(prefix > 0)
    row = row.select("x", "n", "label", own.alias("own"), F.posexplode(F.slice("order", F.lit(1), prefix.cast("int"))))
    row = written(row.select("x", "n", "label", (F.col("n") - F.col("own") - F.col("pos")).alias("rest"), F.col("col.h").alias("h")), "prefixes")
    other = row.toDF("y", "m", "label2", "rest2", "h")
    reach = (F.col("x") < F.col("y")) & (F.col("label") != F.col("label2")) & (7 * F.least("rest", "rest2") >= 3 * (F.col("n") + F.col("m")))
    pairs = row.join(other, (row["h"] == other["h"]) & reach).select("x", "y", "n", "m").distinct()
    pairs = written(pairs, "candidates")
    wanted = written(pairs.select("x").union(pairs.select("y")).distinct(), "wanted")
    segments = sets.join(_small(wanted), "x", "left_semi").select("x", F.explode("grams").alias("h")).withColumn("f", _fragment("h"))
    segments = written(segments.groupBy("x", "f").agg(F.collect_list("h").alias("part")), "segments")
    partial = pairs.join(segments, "x").join(segments.toDF("y", "f", "part2"), ["y", "f"])
    counted = partial.groupBy("x", "y", "n", "m").agg(F.sum(F.size(F.array_intersect("part", "part2"))).alias("k"))
    return counted.filter(_links(F.col("k"), F.col("n"), F.col("m"))).select(F.col("x").alias("u"), F.col("y").alias("v"))


def similarity_classes(docs: DataFrame, n: int = 5, star_rounds: int = 2, key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, key (of the caller's), n_shingles, class_id (equal sets), root (a class
    that stands for the component) and component_id."""
    spark = docs.sparkSession
    texts = spread(docs).select(F.col("doc_id").cast("long"), "text", (F.lit(None) if key is None else key).cast("string").alias("key"))
    wide = written(_features(texts, n), "features")
    classes = written(wide.filter("n > 0").groupBy("c", "c2").agg(F.min("doc_id").alias("m"), F.first("n").alias("n")), "digests")
    moved, features = _parted(classes), wide
    wide, classes = (_numbered(t, moved).withColumnRenamed("x", "c") for t in (wide, classes))
    rows = written(wide.drop("first"), "classes")
    first = wide.select("c", F.explode("first").alias("h")).groupBy("h").agg(F.min("c").alias("c"), F.max("c").alias("other"))
    alone = first.filter("c = other").groupBy("c").agg(F.count(F.lit(1)).alias("alone"))
    left = written(classes.join(alone, "c", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).filter("4 * alone <= n").select("c", "m", "n", "alone"), "survivors")
    discard_table(features)

    small = left.count() <= BROADCAST_ROWS
    wanted, known = left.select("m").distinct(), left.select(F.col("c").alias("x"), "alone")
    wanted, known = (F.broadcast(wanted), F.broadcast(known)) if small else (wanted, known)
    some = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["m"]), "left_semi")
    sets = _numbered(_sets(some, n), moved).join(known, "x")
    unique = texts.groupBy("doc_id").count().filter("count > 1").isEmpty()  # an id of several rows may bring a class twice
    sets = sets if unique else sets.dropDuplicates(["x"])
    sets = written(sets.withColumn("label", F.col("x")).withColumn("prior", _prior(8 / 3 * F.col("alone") / F.col("n"), 0)).drop("alone"), "sets")

    roots = spark.createDataFrame([], "u long, root long")
    for turn in range(star_rounds):
        stars = _star_round(sets, turn == 0)
        size = sets.select("x", "n")
        near = stars.filter("x != l").join(size, "x").join(size.toDF("l", "m"), "l").filter(_links(F.col("k"), F.col("n"), F.col("m")))
        links = written(near.select(F.col("x").alias("u"), F.col("l").alias("v")), "links")
        roots = components(roots.toDF("u", "v").unionByName(links))
        open_ = stars.groupBy("x").agg(F.sum("k").alias("k")).join(size, "x").filter(4 * F.col("k") >= 3 * F.col("n")).drop("n")
        state = written(open_.join(roots.toDF("x", "label"), "x", "left").withColumn("label", F.coalesce("label", "x")), "state")
        now = sets.drop("label", "prior").join(_small(state), "x")
        sets = written(now.withColumn("prior", _prior(1 - F.col("k") / F.col("n"), turn + 1)).select("x", "n", "grams", "label", "prior"), "sets")
    roots = components(roots.toDF("u", "v").unionByName(_exact(sets)))

    of = classes.select("c", "m").join(roots.select(F.col("u").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    of = written(of, "roots")
    ids = of.groupBy("root").agg(F.min("m").alias("component_id"))
    by_class = of.join(ids, "root").select("c", "root", "component_id")
    joined = rows.join(by_class, "c", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("c").alias("class_id"), F.coalesce("root", "c").alias("root"), own.alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of the smallest doc_id stays (of equal ids the
    one with the smallest digest of its text, of repeated rows one). Rows without words stay."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary"))
    found = written(similarity_classes(docs, n, key=digest), "found").filter("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    times = found.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    best = times.groupBy("root").agg(F.min(rank).alias("best")).select(F.col("best.key").alias("key"))
    stays = times.join(best, "key", "left_semi")
    goes = written(times.join(best, "key", "left_anti").select(F.col("key").alias("_key"), F.lit(0).alias("_copies")).unionByName(stays.filter("times > 1").select(F.col("key").alias("_key"), F.lit(1).alias("_copies"))), "goes")
    goes = F.broadcast(goes) if goes.count() <= BROADCAST_ROWS // 8 else goes  # 32 bytes and a digit a row
    marked = docs.select(F.struct("*").alias("_row"), digest.alias("_key")).join(goes, "_key", "left")
    alone = marked.filter("_copies IS NULL").select("_row.*")
    copies = marked.filter("_copies = 1").dropDuplicates(["_key"]).select("_row.*")
    return alone.unionByName(copies)
