"""Sparse pointing products as joins and grouped sums.

A sample's row of the pointing matrix is wide: one pixel and its I, Q, U weights; a negative pixel is a flagged sample,
whose product is 0 and which adds nothing to a map.  Matrices with other shapes are long: (row, col, val).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.sources.staging import written

STOKES = ("i", "q", "u")
WEIGHTS = ("w_i", "w_q", "w_u")
#: Entries of a long matrix that a task joins or sums, about, and of a vector that every task gets.
ENTRIES = 1 << 20
SENT = 1 << 20


def _sky_key(tod: DataFrame) -> Column:
    """The pixel; for flagged samples negative numbers by their columns, so that these don't meet in one task."""
    plain = [f.name for f in tod.schema if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    return F.when(F.col("pix") >= 0, F.col("pix").cast("long")).otherwise(-1 - F.pmod(F.xxhash64(*plain), F.lit(1 << 20)))


def project(tod: DataFrame, sky: DataFrame, to: str | list[str] = "y") -> DataFrame:
    """y = A x: every sample gets the sum of weight times map value; rows without a map pixel get 0. With a list ``to`` the sky is a block
    vector (pix, i0, q0, u0, i1, ...) and each of its maps makes a column."""
    maps = [(to, STOKES)] if isinstance(to, str) else [(c, [f"{s}{k}" for s in STOKES]) for k, c in enumerate(to)]
    values = [s for _, own in maps for s in own]
    joined = tod.withColumn("_key", _sky_key(tod)).join(sky.select(F.col("pix").cast("long").alias("_pix"), *(F.col(s).alias(f"_sky_{s}") for s in values)), F.col("_key") == F.col("_pix"), "left")
    total = lambda own: sum((F.col(w) * F.coalesce(F.col(f"_sky_{s}"), F.lit(0)) for w, s in zip(WEIGHTS, own)), F.lit(0))
    return joined.select(*(c for c in tod.columns if c not in {c for c, _ in maps}), *(F.when(F.col("_pix").isNotNull(), total(own)).otherwise(F.lit(0)).alias(c) for c, own in maps))


def scatter(tod: DataFrame, value: Column | str = "y") -> DataFrame:
    """x = A^T y: (pix, i, q, u) sums of weight times value over the pixel's samples."""
    value = F.col(value) if isinstance(value, str) else value
    return tod.filter("pix >= 0").groupBy("pix").agg(*(F.sum(F.col(w) * value).alias(s) for w, s in zip(WEIGHTS, STOKES)))


def normal(tod: DataFrame, sky: DataFrame, weight: Column) -> DataFrame:
    """A^T W A x for diagonal weights."""
    return scatter(project(tod, sky, "_y"), F.col("_y") * weight)


def weight_blocks(tod: DataFrame, weight: Column | None = None) -> DataFrame:
    """Hits and the upper triangle of sum(w w^T) times the sample's noise weight, for each pixel."""
    weight = F.lit(1) if weight is None else weight
    pairs = [(a, b) for k, a in enumerate("iqu") for b in "iqu"[k:]]
    return tod.filter("pix >= 0").groupBy("pix").agg(F.count(F.lit(1)).alias("hits"), *(F.sum(F.col(f"w_{a}") * F.col(f"w_{b}") * weight).alias(f"b_{a}{b}") for a, b in pairs))


def sums(tod: DataFrame, value: Column | str, weight: Column | None = None) -> DataFrame:
    """``weight_blocks`` and ``scatter`` of value times weight in one aggregation."""
    value, weight = F.col(value) if isinstance(value, str) else value, F.lit(1) if weight is None else weight
    pairs = [(a, b) for k, a in enumerate("iqu") for b in "iqu"[k:]]
    squares = [F.sum(F.col(f"w_{a}") * F.col(f"w_{b}") * weight).alias(f"b_{a}{b}") for a, b in pairs]
    return tod.filter("pix >= 0").groupBy("pix").agg(F.count(F.lit(1)).alias("hits"), *squares, *(F.sum(F.col(w) * value * weight).alias(s) for w, s in zip(WEIGHTS, STOKES)))


# long form ------------------------------------------------------------------------------------------------------


def to_long(tod: DataFrame, row: str = "row") -> DataFrame:
    """Wide rows as (row, j, col, val) with col = 3 * pix + s; flagged rows keep their negative columns."""
    entries = F.array(*(F.struct(F.lit(j).alias("j"), (3 * F.col("pix") + j).alias("col"), F.col(w).alias("val")) for j, w in enumerate(WEIGHTS)))
    return tod.select(row, F.explode(entries).alias("e")).select(F.col(row).alias("row"), "e.j", "e.col", "e.val")


def to_wide(coo: DataFrame) -> DataFrame:
    """(row, cols, vals) arrays in the order of j."""
    return coo.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("j", "col", "val"))).alias("e")).select("row", F.col("e.col").alias("cols"), F.col("e.val").alias("vals"))


def _tasks(coo: DataFrame) -> int:
    return max(coo.sparkSession.sparkContext.defaultParallelism, -(-coo.count() // ENTRIES))


def _met(coo: DataFrame, vector: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Entries with their value of a vector: every task gets one of up to ``SENT`` values, a longer one is dealt over the tasks as the entries are."""
    vector, coo = written(vector, "vector"), coo.filter("col >= 0")
    if vector.count() <= SENT:
        return coo.join(F.broadcast(vector), keys)
    return coo.repartition(tasks, *keys).join(vector.repartition(tasks, *keys), keys)


def _row_sums(products: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Sums of y by keys, most of which have few entries: so these are dealt before they are summed, those of a long row over 16 tasks."""
    parts = products.select(*keys, F.pmod(F.xxhash64("col"), F.lit(16)).alias("_part"), "y").repartition(tasks, *keys, "_part")
    return parts.groupBy(*keys, "_part").agg(F.sum("y").alias("y")).repartition(tasks, *keys).groupBy(*keys).agg(F.sum("y").alias("y"))


def multiply(coo: DataFrame, x: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row, y): y = A x for a long matrix and a vector (col, x). ``rows``: those that must appear, with 0 if need be."""
    tasks = _tasks(coo)
    got = _row_sums(_met(coo, x, ["col"], tasks).withColumn("y", F.col("val") * F.col("x")), ["row"], tasks)
    return got if rows is None else rows.select("row").join(got, "row", "left").select("row", F.coalesce("y", F.lit(0)).alias("y"))


def multiply_transposed(coo: DataFrame, y: DataFrame) -> DataFrame:
    """(col, x): x = A^T y for a vector (row, y)."""
    return _met(coo, y, ["row"], _tasks(coo)).groupBy("col").agg(F.sum(F.col("val") * F.col("y")).alias("x"))


def stacked(levels: list[DataFrame]) -> DataFrame:
    """One composite matrix of several: a column ``level`` tells whose row it is."""
    out = levels[0].withColumn("level", F.lit(0))
    for k, more in enumerate(levels[1:], 1):
        out = out.unionByName(more.withColumn("level", F.lit(k)))
    return out


def multiply_stacked(coo: DataFrame, x: DataFrame) -> DataFrame:
    """(level, row, y)."""
    tasks = _tasks(coo)
    return _row_sums(_met(coo, x, ["col"], tasks).withColumn("y", F.col("val") * F.col("x")), ["level", "row"], tasks)


def multiply_stacked_transposed(coo: DataFrame, y: DataFrame) -> DataFrame:
    """(col, x) from (level, row, y)."""
    return _met(coo, y, ["level", "row"], _tasks(coo)).groupBy("col").agg(F.sum(F.col("val") * F.col("y")).alias("x"))


def describe(coo: DataFrame) -> DataFrame:
    """Rows, entries, distinct columns and flagged entries of a long matrix."""
    return coo.agg(F.count_distinct("row").alias("rows"), F.count(F.lit(1)).alias("entries"), F.count_distinct(F.when(F.col("col") >= 0, F.col("col"))).alias("columns"), F.sum((F.col("col") < 0).cast("long")).alias("flagged"))
