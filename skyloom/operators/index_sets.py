"""Index sets and sparse vectors: union, intersection, positions, re-indexing, merges by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.sources.staging import written


def numbered(df: DataFrame, keys: list[str], to: str) -> DataFrame:
    """``df`` with row numbers from 0 in the order of ``keys``.

    Ranges of the keys are sorted and written (so a lost executor changes nothing); each numbers its own rows, after
    the counts of those before it: one row for each range.
    """
    part = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    part = written(part.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = part.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return part.join(before, "_part").withColumn(to, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


_ROW = (1 << 33) - 1  # what monotonically_increasing_id counts within a partition


def ranged(df: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """``df`` in ranges of groups and keys, sorted and written: ``_part`` the range, ``_at`` the place in it.  A long group lies in many ranges."""
    order = [*by, *keys]
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(part.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))), "ranges")


def _carried(held: DataFrame, by: list[str], value: str) -> Column:
    """What the ranges before each hold of its group: ``held`` has a row for each range of a group."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy("_part")) - F.col(value)


def numbered_within(df: DataFrame, by: list[str], keys: list[str], to: str) -> DataFrame:
    """``df`` with row numbers from 0 within groups in the order of ``keys``: each range numbers its own rows, after the counts of those before
    it, so no task holds a group. Rows of null groups go."""
    part = ranged(df, by, keys)
    own = part.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_held"), F.min("_at").alias("_first"))
    own = own.select("_part", *by, (_carried(own, by, "_held") - F.col("_first")).alias("_shift"))
    return part.join(own, ["_part", *by]).select(*df.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(to))


def running_total(part: DataFrame, by: list[str], value: str, to: str) -> DataFrame:
    """``ranged`` rows with the sum of ``value`` within the group up to and with each row, in the same way."""
    own = part.groupBy("_part", *by).agg(F.sum(value).alias("_held"))
    own = own.select("_part", *by, _carried(own, by, "_held").alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("_inside", inside).join(own, ["_part", *by]).withColumn(to, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def with_previous(part: DataFrame, by: list[str], value: str, to: str) -> DataFrame:
    """``ranged`` rows with the value of the row before in the group, null for its first."""
    last = part.groupBy("_part", *by).agg(F.max_by(value, "_at").alias("_last"))
    last = last.select("_part", *by, F.lag("_last").over(Window.partitionBy(*by).orderBy("_part")).alias("_carry"))  # a row for each range of a group
    inside = F.lag(F.struct(value)).over(Window.partitionBy("_part", *by).orderBy("_at"))
    out = part.withColumn("_inside", inside).join(last, ["_part", *by])
    return out.withColumn(to, F.when(F.col("_inside").isNull(), F.col("_carry")).otherwise(F.col("_inside")[value])).drop("_inside", "_carry")


def sorted_distinct(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys with their position (from 0) in ascending order."""
    return numbered(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], "position")


def cardinality(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("n"))


def union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def positions_of_common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Positions within ``a`` of what both hold."""
    return sorted_distinct(a, key).join(b.select(key), key, "left_semi")


def reindexed(df: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with each key's position in the dictionary (key, position); keys that it lacks get null."""
    return df.join(dictionary, key, "left")


def copied(target: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """Target's keys with source's values where it has them, else their own."""
    other = source.select(key, F.col(value).alias("_new"))
    return target.join(other, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def added(target: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """Target's keys with source's values added."""
    other = source.select(key, F.col(value).alias("_new"))
    return target.join(other, key, "left").withColumn(value, F.col(value) + F.coalesce("_new", F.lit(0))).drop("_new")


def gathered(values: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """The values at the places (place -> key), in the order of places."""
    return places.join(values, key)


def scattered_sum(values: DataFrame, key: str, value: str) -> DataFrame:
    return values.groupBy(key).agg(F.sum(value).alias(value))


def out_of_order(df: DataFrame, key: str, order: list[str], by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows whose key is below (or, if strict, not above) the one before it: none in a sorted table."""
    by = by or []
    found = with_previous(ranged(df, by, order), by, key, "_previous")
    bad: Column = F.col(key) <= F.col("_previous") if strict else F.col(key) < F.col("_previous")
    return found.filter(bad).select(*df.columns)


def last_samples(tod: DataFrame) -> DataFrame:
    """For each pixel its last sample's row and its number of samples."""
    return tod.filter("pix >= 0").groupBy("pix").agg(F.max("row").alias("last_row"), F.count(F.lit(1)).alias("samples"))
