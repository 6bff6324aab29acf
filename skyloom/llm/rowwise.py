"""Helpers for work row by row: values bound once, running sums in blocks, rows spread over idle cores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _carry(values: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` has gathered before each value, beginning with ``start``."""
    begin = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, v: F.struct(join(a["at"], v).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    return F.aggregate(values, begin, step, lambda a: a["out"])


def running(values: Column, start: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs what ``join`` makes of those before it. Blocks keep the appending short."""
    first = F.lit(start).cast("long")

    def whole(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return let(cut, lambda blocks: let(_carry(F.transform(blocks, lambda b: F.aggregate(b, first, join)), first, join), lambda before: F.flatten(F.zip_with(blocks, before, lambda b, at: _carry(b, at, join)))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(whole(v)))


def running_sum(values: Column) -> Column:
    return running(values, 0, lambda a, v: (a + v).cast("long"))


def running_max(values: Column) -> Column:
    return running(values, 0, lambda a, v: F.greatest(a, v))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt evenly where they lie in fewer splits than half the cores (a file of one row group, say); as they are
    otherwise.  Counting filled splits reads no column."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    filled = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    return docs.repartition(cores) if 2 * filled < cores else docs
