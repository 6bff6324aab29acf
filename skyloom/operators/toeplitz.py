"""Banded block-Toeplitz products: window functions for narrow bands, FFT over bounded chunks for wide ones.

A block is a stretch of samples with t = 0.. and one first row of its symmetric Toeplitz matrix; samples outside it
count as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.functions.numeric import banded_product
from skyloom.operators import index_sets
from skyloom.operators.flags import gaps_reset, in_gaps
from skyloom.sources.staging import written

#: Bands up to this width are window expressions; wider ones go through the FFT.
NARROW = 16
#: Samples of a chunk without its halo.
CHUNK = 1 << 18


def _each(value: str | list[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def mean_removed(rows: DataFrame, value: str | list[str], by: str = "block_id") -> DataFrame:
    """Value (or several) less its block's mean. Means are grouped sums joined back, so a long block isn't gathered anywhere."""
    means = rows.groupBy(by).agg(*(F.avg(v).alias(f"_mean_{v}") for v in _each(value)))
    return rows.join(means, by).withColumns({v: F.col(v) - F.col(f"_mean_{v}") for v in _each(value)}).drop(*(f"_mean_{v}" for v in _each(value)))


def narrow_product(rows: DataFrame, value: str, row: Sequence, to: str = "y", by: str = "block_id", chunk: int = CHUNK) -> DataFrame:
    """sum over |i - j| < len(row) of row[|i - j|] * value(j). Blocks are cut into chunks that overlap by the band, as in
    ``wide_product``, so a long block is shared by many tasks."""
    halo, v = len(row) - 1, F.col(value)
    cells = F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - halo) / chunk)), F.floor((F.col("t") + halo) / chunk))
    w = Window.partitionBy(by, "_cell").orderBy("t")
    total: Column = F.lit(row[0]) * v
    for k in range(1, len(row)):
        total = total + F.lit(row[k]) * (F.lag(v, k, 0).over(w) + F.lead(v, k, 0).over(w))
    cut = rows.withColumn("_cell", F.explode(cells)).withColumn(to, total)
    return cut.filter(F.col("_cell") == F.floor(F.col("t") / chunk)).drop("_cell")


def diagonal_product(rows: DataFrame, weights: DataFrame, value: str | list[str], to: str | list[str] = "y", by: str = "block_id") -> DataFrame:
    """Bands of width 1: the block's one weight times the value, no mean removed. Rows without a block stay."""
    first = weights.select(F.col(by).alias("_b"), F.col("t").getItem(0).alias("_w"))
    return rows.join(first, F.col(by) == F.col("_b"), "left").withColumns({y: F.coalesce(F.col("_w"), F.lit(1)) * F.col(v) for v, y in zip(_each(value), _each(to))}).drop("_b", "_w")


def wide_product(rows: DataFrame, noise: DataFrame, value: str | list[str], to: str | list[str] = "y", by: str = "block_id", chunk: int = CHUNK, method: str = "auto", fft_size: int | str | None = None) -> DataFrame:
    """(by, t, to): any bandwidth, of one column or of several in one pass (one batch of transforms). ``noise``: (by, t array). Blocks are
    cut into chunks that overlap by the bandwidth less one, so a task holds a chunk, however long the block is.  ``method``, ``fft_size``:
    as ``numeric.banded_product`` has them."""
    values, names = _each(value), _each(to)
    halo = F.col("_width") - 1
    long = rows.join(noise.select(F.col(by), F.size("t").alias("_width")), by)
    cells = F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - halo) / chunk)), F.floor((F.col("t") + halo) / chunk))
    cut = long.select(by, "t", *(F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)), F.explode(cells).alias("cell"))
    first = noise.select(F.col(by).alias("_block"), F.col("t").alias("row"))

    def run(key: tuple, table: pa.Table, rows_of: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, cell = table["t"].to_numpy(), key[1].as_py() if table.num_rows else 0
        full = np.zeros((len(values), int(t[-1] - t[0]) + 1 if len(t) else 0))
        if len(t):
            for k in range(len(values)):
                full[k, t - t[0]] = table[f"v{k}"].to_numpy()
            full = banded_product(np.asarray(rows_of["row"][0].as_py(), float), full, method, fft_size)
        own = (t >= cell * chunk) & (t < (cell + 1) * chunk)
        at = t[own] - t[0] if len(t) else np.zeros(0, int)
        return pa.table({by: table[by].filter(pa.array(own)), "t": pa.array(t[own]), **{n: pa.array(np.ascontiguousarray(full[k, at])) for k, n in enumerate(names)}})

    kind = rows.schema[by].dataType.simpleString()
    ends = cut.select(F.col(by).alias("_block"), F.col("cell").alias("_cell")).distinct().join(first, "_block")
    return cut.groupBy(by, "cell").cogroup(ends.groupBy("_block", "_cell")).applyInArrow(run, f"{by} {kind}, t long, " + ", ".join(f"{n} double" for n in names))


def weighted(rows: DataFrame, noise: DataFrame, value: str | list[str], bandwidth: int, to: str | list[str] = "y", remove_mean: bool = True, by: str = "block_id", method: str = "auto", fft_size: int | str | None = None) -> DataFrame:
    """The noise weighting of one sample vector or several: diagonal for bandwidth 1, else block means off and the banded product."""
    if bandwidth == 1:
        return diagonal_product(rows, noise, value, to, by)
    rows = mean_removed(rows, value, by) if remove_mean else rows
    return wide_product(rows, noise, value, to, by, method=method, fft_size=fft_size)


def gappy_product(rows: DataFrame, gaps: DataFrame, row: Sequence | DataFrame, value: str, to: str = "y", by: str = "block_id") -> DataFrame:
    """Gaps zeroed, the product, gaps zeroed again; no mean removed. ``row``: one first row for all blocks, or a table (by, t array) of
    each block's own, of any width."""
    zeroed = gaps_reset(rows, gaps, value)
    if not isinstance(row, DataFrame):
        return gaps_reset(narrow_product(zeroed, value, row, to, by), gaps, to)
    product = wide_product(zeroed, row, value, to, by)
    return gaps_reset(rows.join(product, [by, "t"]), gaps, to)


def gappy_blocks(rows: DataFrame, gaps: DataFrame, bandwidth: int, by: str = "block_id") -> DataFrame:
    """``rows`` with ``by`` split at gaps of at least ``bandwidth`` rows, over which no product reaches, as (by, piece), and t from 0 in each
    piece; rows of such gaps go. ``gaps``: (id0, len) by ``row``."""
    long = gaps.filter(F.col("len") >= bandwidth)
    kept = in_gaps(rows, long).filter("NOT in_gap").drop("in_gap")
    part = index_sets.with_previous(index_sets.ranged(kept, [by], ["t"]), [by], "t", "_previous")
    part = part.withColumn("_broken", F.when(F.col("t") - F.col("_previous") > bandwidth - 1, 1).otherwise(0))
    cut = written(index_sets.running_total(part, [by], "_broken", "piece").select(*kept.columns, "piece"), "pieces")
    first = cut.groupBy(by, "piece").agg(F.min("t").alias("_first"))
    return cut.join(first, [by, "piece"]).select(*(F.col(c) if c != "t" else (F.col("t") - F.col("_first")).alias("t") for c in kept.columns), "piece")


def checked_bandwidth(noise: DataFrame, sizes: DataFrame, by: str = "block_id") -> None:
    """Raises where a block has fewer samples than its band is wide. ``sizes``: (by, n)."""
    short = noise.join(sizes, by).filter(F.size("t") > F.col("n")).select(by).limit(5).collect()
    if short:
        raise ValueError(f"blocks shorter than their band: {', '.join(str(r[0]) for r in short)}")
