"""Time-domain templates as a long sparse table (block_id, t, bin, w): polynomials by sweep, azimuth bins, half-wave
plate harmonics; their products with samples, Gram matrices and pseudo-inverses.

Bins are numbered contiguously within a block: all orders of the polynomials (order by order), azimuth bins, then cosine and
sine of each harmonic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions.numeric import pseudo_inverse
from skyloom.sources.staging import written


def legendre_column(order: int, x: Column) -> Column:
    before, now = F.lit(1.0), x
    if order == 0:
        return before
    for n in range(2, order + 1):
        before, now = now, ((2 * n - 1) * x * now - (n - 1) * before) / n
    return now


def sweep_position(t: Column, t0: Column, t1: Column) -> Column:
    """-1 .. 1 over a sweep; 0 where it has one sample only."""
    return F.when(t1 > t0, (2 * t - t0 - t1) / (t1 - t0).cast("double")).otherwise(F.lit(0.0))


def azimuth_bin(az: Column, low: Column, high: Column, bins: int) -> Column:
    """0 where the azimuth doesn't vary."""
    return F.when(high > low, F.least(F.lit(bins - 1), F.floor((az - low) * bins / (high - low)))).otherwise(F.lit(0)).cast("int")


def azimuth_range(scan: DataFrame, by: str = "obs_id") -> DataFrame:
    return scan.groupBy(by).agg(F.min("az").alias("az_min"), F.max("az").alias("az_max"))


def polynomials(scan: DataFrame, orders: int) -> DataFrame:
    """``scan`` has block_id, t, sweep, t0, t1 and n_sweeps."""
    x = sweep_position(F.col("t"), F.col("t0"), F.col("t1"))
    entries = F.array(*(F.struct((F.lit(k) * F.col("n_sweeps") + F.col("sweep")).cast("int").alias("bin"), legendre_column(k, x).alias("w")) for k in range(orders)))
    return scan.select("block_id", "t", F.explode(entries).alias("e")).select("block_id", "t", "e.bin", "e.w")


def scan_synchronous(scan: DataFrame, bins: int, first: Column | int = 0) -> DataFrame:
    first = F.lit(first) if isinstance(first, int) else first
    return scan.select("block_id", "t", (first + azimuth_bin(F.col("az"), F.col("az_min"), F.col("az_max"), bins)).cast("int").alias("bin"), F.lit(1.0).alias("w"))


def plate_synchronous(scan: DataFrame, harmonics: int, length: int, bins: int, first: Column | int = 0) -> DataFrame:
    """``length`` samples a bin."""
    first = F.lit(first) if isinstance(first, int) else first
    at = F.floor(F.col("t") / length)
    parts = [F.struct((first + F.lit(2 * k * bins + s * bins) + at).cast("int").alias("bin"), (F.cos if s == 0 else F.sin)((k + 1) * F.col("hwp_angle")).alias("w")) for k in range(harmonics) for s in (0, 1)]
    return scan.select("block_id", "t", F.explode(F.array(*parts)).alias("e")).select("block_id", "t", "e.bin", "e.w")


def _classes(rows: DataFrame, orders: int, azimuth_bins: int, harmonics: int, length: int) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """``rows`` beside what their block and sweep have, and the (bin, weight) of each class. A sample without sweep has null bins of polynomials."""
    if not (orders or azimuth_bins or harmonics):
        raise ValueError("no templates are asked for")
    empty = F.lit(0).cast("double")
    first = lambda name: F.min(name) if name in rows.columns else F.first(empty)
    last = lambda name: F.max(name) if name in rows.columns else F.first(empty)
    ends = rows.groupBy("block_id").agg(F.min("t").alias("_t"), F.max("t").alias("_tz"), first("sweep").alias("_s"), last("sweep").alias("_sz"), first("az").alias("az_min"), last("az").alias("az_max"))
    n_sweeps, n_plate = F.col("_sz") - F.col("_s") + 1, F.floor((F.col("_tz") - F.col("_t")) / length) + 1
    ends = ends.select("block_id", "_t", "_s", "az_min", "az_max", n_sweeps.cast("int").alias("n_sweeps"), n_plate.cast("int").alias("_plate"))
    scan = rows.join(written(ends, "blocks"), "block_id")  # written, so that Spark knows that they are few and leaves the samples where they are
    out: list[tuple[Column, Column]] = []
    at = F.lit(0)
    if orders:
        bounds = written(rows.groupBy("block_id", "sweep").agg(F.min("t").alias("t0"), F.max("t").alias("t1")), "sweeps")
        scan = scan.join(bounds, ["block_id", "sweep"], "left").withColumn("_x", sweep_position(F.col("t"), F.col("t0"), F.col("t1")))
        out += [(F.lit(k) * F.col("n_sweeps") + F.col("sweep") - F.col("_s"), legendre_column(k, F.col("_x"))) for k in range(orders)]
        at = at + orders * F.col("n_sweeps")
    if azimuth_bins:
        out.append((at + azimuth_bin(F.col("az"), F.col("az_min"), F.col("az_max"), azimuth_bins), F.lit(1.0)))
        at = at + azimuth_bins
    for k in range(harmonics):
        for s, wave in enumerate((F.cos, F.sin)):
            out.append((at + (2 * k + s) * F.col("_plate") + F.floor((F.col("t") - F.col("_t")) / length), wave((k + 1) * F.col("hwp_angle"))))
    return scan, [(bin_.cast("int"), w) for bin_, w in out]


def expanded(rows: DataFrame, orders: int = 0, azimuth_bins: int = 0, harmonics: int = 0, length: int = 1) -> DataFrame:
    """All templates of ``rows`` (block_id, t and, as needed, sweep, az, hwp_angle), bins one class after the other within a block."""
    scan, classes = _classes(rows, orders, azimuth_bins, harmonics, length)
    entries = F.array(*(F.struct(bin_.alias("bin"), w.alias("w")) for bin_, w in classes))
    return scan.select("block_id", "t", F.explode(entries).alias("e")).select("block_id", "t", "e.bin", "e.w").filter("bin IS NOT NULL")


def beside(rows: DataFrame, orders: int = 0, azimuth_bins: int = 0, harmonics: int = 0, length: int = 1) -> DataFrame:
    """The same beside the samples: ``rows`` with arrays bin and w, an element a class; a null bin is none."""
    scan, classes = _classes(rows, orders, azimuth_bins, harmonics, length)
    return scan.select(*rows.columns, F.array(*(bin_ for bin_, _ in classes)).alias("bin"), F.array(*(w for _, w in classes)).alias("w"))


def project(templates: DataFrame, amplitudes: DataFrame, to: str | list[str] = "y") -> DataFrame:
    """T tau: (block_id, t, y). A list ``to`` takes as many columns tau0, tau1, ..."""
    pairs = [("tau", to)] if isinstance(to, str) else [(f"tau{k}", c) for k, c in enumerate(to)]
    return templates.join(amplitudes, ["block_id", "bin"]).groupBy("block_id", "t").agg(*(F.sum(F.col("w") * F.col(tau)).alias(c) for tau, c in pairs))


def scatter(templates: DataFrame, rows: DataFrame, value: str | list[str]) -> DataFrame:
    """T^T d: (block_id, bin, amp). A list of values makes columns amp0, amp1, ..."""
    pairs = [(value, "amp")] if isinstance(value, str) else [(c, f"amp{k}") for k, c in enumerate(value)]
    return templates.join(rows.select("block_id", "t", *(c for c, _ in pairs)), ["block_id", "t"]).groupBy("block_id", "bin").agg(*(F.sum(F.col("w") * F.col(c)).alias(amp) for c, amp in pairs))


def kernel(templates: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """T^T W T by block: (block_id, a, b, k). A sample has one bin of each class, so the self-join on (block, t) makes
    the square of the number of classes."""
    other = templates.select("block_id", "t", F.col("bin").alias("b"), F.col("w").alias("w2"))
    k = templates.withColumnRenamed("bin", "a").join(other, ["block_id", "t"]).groupBy("block_id", "a", "b").agg(F.sum(F.col("w") * F.col("w2")).alias("k"))
    return k if weights is None else k.join(weights.select("block_id", "weight"), "block_id").withColumn("k", F.col("k") * F.col("weight")).drop("weight")


def inverted(kernels: DataFrame, rcond: float = 1e-12) -> DataFrame:
    """(block_id, a, b, k, rank): pseudo-inverse of each block's kernel, all pairs of its templates; for few templates a block.
    ``template_fit`` needs neither kernel nor inverse."""
    kind = kernels.schema["block_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        names = np.unique(np.concatenate([a, b]))
        dense = np.zeros((len(names),) * 2)
        dense[np.searchsorted(names, a), np.searchsorted(names, b)] = table["k"].to_numpy()
        inv, rank = pseudo_inverse(dense, rcond)
        i, j = np.indices(inv.shape)
        block = pa.array([table["block_id"][0].as_py()] * inv.size, table["block_id"].type)
        return pa.table({"block_id": block, "a": pa.array(names[i.ravel()], pa.int32()), "b": pa.array(names[j.ravel()], pa.int32()), "k": pa.array(inv.ravel()), "rank": pa.array([rank] * inv.size, pa.int32())})

    return kernels.select("block_id", "a", "b", F.col("k").cast("double")).groupBy("block_id").applyInArrow(run, f"block_id {kind}, a int, b int, k double, rank int")


def amplitudes(inverse: DataFrame, right: DataFrame) -> DataFrame:
    """tau = K^+ (T^T d)."""
    return inverse.join(right.withColumnRenamed("bin", "b"), ["block_id", "b"]).groupBy("block_id", F.col("a").alias("bin")).agg(F.sum(F.col("k") * F.col("amp")).alias("tau"))
