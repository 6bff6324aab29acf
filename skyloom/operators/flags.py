"""Flags, gaps and sweeps of the samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.operators.index_sets import numbered, numbered_within


def flagged(shared: Column, shared_mask: int, detector: Column | None = None, detector_mask: int = 0) -> Column:
    if shared_mask < 0 or detector_mask < 0:
        raise ValueError("flag masks can't be negative")
    bits = shared.bitwiseAND(F.lit(shared_mask))
    if detector is not None:
        bits = bits.bitwiseOR(detector.bitwiseAND(F.lit(detector_mask)))
    return bits != 0


def masked(tod: DataFrame, is_flagged: Column) -> DataFrame:
    """Flagged samples get pixel -1; they keep their place in the noise block."""
    return tod.withColumn("pix", F.when(is_flagged, F.lit(-1)).otherwise(F.col("pix")).cast("long"))


def in_gaps(rows: DataFrame, gaps: DataFrame, row: str = "row", span: int = 4096) -> DataFrame:
    """``rows`` with in_gap. Gaps (id0, len) are cut at multiples of ``span`` and gathered by cell (``span`` starts at most), so the
    interval join is one equi-join that leaves the number of rows as it is."""
    first, last = F.floor(F.col("id0") / span), F.floor((F.col("id0") + F.col("len") - 1) / span)
    cut = gaps.filter("len > 0").select("id0", (F.col("id0") + F.col("len")).alias("end"), F.explode(F.sequence(first, last)).alias("_cell"))
    ends = cut.groupBy("_cell", F.greatest("id0", F.col("_cell") * span).alias("a")).agg(F.max(F.least("end", (F.col("_cell") + 1) * span)).alias("z"))
    cells = ends.groupBy("_cell").agg(F.collect_list(F.struct("a", "z")).alias("_gaps"))
    inside = F.exists("_gaps", lambda g: (F.col(row) >= g["a"]) & (F.col(row) < g["z"]))
    joined = rows.withColumn("_cell", F.floor(F.col(row) / span)).join(cells, "_cell", "left")
    return joined.withColumn("in_gap", F.coalesce(inside, F.lit(False))).drop("_cell", "_gaps")


def gaps_reset(rows: DataFrame, gaps: DataFrame, value: str, row: str = "row") -> DataFrame:
    """Values inside gaps become 0."""
    return in_gaps(rows, gaps, row).withColumn(value, F.when(F.col("in_gap"), F.lit(0)).otherwise(F.col(value))).drop("in_gap")


def gaps_dropped(rows: DataFrame, gaps: DataFrame, row: str = "row", by: list[str] | None = None) -> DataFrame:
    """Rows outside gaps, renumbered from 0 within ``by`` (column ``packed``)."""
    out = in_gaps(rows, gaps, row).filter("NOT in_gap").drop("in_gap")
    return numbered_within(out, by, [row], "packed") if by else numbered(out, [row], "packed")


def gaps_filled(packed: DataFrame, rows: DataFrame, value: str, row: str = "row") -> DataFrame:
    """All rows again, 0 where a gap was."""
    return rows.select(row).join(packed.select(row, value), row, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def gaps_reduced(rows: DataFrame, gaps: DataFrame, most: int, value: str, row: str = "row") -> DataFrame:
    """Each gap keeps its first min(most, len) rows, as zeros."""
    beyond = gaps.select((F.col("id0") + most).alias("id0"), (F.col("len") - most).alias("len")).filter("len > 0")
    zeroed = gaps_reset(rows, gaps, value, row)
    return in_gaps(zeroed, beyond, row).filter("NOT in_gap").drop("in_gap")


def scan_sweeps(scan: DataFrame, bit: int = 8, by: str = "obs_id", chunk: int = 1 << 18) -> DataFrame:
    """``sweep`` from turnaround flags: a new one begins at t when flags(t) reaches ``bit`` and shares no such bits with
    flags(t-1).  Chunks of an observation count their own; what those before them hold is added (a row a chunk)."""
    cells = F.sequence(F.floor(F.col("t") / chunk), F.floor((F.col("t") + 1) / chunk))
    w = Window.partitionBy(by, "_cell").orderBy("t")
    before = F.lag("flags").over(w)
    edge = before.isNotNull() & (before.bitwiseAND(F.col("flags")) < bit) & (F.col("flags") >= bit)
    marked = scan.withColumn("_cell", F.explode(cells)).withColumn("_edge", edge.cast("int"))
    marked = marked.filter(F.col("_cell") == F.floor(F.col("t") / chunk))
    held = marked.groupBy(by, "_cell").agg(F.sum("_edge").alias("_held"))
    held = held.select(by, "_cell", (F.sum("_held").over(Window.partitionBy(by).orderBy("_cell")) - F.col("_held")).alias("_before"))
    out = marked.join(held, [by, "_cell"]).withColumn("sweep", (F.col("_before") + F.sum("_edge").over(w)).cast("int"))
    return out.select(*scan.columns, "sweep")


def fixed_sweeps(scan: DataFrame, seconds: float, rate: float) -> DataFrame:
    if (length := int(seconds * rate)) < 1:
        raise ValueError(f"a sweep of {seconds} s at {rate} Hz holds no sample")
    return scan.withColumn("sweep", F.floor(F.col("t") / length).cast("int"))


def sweep_bounds(scan: DataFrame, by: str = "obs_id") -> DataFrame:
    """(by, sweep, t0, t1): first and last sample, both inside."""
    return scan.groupBy(by, "sweep").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))


def block_sizes(tod: DataFrame) -> DataFrame:
    return tod.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


def detectors(tod: DataFrame, most: int) -> DataFrame:
    return tod.filter(F.col("det") < most)


def scaled(tod: DataFrame, signal: float = 1.0, noise: float = 1.0) -> DataFrame:
    """Signal times its fraction; noise over the square root of its down-scaling."""
    if noise <= 0:
        raise ValueError("noise down-scaling must be positive")
    return tod.withColumn("signal", F.col("signal") * signal).withColumn("noise", F.col("noise") / noise**0.5)
