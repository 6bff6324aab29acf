"""Sources: Parquet samples, legacy raw binary files, ASCII matrices, synthetic samples, and the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyloom.sources.staging import written
from skyloom.sources.stores import matching, store

#: Fixed formats of raw files: kind -> numpy type and values a sample.
RAW = {"pointing": ("<u4", 1), "signal": ("<f8", 1), "angle": ("<f8", 1), "pixels": ("<u4", 3), "weights": ("<f8", 3), "bandwidth": ("<f8", 1), "sizes": ("<i4", 1), "indices": ("<i4", 3), "integers": ("<i4", 1)}


class Rows(InputPartition):
    """Rows ``first`` to ``first`` + ``count`` of a file."""

    def __init__(self, path: str, part: int | None, first: int, count: int):
        super().__init__(path)
        self.path, self.part, self.first, self.count = path, part, first, count


class RawReader(DataSourceReader):
    """A file lies in as many tasks as it has stretches of ``rows``; a task seeks its own and reads it in slices."""

    SLICE = 1 << 16

    def __init__(self, path: str, kind: str, rows: int):
        self.path, self.kind, self.rows = path, kind, rows

    def partitions(self) -> list[Rows]:
        dtype, width = RAW[self.kind]
        out = []
        for path, size in matching(self.path):
            number = re.search(r"(\d+)\.[^./]*$", path)
            held = size // (np.dtype(dtype).itemsize * width)
            out += [Rows(path, int(number[1]) if number else None, at, min(self.rows, held - at)) for at in range(0, held, self.rows)]
        return out or [Rows("", None, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        dtype, width = RAW[self.kind]
        kind, one = (pa.float64(), "f8") if dtype.endswith("f8") else (pa.int64(), "i8")
        size = np.dtype(dtype).itemsize * width
        with store(self.path)[0].open_input_file(partition.path) as f:
            f.seek(partition.first * size)
            for at in range(0, partition.count, self.SLICE):
                n = min(self.SLICE, partition.count - at)
                flat = np.frombuffer(f.read(n * size), dtype).astype(one)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(flat, kind))
                first = partition.first + at
                yield pa.RecordBatch.from_arrays([pa.array([partition.part] * n, pa.int64()), pa.array(np.arange(first, first + n)), values], ["part", "row", "values"])


class RawFiles(DataSource):
    """Options: path (a file, a folder or names with wildcards), kind (of ``RAW``), rows (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "skyloom_raw"

    def schema(self) -> str:
        return f"part long, row long, values array<{'double' if RAW[self.options['kind']][0].endswith('f8') else 'bigint'}>"

    def reader(self, schema) -> RawReader:
        return RawReader(self.options["path"], self.options["kind"], int(self.options.get("rows", 1 << 22)))


def raw(spark: SparkSession, path: str, kind: str, rows: int = 1 << 22) -> DataFrame:
    """(part, row, values array) of raw binary files, a task for each ``rows`` rows of a file; ``part`` is the number at the end of the file's
    name."""
    spark.dataSource.register(RawFiles)
    return spark.read.format("skyloom_raw").options(kind=kind, rows=rows).load(path)


def _fits_start(f) -> tuple[int, int]:
    """Where the table's data begin and how many rows it has."""
    text, ends, head = b"", 0, 0
    while ends < 2:
        block = f.read(2880)
        if len(block) < 2880:
            raise ValueError("no FITS table")
        text += block
        if any(block[k : k + 80].rstrip() == b"END" for k in range(0, 2880, 80)):
            ends += 1
            head = len(text) if ends == 1 else head
    return len(text), int(re.search(rb"NAXIS2\s*=\s*(\d+)", text[head:])[1])


class FitsReader(RawReader):
    """The one column of a HEALPix table, by stretches of its rows."""

    def __init__(self, path: str, rows: int):
        super().__init__(path, "signal", rows)

    def partitions(self) -> list[Rows]:
        out = []
        for path, _ in matching(self.path):
            with store(self.path)[0].open_input_file(path) as f:
                _, held = _fits_start(f)
            out += [Rows(path, None, at, min(self.rows, held - at)) for at in range(0, held, self.rows)]
        return out or [Rows("", None, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        with store(self.path)[0].open_input_file(partition.path) as f:
            start, _ = _fits_start(f)
            f.seek(start + 8 * partition.first)
            for at in range(0, partition.count, self.SLICE):
                n, first = min(self.SLICE, partition.count - at), partition.first + at
                values = np.frombuffer(f.read(8 * n), ">f8").astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(values)], ["pix", "value"])


class FitsFiles(DataSource):
    """Options: path, rows (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "skyloom_fits"

    def schema(self) -> str:
        return "pix long, value double"

    def reader(self, schema) -> FitsReader:
        return FitsReader(self.options["path"], int(self.options.get("rows", 1 << 22)))


def fits_map(spark: SparkSession, path: str, rows: int = 1 << 22) -> DataFrame:
    """(pix, value) of a HEALPix map in FITS."""
    spark.dataSource.register(FitsFiles)
    return spark.read.format("skyloom_fits").option("rows", rows).load(path)


def raw_samples(spark: SparkSession, pixels: str, weights: str, signal: str) -> DataFrame:
    """part, row, pix, w_i, w_q, w_u, signal from three sets of raw files; pixels are 3 * pix + s."""
    p, w, s = raw(spark, pixels, "pixels"), raw(spark, weights, "weights"), raw(spark, signal, "signal")
    keys = ["part", "row"]
    joined = p.withColumnRenamed("values", "p").join(w.withColumnRenamed("values", "w"), keys).join(s.withColumnRenamed("values", "s"), keys)
    return joined.select(*keys, F.floor(F.col("p")[0] / 3).alias("pix"), *(F.col("w")[k].alias(n) for k, n in enumerate(("w_i", "w_q", "w_u"))), F.col("s")[0].alias("signal"))


def map_parts(spark: SparkSession, path: str) -> DataFrame:
    """part, pix, hits, rcond, i of binary map parts."""
    from skyloom.sources.sinks import PARTS

    out = None
    for column, (name, kind) in PARTS.items():
        one = raw(spark, f"{path}/{name}[0-9]*.dat", "integers" if kind == "<i4" else "signal").select("part", "row", F.col("values")[0].alias(column))
        out = one if out is None else out.join(one, ["part", "row"])
    return out.drop("row")


def angled_samples(spark: SparkSession, pointing: str, angle: str, signal: str) -> DataFrame:
    """part, row, pix, w_i, w_q, w_u, signal from pixels, polarisation angles (weights 1, cos 2a, sin 2a) and signals."""
    keys = ["part", "row"]
    one = lambda path, kind, name: raw(spark, path, kind).select(*keys, F.col("values")[0].alias(name))
    joined = one(pointing, "pointing", "pix").join(one(angle, "angle", "a"), keys).join(one(signal, "signal", "signal"), keys)
    return joined.select(*keys, "pix", F.lit(1.0).alias("w_i"), F.cos(2 * F.col("a")).alias("w_q"), F.sin(2 * F.col("a")).alias("w_u"), "signal")


def noise_blocks(spark: SparkSession, path: str, bandwidth: int) -> DataFrame:
    """block_id and first row t of raw files that hold ``bandwidth`` numbers a block; blocks are counted over files."""
    values = raw(spark, path, "bandwidth").select("part", "row", F.col("values")[0].alias("v"))
    rows = values.groupBy("part", F.floor(F.col("row") / bandwidth).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda x: x["v"]).alias("t"))
    order = Window.orderBy("part", "k")  # one row a noise block
    return rows.filter(F.size("t") == bandwidth).select((F.row_number().over(order) - 1).cast("long").alias("block_id"), "t")


def ell(spark: SparkSession, path: str) -> DataFrame:
    """(part, line, j, col, val) of ASCII files with lines ``idx val [idx val ...]``.  Lines are numbered from 0 in each file: each split of
    a file numbers its own, after those of the splits before it."""
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = written(spark.read.text(path).select("value", file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("id")), "lines")
    held = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")  # a row a split
    lines = lines.join(held.select("file", "block", (before - F.col("first")).alias("shift")), ["file", "block"])
    words = lines.select(F.regexp_extract("file", r"(\d+)\.[^./]*$", 1).cast("long").alias("part"), (F.col("id") + F.col("shift")).alias("line"), F.split(F.trim("value"), r"\s+").alias("w"))
    pairs = words.filter(F.size("w") > 1).select("part", "line", "w", F.explode(F.sequence(F.lit(0), (F.size("w") / 2 - 1).cast("int"))).alias("j"))
    return pairs.select("part", "line", "j", F.get("w", 2 * F.col("j")).cast("long").alias("col"), F.get("w", 2 * F.col("j") + 1).cast("double").alias("val"))


def synthetic(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """signal = 1 + (10 u - 1), pixel = row."""
    return spark.range(rows).select(F.col("id").alias("row"), F.col("id").alias("pix"), (F.lit(1.0) + (10 * F.rand(seed) - 1)).alias("signal"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# the driver's tables as samples -----------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def pixel_of_user() -> Column:
    return F.col("user_id")


def pixel_of_user_hour() -> Column:
    return F.col("user_id") * 24 + F.hour("ts")


def event_pointing(spark: SparkSession, sf_dir: str, pix: Column | None = None) -> DataFrame:
    """Events as samples with exact weights: event_id, block_id, pix, w_i, w_q, w_u, d (hundredths of the value)."""
    k = F.col("event_id") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int")).cast("long")
    pix = pixel_of_user() if pix is None else pix
    return events(spark, sf_dir).select(
        "event_id", F.col("event_id").alias("row"), F.col("event_type").alias("block_id"), pix.cast("long").alias("pix"), F.lit(1).cast("long").alias("w_i"),
        pick(1, 0, -1, 0).alias("w_q"), pick(0, 1, 0, -1).alias("w_u"), F.round(F.col("value") * 100).cast("long").alias("d"), "ts",
    )


def event_samples(spark: SparkSession, sf_dir: str, pix: Column | None = None) -> DataFrame:
    """``event_pointing`` with t, the place within the block by time."""
    from skyloom.operators.index_sets import numbered_within

    return numbered_within(event_pointing(spark, sf_dir, pix), ["block_id"], ["ts", "event_id"], "t")
