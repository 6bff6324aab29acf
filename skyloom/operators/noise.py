"""Noise weights from data: periodogram, bounded fit of a 1/f model, inverse spectrum, apodised first row.

Blocks of up to ``LONG`` samples are an Arrow task each.  Longer ones are spread: their transform is a chirp-z transform by two four-step
transforms of a power of two (columns, a shuffle of tiles, rows and the product with the chirp's own transform, a shuffle, columns), the
fit sees means of the spectrum's logarithm over narrow bands, and each stretch of frequencies has its part of the first row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyloom.functions import numeric
from skyloom.sources.staging import written

#: Samples of a block that one task takes.
LONG = 1 << 18
#: Numbers of a tile's column or row that a task of a long transform holds, about.
TASK = 1 << 18
#: Bands for each factor e of frequency.
BANDS = 4000
_FITS = "n long, t array<double>, log_sigma2 double, alpha double, knee double, fmin double"


def _fit_row(row: np.ndarray, n: int, p: np.ndarray) -> dict:
    return {"n": pa.array([n], pa.int64()), "t": pa.array([row.tolist()], pa.list_(pa.float64())), **{k: pa.array([float(x)]) for k, x in zip(("log_sigma2", "alpha", "knee", "fmin"), p)}}


def _parted(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the blocks that a task takes, and those of the longer ones, if any."""
    sizes = written(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    if sizes.filter(F.col("_n") > LONG).isEmpty():
        return rows, None
    held = rows.join(sizes, by)
    return held.filter(F.col("_n") <= LONG).drop("_n"), held.filter(F.col("_n") > LONG).drop("_n")


def inverse_noise(rows: DataFrame, value: str, rate: float, bandwidth: int, window: str = "chebwin", by: str = "block_id") -> DataFrame:
    """(by, n, t array, log_sigma2, alpha, knee, fmin): one fit a block, blocks in parallel and long ones over many tasks."""
    kind = rows.schema[by].dataType.simpleString()
    short, long = _parted(rows.select(by, "t", value), by)

    def run(table: pa.Table) -> pa.Table:
        v = table.sort_by("t")[value].to_numpy().astype(float)
        row, p = numeric.inverse_noise_row(v, rate, bandwidth, window)
        return pa.table({by: table[by].slice(0, 1), **_fit_row(row, len(v), p)})

    out = short.groupBy(by).applyInArrow(run, f"{by} {kind}, {_FITS}")
    return out if long is None else out.unionByName(_long_inverse(long, value, rate, bandwidth, window, by))


def spectra(rows: DataFrame, value: str, rate: float, by: str = "block_id") -> DataFrame:
    """(by, k, f, power): the periodogram of each block."""
    kind = rows.schema[by].dataType.simpleString()
    short, long = _parted(rows.select(by, "t", value), by)

    def run(table: pa.Table) -> pa.Table:
        f, power = numeric.periodogram(table.sort_by("t")[value].to_numpy().astype(float), rate)
        names = pa.array([table[by][0].as_py()] * len(f), table[by].type)
        return pa.table({by: names, "k": pa.array(np.arange(len(f))), "f": pa.array(f), "power": pa.array(power)})

    out = short.groupBy(by).applyInArrow(run, f"{by} {kind}, k long, f double, power double")
    return out if long is None else out.unionByName(long_spectra(long, value, rate, by))


# long blocks -------------------------------------------------------------------------------------------------------


def _shape(n: int) -> tuple[int, int, int, int]:
    """(columns' length, rows' length, columns of a tile, rows of a tile) of the transform for n samples."""
    bits = max(2, (2 * n - 2).bit_length())
    n1 = 1 << bits // 2
    n2 = 1 << bits - bits // 2
    return n1, n2, max(1, min(n2, TASK // n1)), max(1, min(n1, TASK // n2))


def _tiles(m: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    return ((k, m[at : at + width]) for k, at in enumerate(range(0, len(m), width)))


def _complex(column) -> np.ndarray:
    return np.frombuffer(column.as_buffer(), np.complex128)


def long_spectra(rows: DataFrame, value: str, rate: float, by: str = "block_id") -> DataFrame:
    """``spectra`` of blocks of any length, t = 0.. without gaps, no task holding one."""
    kind, t, v = rows.schema[by].dataType.simpleString(), F.col("_t").cast("double"), F.col("_v")
    rows = rows.select(by, (F.col("t") - F.lit(0)).cast("long").alias("t0"), F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(by).agg(F.min("t0").alias("_first"), F.count(F.lit(1)).alias("n"), F.avg("_v").alias("_mean"), F.regr_slope("_v", F.col("t0").cast("double")).alias("_slope"))
    ends = written(ends, "blocks")
    shape = {r.n: _shape(r.n) for r in ends.select("n").distinct().collect()}  # lengths of long blocks
    of = lambda k: F.element_at(F.create_map(*(F.lit(x) for n, s in shape.items() for x in (n, s[k]))), F.col("n"))
    line = F.col("_mean") + F.coalesce("_slope", F.lit(0.0)) * (t - (F.col("n") - 1) / 2.0)
    hann = 0.5 - 0.5 * F.cos(2 * np.pi * t / F.col("n"))
    samples = rows.join(ends, by).withColumn("_t", F.col("t0") - F.col("_first")).select(by, "n", "_t", ((v - line) * hann).alias("x"))
    samples = samples.select(by, "n", F.floor(F.col("_t") % of(1) / of(2)).alias("tile"), "_t", "x")
    # tiles without samples: the chirp has values there
    every = ends.select(by, "n", F.explode(F.sequence(F.lit(0), F.floor((of(1) - 1) / of(2)))).alias("tile")).select(by, "n", "tile", F.lit(None).cast("long").alias("_t"), F.lit(None).cast("double").alias("x"))
    tile = pa.schema([(by, pa.string()), ("n", pa.int64()), ("tile", pa.int64()), ("at", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
    tile_ddl = f"{by} {kind}, n long, tile long, at long, a binary, b binary"

    def emitted(block: pa.Array, n: int, at: int, a: np.ndarray, b: np.ndarray | None, width: int) -> Iterator[pa.Table]:
        for k, part in _tiles(a, width):
            other = b[k * width : (k + 1) * width].tobytes() if b is not None else None
            yield pa.table({by: block.slice(0, 1), "n": [n], "tile": [k], "at": [at], "a": pa.array([part.tobytes()], pa.binary()), "b": pa.array([other], pa.binary())})

    def columns(table: pa.Table) -> pa.Table:
        """Columns of the samples times the chirp, and of the chirp: transforms and twiddles."""
        n, k = table["n"][0].as_py(), table["tile"][0].as_py()
        n1, n2, width, height = shape[n]
        c = np.arange(k * width, (k + 1) * width)
        a = np.zeros((n1, width), complex)
        own = table.filter(pa.compute.is_valid(table["_t"]))
        at = own["_t"].to_numpy()
        a[at // n2, at % n2 - k * width] = own["x"].to_numpy() * np.conj(numeric.chirp(at, n))
        j = np.arange(n1)[:, None] * n2 + c
        back = n1 * n2 - j
        b = np.where(j < n, numeric.chirp(np.minimum(j, n), n), np.where(back < n, numeric.chirp(np.minimum(back, n), n), 0))
        turn = np.exp(-2j * np.pi * (np.arange(n1)[:, None] * c % (n1 * n2)) / (n1 * n2))
        return pa.concat_tables(emitted(table[by].combine_chunks(), n, k, np.fft.fft(a, axis=0) * turn, np.fft.fft(b, axis=0) * turn, height))

    def joined(table: pa.Table, name: str, rows_: int, length: int) -> np.ndarray:
        table = table.sort_by("at")
        return np.concatenate([_complex(x).reshape(rows_, -1) for x in table[name]], 1).reshape(rows_, length)

    def rows_of(table: pa.Table) -> pa.Table:
        """Rows: both transforms, their product, and the columns' step of the inverse, whose columns they are."""
        n, k = table["n"][0].as_py(), table["tile"][0].as_py()
        n1, n2, width, height = shape[n]
        c = np.fft.ifft(np.fft.fft(joined(table, "a", height, n2)) * np.fft.fft(joined(table, "b", height, n2)), axis=1)
        k1 = np.arange(k * height, (k + 1) * height)[:, None]
        c = c * np.exp(2j * np.pi * (k1 * np.arange(n2) % (n1 * n2)) / (n1 * n2))
        return pa.concat_tables(emitted(table[by].combine_chunks(), n, k, np.ascontiguousarray(c.T), None, width))

    def back(table: pa.Table) -> pa.Table:
        """The rows' step of the inverse, the chirp taken off: the spectrum at every n2-th frequency from each of the tile's."""
        n, k = table["n"][0].as_py(), table["tile"][0].as_py()
        n1, n2, width, height = shape[n]
        x = np.fft.ifft(joined(table, "a", width, n1), axis=1)
        at = np.arange(k * width, (k + 1) * width)[:, None] + n2 * np.arange(n1)
        own = at <= n // 2
        power, at = np.abs(x[own]) ** 2, at[own]  # the chirp has length 1
        norm = rate * 0.375 * n  # of the periodic window's squares
        power = power / norm * np.where((at > 0) & ((at < n // 2) | (n % 2 == 1)), 2.0, 1.0)
        return pa.table({by: table[by].take(pa.array(np.zeros(len(at), int))), "k": pa.array(at), "f": pa.array(at * rate / n), "power": pa.array(power)})

    first = written(samples.unionByName(every).groupBy(by, "tile").applyInArrow(columns, tile_ddl), "tiles")
    second = written(first.groupBy(by, "tile").applyInArrow(rows_of, tile_ddl), "tiles")
    return second.groupBy(by, "tile").applyInArrow(back, f"{by} {kind}, k long, f double, power double")


def _long_inverse(rows: DataFrame, value: str, rate: float, bandwidth: int, window: str, by: str) -> DataFrame:
    kind = rows.schema[by].dataType.simpleString()
    found = written(long_spectra(rows, value, rate, by), "spectra")
    band = F.floor(F.log(F.col("k").cast("double")) * BANDS)
    means = found.filter("k > 0 AND power > 0").groupBy(by, band.alias("band")).agg(F.exp(F.avg(F.log("f"))).alias("f"), F.avg(F.log10("power")).alias("y"), F.count(F.lit(1)).cast("double").alias("count"))

    def fit(table: pa.Table) -> pa.Table:  # BANDS rows a factor e
        p = numeric.fit_means(*(table[c].to_numpy() for c in ("f", "y", "count")))
        return pa.table({by: table[by].slice(0, 1), **{k: pa.array([float(x)]) for k, x in zip(("log_sigma2", "alpha", "knee", "fmin"), p)}})

    fits = means.groupBy(by).applyInArrow(fit, f"{by} {kind}, log_sigma2 double, alpha double, knee double, fmin double")
    fits = written(fits.join(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by), "fits")
    stretches = fits.withColumn("first", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2), F.lit(TASK))))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                n, first, *p = (b[c][r].as_py() for c in ("n", "first", "log_sigma2", "alpha", "knee", "fmin"))
                if bandwidth > n // 2:
                    raise ValueError(f"bandwidth {bandwidth} is over half of the {n} samples")
                k = np.arange(first, min(first + TASK, n // 2 + 1))
                s = numeric.inverse_psd(k * rate / n, *p) * np.where((k > 0) & ((k < n // 2) | (n % 2 == 1)), 2.0, 1.0)
                row = numeric.partial_inverse(s, first, n, bandwidth).real / n
                yield pa.RecordBatch.from_arrays([b[by].take(pa.array([r] * bandwidth)), pa.array(np.arange(bandwidth)), pa.array(row)], [by, "j", "x"])

    each = stretches.repartition(by, "first").mapInArrow(parts, f"{by} {kind}, j long, x double").groupBy(by, "j").agg(F.sum("x").alias("x"))
    half = numeric.half_chebyshev(bandwidth) if window == "chebwin" else numeric.half_gaussian(bandwidth)
    apodised = F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"])
    whole = each.groupBy(by).agg(apodised.alias("t"))  # ``bandwidth`` numbers a block
    windowed = F.zip_with("t", F.array(*map(F.lit, half.tolist())) if bandwidth <= 64 else F.from_json(F.lit(str(half.tolist())), "array<double>"), lambda a, w: a * w)
    return fits.join(whole.select(by, windowed.alias("t")), by).select(by, F.col("n").cast("long").alias("n"), "t", "log_sigma2", "alpha", "knee", "fmin")


def effective_spectra(noise: DataFrame, n: int, by: str = "block_id") -> DataFrame:
    """(by, k, power) of each truncated row's circulant of length n."""
    kind = noise.schema[by].dataType.simpleString()

    def run(batches):
        for b in batches:
            for name, row in zip(b[by].to_pylist(), b["t"].to_pylist()):
                power = numeric.effective_psd(np.array(row), n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(power), b[by].type), pa.array(np.arange(len(power))), pa.array(power)], [by, "k", "power"])

    return noise.select(by, "t").mapInArrow(run, f"{by} {kind}, k long, power double")


def uniform(rows: DataFrame, by: str = "block_id") -> DataFrame:
    """Weight 1 for every block: the uniform and the noiseless mode."""
    return rows.select(by).distinct().withColumn("t", F.array(F.lit(1.0)))
