"""Generalised least squares maps by preconditioned conjugate gradients.

The system is (A^T F A) x = A^T F d, with F the noise weighting, or for template marginalisation the weighting less
its projection on the templates.  It is never formed.  Samples are laid out once, one row a chunk of a noise block with
arrays of pixel places, weights and data (chunks of long blocks overlap by the bandwidth less one), written and read
in each iteration by one job: project, weight, scatter within the task, and sum over chunks by place.

Templates are not written out: their classes are expanded chunk by chunk, and fitted by ``template_fit``.  What pixels and templates share, A^T F T,
is summed once; where its entries fit the driver an iteration has no job, since A^T F A has a block a pixel there (templates need a
bandwidth of 1).  Beyond that an iteration has two jobs: chunks take off the templates that only they have, with factors that lie beside them, and hand
on what the few others meet; those are fitted on the driver, and the second job takes off the fit.

Map vectors have three numbers for each observed pixel.  Up to ``DRIVER_PIXELS`` of them live on the driver and are broadcast
(a size that is checked); above that ``table_solver`` keeps vectors as tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from skyloom.functions import numeric
from skyloom.operators import pixel_blocks, pointing, template_fit, templates as long_templates, toeplitz
from skyloom.sources.staging import as_bytes, from_bytes, wide_rows, written

DRIVER_PIXELS = 12 * 1024**2
#: Numbers of template factors that the driver holds (of all blocks, or of what several chunks share) or a task of one chunk, and template bins and blocks.
DRIVER_FACTORS = 32 * 1024**2
DRIVER_BINS = 4 * 1024**2
#: Entries (pixel, template) that the driver holds; more are left in their chunks.
DRIVER_CROSS = 4 * 1024**2
WEIGHTS = pointing.WEIGHTS
#: What chunks with templates hold as integers of 32 bits.
INTEGERS = ("place", "sweep", "az", "plate")
#: Samples of a chunk, at least eight bandwidths, and with templates.
CHUNK = 1 << 16
TEMPLATE_CHUNK = 1 << 14
#: Rows of a block vector that the driver turns at a time.
STRIPE = 1 << 16
#: Sums that a task holds to add up those of its chunks.
TASK_SUMS = 1 << 22


@dataclass
class Templates:
    """How to expand templates in a block: polynomial orders, azimuth bins, plate harmonics and their bin length."""

    orders: int = 0
    azimuth_bins: int = 0
    harmonics: int = 0
    plate_length: int = 1

    def expand(self, scan: dict[str, np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """[(bin of each sample, weight of each sample)] of the classes, and the number of bins, for the samples of a whole block."""
        at, sweeps, plates = {}, 0, 0
        if self.orders:
            at["sweep"] = sweep = scan["sweep"] - scan["sweep"].min()
            sweeps = int(sweep.max()) + 1
            t = scan["t"].astype(float)
            low, high = np.full(sweeps, np.inf), np.full(sweeps, -np.inf)
            np.minimum.at(low, sweep, t)
            np.maximum.at(high, sweep, t)
            width = (high - low)[sweep]
            at["x"] = np.where(width > 0, (2 * t - low[sweep] - high[sweep]) / np.where(width > 0, width, 1), 0.0)
        if self.azimuth_bins:
            az = scan["az"]
            at["az"] = np.minimum(self.azimuth_bins - 1, ((az - az.min()) * self.azimuth_bins / ((az.max() - az.min()) or 1.0)).astype(int))
        if self.harmonics:
            at["plate"] = ((scan["t"] - scan["t"].min()) // self.plate_length).astype(int)
            plates, at["hwp_angle"] = int(at["plate"].max()) + 1, scan["hwp_angle"]
        return self.classes(at, sweeps, plates), self.bins(sweeps, plates)

    def bins(self, sweeps: int, plates: int) -> int:
        return self.orders * sweeps + self.azimuth_bins + 2 * self.harmonics * plates

    def classes(self, at: dict[str, np.ndarray], sweeps: int, plates: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for any of a block's samples, of which ``at`` has the sweep and the place in it (x), the azimuth's bin, the plate's bin and
        angle. ``sweeps``, ``plates``: how many of each the block has."""
        classes, first = [], 0
        for k in range(self.orders):
            classes.append((first + at["sweep"], numeric.legendre(k, at["x"])))
            first += sweeps
        if self.azimuth_bins:
            classes.append((first + at["az"], np.ones(len(at["az"]))))
            first += self.azimuth_bins
        for k in range(1, self.harmonics + 1):
            for wave in (np.cos, np.sin):
                classes.append((first + at["plate"], wave(k * at["hwp_angle"])))
                first += plates
        return classes

    def kinds(self) -> dict[str, str]:
        """The columns of ``at`` and their types."""
        return ({"sweep": "bigint", "x": "double"} if self.orders else {}) | ({"az": "bigint"} if self.azimuth_bins else {}) | ({"plate": "bigint", "hwp_angle": "double"} if self.harmonics else {})


class TooMany(ValueError):
    """More than the driver holds: a case for ``table_solver``."""


def _places(known: np.ndarray, pix: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, pix) if len(known) else np.zeros(len(pix), int)
    return np.where((pix >= 0) & (at < len(known)), at, -1)


def _array(b: pa.RecordBatch, r: int, column: str) -> np.ndarray:
    return from_bytes(b, r, column, np.int32).astype(np.int64) if column in INTEGERS else from_bytes(b, r, column, np.float64)


def _entries(how: Templates, b: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    classes = _expanded(how, b, r)[0]
    row = np.tile(np.arange(len(_array(b, r, "place"))), len(classes))
    return row, *(np.concatenate(x).astype(k) for x, k in zip(zip(*classes), (np.int64, float)))


def _expanded(how: Templates, b: pa.RecordBatch, r: int) -> tuple[list, int, int]:
    """A chunk's classes, its block's first bin and number of bins."""
    first, bins, sweeps, plates = (b[c][r].as_py() for c in ("first", "bins", "sweeps", "plates"))
    return how.classes({c: _array(b, r, c) for c in how.kinds()}, sweeps, plates), first, bins


def _sums(at: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers and their sums of each of ``values``; without a sort where they lie near each other, as a chunk's bins of one class do."""
    low = int(at.min()) if len(at) else 0
    if len(at) and int(at.max()) - low < 4 * len(at):
        met = np.flatnonzero(np.bincount(at - low))
        return met + low, [np.bincount(at - low, v)[met] for v in values]
    met, at = np.unique(at, return_inverse=True)
    return met, [np.bincount(at, v, len(met)) for v in values]


def _template_values(b: pa.RecordBatch, r: int, sent, width: int) -> list[np.ndarray]:
    """F v of a chunk's samples, without templates: of the data, or of each map sent."""
    weight = b["weight"][r].as_py()
    if sent is None:
        return [weight * _array(b, r, "d")]
    place, w = _array(b, r, "place"), [_array(b, r, c) for c in WEIGHTS]
    return [weight * np.where(place >= 0, sum(w[s] * sent.value[3 * place + s, k] for s in range(3)), 0.0) for k in range(width)]


def _by_task(run: Callable, names: list[str], places: int) -> Callable:
    """(place, sums) of chunks, added up over a task where it can hold a number for each place."""
    if places * len(names) > TASK_SUMS:
        return run

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(names), places)), np.zeros(places, bool)
        for part in run(batches):
            at = part["place"].to_numpy()
            seen[at] = True
            for k, n in enumerate(names):
                total[k, at] += part[n].to_numpy()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(t[at]) for t in total)], ["place", *names])

    return whole


def _packed(sums: DataFrame) -> DataFrame:
    """A task's rows of (place, sums) as one, numbers as bytes."""
    names = sums.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b[n].to_numpy() for n in names] for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([as_bytes([np.concatenate(p)], np.int64 if n == "place" else np.float64) for n, p in zip(names, zip(*parts))], names)

    return sums.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


class NormalOperator:
    """``tod``: block_id, t, pix, w_i, w_q, w_u, value. ``noise``: block_id, t (first row of the block's matrix).
    ``scan`` columns (sweep, az, hwp_angle) are in ``tod`` where templates need them."""

    def __init__(self, tod: DataFrame, noise: DataFrame, bandwidth: int, value: str = "value", templates: Templates | None = None, remove_mean: bool = True, chunk: int | None = None, method: str = "auto", fft_size: int | str | None = None):
        if templates is not None and bandwidth != 1:
            raise ValueError("templates need a bandwidth of 1")
        self.spark, self.bandwidth, self.templates, self.remove_mean = tod.sparkSession, bandwidth, templates, remove_mean and bandwidth > 1
        self.sent: list[Broadcast] = []
        self.how = method, fft_size  # of products with the noise's bands, as ``numeric.banded_product`` has them
        pixels = tod.filter("pix >= 0").select("pix").distinct()
        count = pixels.count()
        if count > DRIVER_PIXELS:
            raise TooMany(f"{count} pixels are too many for vectors on the driver; use table_solver")
        chunk = chunk or (max(CHUNK, 8 * bandwidth) if templates is None else TEMPLATE_CHUNK)
        self.pixels = np.sort(np.array(pixels.toArrow()["pix"].to_numpy(), np.int64))
        self.rows = self._layout(tod, noise, value, chunk) if templates is None else self._template_layout(tod, noise, value, chunk)
        chunks = self.rows.groupBy("block_id").count().agg(F.max("count"), F.count(F.lit(1))).first() if self.remove_mean else (0, 0)
        self.cut = (chunks[0] or 0) > 1
        if self.cut and chunks[1] > DRIVER_BINS:  # their means come to the driver
            raise TooMany(f"{chunks[1]} blocks are too many for the driver; use table_solver")

    def _layout(self, tod: DataFrame, noise: DataFrame, value: str, chunk: int) -> DataFrame:
        halo, places = self.bandwidth - 1, self.spark.sparkContext.broadcast(self.pixels)
        cells = F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - halo) / chunk)), F.floor((F.col("t") + halo) / chunk))
        cut = tod.select("block_id", F.col("t").cast("long"), "pix", *(F.col(w).cast("double") for w in WEIGHTS), F.col(value).cast("double").alias("d"), F.explode(cells.cast("array<bigint>")).alias("cell"))
        kind = tod.schema["block_id"].dataType.simpleString()

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("t")
            t, cell = table["t"].to_numpy(), table["cell"][0].as_py()
            size = int(t[-1] - t[0]) + 1
            at = _places(places.value, table["pix"].to_numpy())
            low, high = max(0, cell * chunk - int(t[0])), min(size, (cell + 1) * chunk - int(t[0]))
            out = {"block_id": table["block_id"].slice(0, 1), "low": pa.array([low], pa.int64()), "high": pa.array([max(low, high)], pa.int64())}
            for name in ("place", *WEIGHTS, "d"):
                full = np.full(size, -1.0) if name == "place" else np.zeros(size)
                full[t - t[0]] = at if name == "place" else table[name].to_numpy()
                out[name] = pa.array([full.astype(np.int64) if name == "place" else full], pa.list_(pa.int64() if name == "place" else pa.float64()))
            return pa.table(out)

        schema = f"block_id {kind}, low long, high long, place array<bigint>, " + ", ".join(f"{c} array<double>" for c in (*WEIGHTS, "d"))
        packed = cut.groupBy("block_id", "cell").applyInArrow(pack, schema)
        return written(packed.join(noise.select("block_id", F.col("t").alias("row")), "block_id", "left"), "layout")

    def _template_layout(self, tod: DataFrame, noise: DataFrame, value: str, chunk: int) -> DataFrame:
        """Chunks without overlap, of the samples that there are, each with its places on the templates of the whole block. ``first``: the
        block's first bin among the bins of all blocks."""
        how, places, kind = self.templates, self.spark.sparkContext.broadcast(self.pixels), tod.schema["block_id"].dataType.simpleString()
        ends = [F.min("t").cast("long").alias("_t"), F.max("t").cast("long").alias("_tz")]
        for name, kept, as_ in ((("sweep", how.orders, "long")), ("az", how.azimuth_bins, "double")):
            ends += [F.min(name).cast(as_).alias(f"_{name}"), F.max(name).cast(as_).alias(f"_{name}z")] if kept else []
        blocks = written(tod.groupBy("block_id").agg(*ends), "blocks")
        if (count := blocks.count()) > DRIVER_BINS:
            raise TooMany(f"{count} blocks are too many for the driver; use table_solver")
        told = blocks.orderBy("block_id").toArrow()
        zero = np.zeros(told.num_rows, np.int64)
        sweeps = told["_sweepz"].to_numpy() - told["_sweep"].to_numpy() + 1 if how.orders else zero
        plates = (told["_tz"].to_numpy() - told["_t"].to_numpy()) // how.plate_length + 1 if how.harmonics else zero
        bins = np.array([how.bins(*x) for x in zip(sweeps.tolist(), plates.tolist())], np.int64)
        first = np.concatenate([[0], np.cumsum(bins)]).astype(np.int64)
        if first[-1] > DRIVER_BINS:
            raise TooMany(f"{first[-1]} templates are too many for the driver; use table_solver")
        self.first, self.bins = dict(zip(told["block_id"].to_pylist(), first.tolist())), int(first[-1])
        told = pa.table({"block_id": told["block_id"], "first": first[:-1], "bins": bins, "sweeps": sweeps, "plates": plates})
        rows = tod.join(F.broadcast(blocks.join(self.spark.createDataFrame(told), "block_id")), "block_id")  # DRIVER_BINS rows at most
        if how.orders:
            bounds = written(tod.groupBy("block_id", "sweep").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1")), "sweeps")  # small or not, Spark knows
            rows = rows.join(bounds, ["block_id", "sweep"]).withColumn("x", long_templates.sweep_position(F.col("t"), F.col("_t0"), F.col("_t1"))).withColumn("sweep", F.col("sweep") - F.col("_sweep"))
        if how.azimuth_bins:
            rows = rows.withColumn("az", long_templates.azimuth_bin(F.col("az"), F.col("_az"), F.col("_azz"), how.azimuth_bins))
        if how.harmonics:
            rows = rows.withColumn("plate", F.floor((F.col("t") - F.col("_t")) / how.plate_length))
        one, kinds = ("first", "bins", "sweeps", "plates"), {"place": "bigint"} | dict.fromkeys((*WEIGHTS, "d"), "double") | how.kinds()
        cut = rows.select("block_id", "pix", *one, F.col(value).cast("double").alias("d"), *(F.col(c).cast(k) for c, k in kinds.items() if c not in ("place", "d")), F.floor(F.col("t") / chunk).alias("cell"))

        def pack(table: pa.Table) -> pa.Table:
            out = {c: table[c].slice(0, 1) for c in ("block_id", "cell", *one)}
            for name in kinds:
                own = _places(places.value, table["pix"].to_numpy()) if name == "place" else table[name].to_numpy()
                out[name] = as_bytes([own], np.int32 if name in INTEGERS else np.float64)  # at most DRIVER_BINS or DRIVER_PIXELS
            return pa.table(out)

        schema = f"block_id {kind}, cell long, first long, bins long, sweeps long, plates long, " + ", ".join(f"{c} binary" for c in kinds)
        packed = cut.groupBy("block_id", "cell").applyInArrow(pack, schema)
        weight = noise.select("block_id", F.col("t").getItem(0).cast("double").alias("weight"))
        layout = written(packed.join(weight, "block_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))), "layout")

        # a block's weight takes no part: it scales the fit and what the fit meets
        fit = template_fit.factored(layout, partial(_entries, how))
        self.cross = self._crossed(layout)
        every, upper, leaf = fit.doubles()
        if (count := every if self.cross else max(upper, leaf)) > DRIVER_FACTORS:
            raise TooMany(f"{count} numbers of the templates' factors are too many for the driver; use table_solver")
        self.fit = template_fit.DriverFit(fit, self.first, self.bins) if self.cross else template_fit.SharedFit(fit, self.first)
        return layout if self.cross else written(layout.join(fit.leaves(), ["block_id", "cell"]), "layout")

    def _crossed(self, layout: DataFrame) -> tuple[np.ndarray, ...] | None:
        """What pixels and templates share: (place, bin, A^T T as three numbers each), the weight of each bin's block and A^T F A's block of each
        place."""
        how, bins, pairs = self.templates, max(1, self.bins), [(a, b) for a in range(3) for b in range(a, 3)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    (classes, first, _), place = _expanded(how, b, r), _array(b, r, "place")
                    seen = place >= 0
                    w = [_array(b, r, c)[seen] for c in WEIGHTS]
                    for bin_, x in classes:
                        key, at = np.unique(place[seen] * bins + first + bin_[seen], return_inverse=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(at, v * x[seen], len(key))) for v in w)], ["key", "i", "q", "u"])

        def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    place = _array(b, r, "place")
                    at, inverse = np.unique(place[place >= 0], return_inverse=True)
                    weight, w = b["weight"][r].as_py(), [_array(b, r, c)[place >= 0] for c in WEIGHTS]
                    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.bincount(inverse, weight * w[m] * w[n], len(at)).astype(float)) for m, n in pairs)], ["place", *(f"b{m}{n}" for m, n in pairs)])

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    (classes, first, _), place = _expanded(how, b, r), _array(b, r, "place")
                    for bin_, _ in classes:
                        key = (place * bins + first + bin_)[place >= 0]
                        yield pa.RecordBatch.from_arrays([pa.array(key[key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58) == 0])], ["key"])

        with wide_rows(self.spark):  # far too many aren't summed first: their number is told from the 64th part of possible keys
            if layout.mapInArrow(some, "key long").agg(F.countDistinct("key")).first()[0] * 64 > 1.25 * DRIVER_CROSS + 4096:
                return None
            found = written(layout.mapInArrow(run, "key long, i double, q double, u double").groupBy("key").agg(*(F.sum(s).alias(s) for s in "iqu")), "cross")
        if found.count() > DRIVER_CROSS:
            return None
        found = found.toArrow()
        place, bin_ = np.divmod(found["key"].to_numpy(), bins)
        with wide_rows(self.spark):
            sums = layout.mapInArrow(square, "place long, " + ", ".join(f"b{m}{n} double" for m, n in pairs)).groupBy("place").agg(*(F.sum(f"b{m}{n}").alias(f"b{m}{n}") for m, n in pairs)).toArrow()
        block = np.zeros((len(self.pixels), 3, 3))
        for m, n in pairs:
            block[sums["place"].to_numpy(), m, n] = block[sums["place"].to_numpy(), n, m] = sums[f"b{m}{n}"].to_numpy()
        own = layout.select("first", "bins", "weight").distinct().toArrow().sort_by("first")  # a row a block
        weight = np.repeat(own["weight"].to_numpy(), own["bins"].to_numpy())
        return place, bin_, np.stack([found[s].to_numpy() for s in "iqu"], 1), weight, block

    def _cross_product(self, x: np.ndarray) -> np.ndarray:
        """A^T F A x less what the templates that fit F A x take of it, without a job."""
        place, bin_, c, weight, block = self.cross
        out = np.einsum("pab,pbk->pak", block, x.reshape(len(block), 3, -1)).reshape(x.shape)
        for k in range(x.shape[1]):
            sky = x[:, k].reshape(-1, 3)
            tau = self.fit(weight * np.bincount(bin_, (c * sky[place]).sum(1), self.bins))
            for s in range(3):
                out[s::3, k] -= np.bincount(place, c[:, s] * tau[bin_], len(block))
        return out

    def check_fit(self) -> None:
        """Raises ``template_fit.Inexact`` unless what the fit leaves of the data is orthogonal to all templates."""
        left_of, how, whole = self._left(None, 1), self.templates, self.cross is not None
        size = self._send(self.fit.size) if whole else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What shared templates of length 1 meet, and in one row a chunk the most that its own do, and its power."""
            for b in batches:
                for r in range(b.num_rows):
                    (classes, first, bins), v = _expanded(how, b, r), _template_values(b, r, None, 1)
                    (left,) = left_of(b, r, classes, first, v)
                    if whole:
                        met = np.unique(np.concatenate([at for at, _ in classes]))
                        amp, own = (sum(np.bincount(at, w * left, bins) for at, w in classes))[met] * size.value[first + met], 0.0
                    else:
                        leaf = template_fit.Leaf(b, r)
                        amp = leaf.met([(leaf.places(at), w) for at, w in classes], [left])[:, 0]
                        own, met, amp = float(np.abs(amp[~leaf.shared]).max(initial=0.0)), leaf.names[leaf.shared], amp[leaf.shared]
                    zero = np.zeros(len(met))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.append(first + met, -1), np.full(len(met) + 1, first), np.append(amp, 0.0), np.append(zero, own), np.append(zero, v[0] @ v[0]))], ["bin", "first", "amp", "own", "power"])

        with wide_rows(self.spark):
            got = self.rows.drop("place", *WEIGHTS).mapInArrow(run, "bin long, first long, amp double, own double, power double").groupBy("bin", "first").agg(F.sum("amp").alias("amp"), F.max("own").alias("own"), F.sum("power").alias("power")).toArrow()
        first, power = got["first"].to_numpy(), np.zeros(max(1, self.bins))
        np.add.at(power, first, got["power"].to_numpy())
        worst = np.maximum(np.abs(got["amp"].to_numpy()), got["own"].to_numpy()) / np.sqrt(np.where(power > 0, power, 1))[first]
        if not worst.max(initial=0.0) <= template_fit.TOLERANCE:
            raise template_fit.Inexact(f"the fit leaves {worst.max():.1e} of a template in the samples")

    def _fit(self, sent, width: int) -> np.ndarray:
        """Amplitudes of all blocks' templates that fit F v best, a column a product; where chunks fit their own, values of those they share."""
        how, names, whole = self.templates, [f"v{k}" for k in range(width)], self.cross is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    (classes, first, _), v = _expanded(how, b, r), _template_values(b, r, sent, width)
                    if whole:
                        met, amp = zip(*(_sums(at, [w * x for x in v]) for at, w in classes))
                        met, amp = np.concatenate(met), [np.concatenate(x) for x in zip(*amp)]
                    else:
                        leaf = template_fit.Leaf(b, r)
                        amp = leaf.handed_on(leaf.met([(leaf.places(at), w) for at, w in classes], v))[0].T
                        met = leaf.names[leaf.shared]
                    yield pa.RecordBatch.from_arrays([pa.array(first + met), *(pa.array(np.ascontiguousarray(x)) for x in amp)], ["bin", *names])

        with wide_rows(self.spark):
            total = self.rows.drop(*(("place", *WEIGHTS) if sent is None else ("d",))).mapInArrow(run, "bin long, " + ", ".join(f"{n} double" for n in names)).groupBy("bin").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        at = total["bin"].to_numpy() if whole else np.searchsorted(self.fit.known, total["bin"].to_numpy())
        amp = np.zeros((self.bins if whole else len(self.fit.known), width))
        amp[at] = np.stack([total[n].to_numpy() for n in names], 1)
        return self.fit(amp)

    def _left(self, sent, width: int) -> Callable:
        """What the fit leaves of F v, from a chunk's row, classes, first bin and values."""
        tau = self._send(self._fit(sent, width))
        if self.cross is not None:
            return lambda b, r, classes, first, values: [v - sum(w * tau.value[first + at, k] for at, w in classes) for k, v in enumerate(values)]
        known = self._send(self.fit.known)

        def left(b: pa.RecordBatch, r: int, classes: list, first: int, values: list[np.ndarray]) -> list[np.ndarray]:
            leaf = template_fit.Leaf(b, r)
            entries = [(leaf.places(at), w) for at, w in classes]
            parts = leaf.handed_on(leaf.met(entries, values))[1]
            own = leaf.amplitudes(parts, tau.value[np.searchsorted(known.value, first + leaf.names[leaf.shared])])
            return [v - sum(w * own[at, k] for at, w in entries) for k, v in enumerate(values)]

        return left

    def _template_job(self, vectors: np.ndarray | None) -> DataFrame:
        """(place, sums): A^T F (v - T tau) chunk by chunk."""
        sent = self._send(vectors) if vectors is not None else None
        width, how = 1 if vectors is None else vectors.shape[1], self.templates
        names, left_of = [f"{s}{k}" for k in range(width) for s in "iqu"], self._left(sent, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    (classes, first, _), place = _expanded(how, b, r), _array(b, r, "place")
                    seen = place >= 0
                    at, inverse = np.unique(place[seen], return_inverse=True)
                    weights = [_array(b, r, c)[seen] for c in WEIGHTS]
                    out = [np.bincount(inverse, w * left[seen], len(at)).astype(float) for left in left_of(b, r, classes, first, _template_values(b, r, sent, width)) for w in weights]
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *map(pa.array, out)], ["place", *names])

        rows = self.rows if sent is None else self.rows.drop("d")
        return rows.mapInArrow(_by_task(run, names, len(self.pixels)), "place long, " + ", ".join(f"{n} double" for n in names))

    def _job(self, vectors: np.ndarray | None) -> np.ndarray:
        """Sum over chunks of A^T F v, v being the data or A h. Columns of ``vectors``: one product each."""
        if self.templates is not None and self.cross is not None and vectors is not None:
            return self._cross_product(vectors)
        parts, width = (self._template_job if self.templates is not None else self._plain_job)(vectors), 1 if vectors is None else vectors.shape[1]
        result = np.zeros((3 * len(self.pixels), width))
        with wide_rows(self.spark):  # sums come in a row a task, as rows of few numbers would come a few at a time, each with its own buffers
            total = _packed(parts.groupBy("place").agg(*(F.sum(n).alias(n) for n in parts.columns[1:]))).toArrow()
        for b in total.to_batches():
            for r in range(b.num_rows):
                at = from_bytes(b, r, "place", np.int64)
                for k in range(width):
                    for s, c in enumerate("iqu"):
                        result[3 * at + s, k] = from_bytes(b, r, f"{c}{k}", np.float64)
        del total
        pa.default_memory_pool().release_unused()
        while self.sent:
            self.sent.pop().destroy()
        return result

    def _send(self, x: np.ndarray) -> Broadcast:
        """A broadcast that goes when the job in hand is done."""
        self.sent.append(self.spark.sparkContext.broadcast(x))
        return self.sent[-1]

    def _plain_job(self, vectors: np.ndarray | None) -> DataFrame:
        sent = self._send(vectors) if vectors is not None else None
        means = self._means(vectors) if self.cut else None
        width, narrow, remove, how = 1 if vectors is None else vectors.shape[1], self.bandwidth == 1, self.remove_mean, self.how
        names = [f"{s}{k}" for k in range(width) for s in "iqu"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    get = lambda c: b[c][r].values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
                    place, low, high = get("place"), b["low"][r].as_py(), b["high"][r].as_py()
                    w = [get(c) for c in WEIGHTS]
                    row = get("row") if b["row"][r].is_valid else np.ones(1)
                    seen = place[low:high] >= 0
                    at, inverse = np.unique(place[low:high][seen], return_inverse=True)
                    values = [get("d") if sent is None else np.where(place >= 0, sum(w[s] * sent.value[3 * place + s, k] for s in range(3)), 0.0) for k in range(width)]
                    v = np.stack(values)
                    if narrow:
                        v = row[0] * v
                    else:
                        if remove:
                            v = v - (v.mean(1, keepdims=True) if means is None else np.array([[means[b["block_id"][r].as_py(), k]] for k in range(width)]))
                        v = numeric.banded_product(row, v, *how)  # all columns in one batch of transforms
                    out = [np.bincount(inverse, w[s][low:high][seen] * x[low:high][seen], len(at)) for x in v for s in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(x.astype(float)) for x in out)], ["place", *names])

        return self.rows.mapInArrow(_by_task(run, names, len(self.pixels)), "place long, " + ", ".join(f"{n} double" for n in names))

    def _means(self, vectors: np.ndarray | None) -> dict:
        sent = self._send(vectors) if vectors is not None else None
        width = 1 if vectors is None else vectors.shape[1]
        kind = self.rows.schema["block_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    get = lambda c: b[c][r].values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
                    low, high, place = b["low"][r].as_py(), b["high"][r].as_py(), get("place")
                    sums = [float((get("d") if sent is None else np.where(place >= 0, sum(get(c) * sent.value[3 * place + s, k] for s, c in enumerate(WEIGHTS)), 0.0))[low:high].sum()) for k in range(width)]
                    yield pa.RecordBatch.from_arrays([b["block_id"].slice(r, 1).take(pa.array([0] * width)), pa.array(range(width), pa.int64()), pa.array(sums), pa.array([high - low] * width, pa.int64())], ["block_id", "k", "s", "n"])

        with wide_rows(self.spark):
            got = self.rows.mapInArrow(run, f"block_id {kind}, k long, s double, n long").groupBy("block_id", "k").agg((F.sum("s") / F.sum("n")).alias("m")).toArrow()
        return dict(zip(zip(got["block_id"].to_pylist(), got["k"].to_pylist()), got["m"].to_pylist()))

    def right_hand_side(self) -> np.ndarray:
        if self.templates is not None:
            self.check_fit()
        return self._job(None)[:, 0]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self._job(x[:, None])[:, 0] if x.ndim == 1 else self._job(x)

    def frame(self, x: np.ndarray) -> DataFrame:
        table = pa.table({"pix": self.pixels, **{s: x[k::3] for k, s in enumerate("iqu")}})
        return self.spark.createDataFrame(table)


class BlockJacobi:
    """Inverse 3x3 blocks by pixel, as numpy: (pixels, 3, 3)."""

    def __init__(self, inverse: DataFrame, pixels: np.ndarray):
        table = inverse.toArrow()
        self.m = np.zeros((len(pixels), 3, 3))
        at = np.searchsorted(pixels, table["pix"].to_numpy())
        for (a, b), name in zip(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), ("m_ii", "m_iq", "m_iu", "m_qq", "m_qu", "m_uu")):
            self.m[at, a, b] = self.m[at, b, a] = table[name].to_numpy()

    def __call__(self, g: np.ndarray) -> np.ndarray:
        return np.einsum("pab,pb...->pa...", self.m, g.reshape(len(self.m), 3, *g.shape[1:])).reshape(g.shape)


class TwoLevel:
    """M(g - AZ E^+ Z^T g) + Z E^+ Z^T g over a deflation basis Z."""

    def __init__(self, operator: NormalOperator, first: BlockJacobi, z: np.ndarray):
        self.first, self.z, self.az = first, z, operator.apply(z)
        self.e = np.linalg.pinv(z.T @ self.az, rcond=1e-15)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        c = self.e @ (self.z.T @ g)
        return self.first(g - self.az @ c) + self.z @ c


def a_priori_basis(tod: DataFrame, operator: NormalOperator, groups: int) -> np.ndarray:
    """Shares of a pixel's samples by group of time, in the slot of I. Groups are equal stretches of ``row``."""
    low, high = tod.agg(F.min("row"), F.max("row")).first()
    at = F.least(F.floor((F.col("row") - low) * groups / (high - low + 1)), F.lit(groups - 1)).cast("int")
    shares = pixel_blocks.hit_shares(tod, at).toArrow()
    z = np.zeros((3 * len(operator.pixels), groups))
    z[3 * np.searchsorted(operator.pixels, shares["pix"].to_numpy()), shares["grp"].to_numpy()] = shares["z"].to_numpy()
    return z[:, z.any(0)]


def lanczos_basis(operator: NormalOperator, steps: int, seed: int = 1, start: np.ndarray | None = None) -> np.ndarray:
    """Ritz vectors of the operator after so many Lanczos steps, from ``start`` or a random vector."""
    n = 3 * len(operator.pixels)
    v = np.random.default_rng(seed).normal(size=n) if start is None else start
    basis, alpha, beta = [v / np.linalg.norm(v)], [], []
    for k in range(min(steps, n)):
        w = operator.apply(basis[-1])
        alpha.append(float(basis[-1] @ w))
        for u in basis:
            w = w - (u @ w) * u
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] < 1e-12 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    k = len(alpha)
    _, ritz = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
    return np.stack(basis[:k], 1) @ ritz


@dataclass
class Solution:
    x: np.ndarray
    residuals: list[float] = field(default_factory=list)
    converged: bool = False


def pcg(operator: NormalOperator, precondition, tol: float = 1e-6, most: int = 3000, rhs: np.ndarray | None = None) -> Solution:
    """Polak-Ribiere preconditioned CG from 0: at most ``most`` - 1 iterations; residuals are relative, from 1."""
    g = operator.right_hand_side() if rhs is None else rhs
    x, start = np.zeros_like(g), float(g @ g)
    out = Solution(x, [1.0], start == 0)
    if start == 0:
        return out
    mg = precondition(g)
    h = mg
    for _ in range(1, most):
        ah = operator.apply(h)
        rho = float(g @ mg) / float(h @ ah)
        out.x = x = x + rho * h
        new = g - rho * ah
        out.residuals.append(float(np.sqrt(new @ new / start)))
        if new @ new <= tol**2 * start:
            out.converged = True
            break
        m_new = precondition(new)
        gamma = float(m_new @ (new - g)) / float(g @ mg)
        g, mg = new, m_new
        h = mg + gamma * h
    return out


def _stripes(n: int) -> Iterator[slice]:
    return (slice(k, k + STRIPE) for k in range(0, n, STRIPE))


def _turned(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """a m, in the place of ``a`` where the width stays."""
    out = a if m.shape[0] == m.shape[1] else np.empty((len(a), m.shape[1]))
    for s in _stripes(len(a)):
        out[s] = a[s] @ m
    return out


def _take(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> None:
    """a - b m, in the place of ``a``."""
    for s in _stripes(len(a)):
        a[s] -= b[s] @ m


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a``, which a step may overwrite without a change of ``b``."""
    return a.copy() if np.may_share_memory(a, b) else a


def enlarged_cg(operator: NormalOperator, precondition, directions: int, tol: float = 1e-6, most: int = 3000, reduce: bool = False, orthodir: bool = False) -> Solution:
    """Block CG that splits the residual into ``directions`` parts by pixel; one job an iteration, whatever the number.
    ``reduce``: when directions have become dependent, the residual's parts go over to an orthonormal basis of what they span (orthomin), or
    the dependent ones are dropped (orthodir), for good. ``orthodir``: the next directions come
    from the operator's images, orthogonal to the last two sets; else (orthomin) from the residuals. A product leaves room for residuals,
    directions and images alone (with orthodir two sets more): block vectors are turned where they lie, and old ones go before the next product."""
    r0 = operator.right_hand_side()
    start = float(r0 @ r0)
    n = len(r0)
    if start == 0:
        return Solution(np.zeros(n), [1.0], True)
    part = (np.arange(n) // 3) * directions // max(1, n // 3)
    r = np.where(part[:, None] == np.arange(directions), r0[:, None], 0.0)
    x, residuals, converged = np.zeros(n), [1.0], False
    whole = np.ones(directions)  # r @ whole is the residual
    del r0, part
    p, past = _apart(precondition(r), r), []
    for _ in range(1, most):
        ap = operator.apply(p)
        gram = p.T @ ap
        val, vec = np.linalg.eigh((gram + gram.T) / 2)
        keep = val > max(val.max(), 0) * 1e-12
        if not keep.any():
            break
        scale = vec[:, keep] / np.sqrt(val[keep])
        p, ap = _turned(p, scale), _turned(ap, scale)
        alpha = p.T @ r
        x += p @ (alpha @ whole)
        _take(r, ap, alpha)
        total = r @ whole
        residuals.append(float(np.sqrt(total @ total / start)))
        if total @ total <= tol**2 * start:
            converged = True
            break
        past = [*past[-1:], (p, ap)]
        if reduce and not orthodir and not keep.all():
            size, turn = np.linalg.eigh(r.T @ r)
            turn = turn[:, size > size.max() * 1e-24]
            r, whole = _turned(r, turn), turn.T @ whole
        of = ap if orthodir else r
        z = _apart(precondition(of), of)
        for old, image in past if orthodir else past[-1:]:
            _take(z, old, image.T @ z)
        past = past[-1:] if orthodir else []
        del of, ap, old, image
        p = z[:, : max(1, int(keep.sum()))] if reduce and orthodir and not keep.all() else z
    return Solution(x, residuals, converged)
