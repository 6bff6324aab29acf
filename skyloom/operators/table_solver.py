"""The same system with map vectors as tables, written each time: for maps beyond the driver.

A block vector of width k is a table (pix, i0, q0, u0, i1, ...): k map vectors side by side.  A product with the system goes once over the
samples, whatever the width; they are stored by pixel for the projection and by (block, t) for the sums, so of an iteration's rows only products are
shuffled, and none where noise is diagonal and there are no templates; inner products of all pairs of columns are one aggregation, and a linear combination of block vectors is one
join by pixel.  The driver sees matrices of a few directions alone.  Tables of an iteration are deleted once nothing reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyloom.operators import index_sets, pixel_blocks, pointing, template_fit, templates as long_templates, toeplitz
from skyloom.operators.solver import Templates
from skyloom.sources.staging import bucketed, discard_table, written

STOKES = pointing.STOKES


def names(width: int) -> list[str]:
    return [f"{s}{k}" for k in range(width) for s in STOKES]


def width_of(v: DataFrame) -> int:
    return (len(v.columns) - 1) // 3


def _beside(*vectors: DataFrame) -> DataFrame:
    """Several block vectors by pixel, columns numbered through; pixels of the first."""
    out, at = vectors[0].toDF("pix", *names(width_of(vectors[0]))), width_of(vectors[0])
    for v in vectors[1:]:
        own = width_of(v)
        out = out.join(v.toDF("pix", *(f"{s}{at + k}" for k in range(own) for s in STOKES)), "pix", "left")
        at += own
    return out


def _columns(b: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, 3, width) of a batch of ``names``."""
    flat = np.stack([np.nan_to_num(b[c].to_numpy(zero_copy_only=False)) if b[c].null_count else b[c].to_numpy(zero_copy_only=False) for c in names(width)], 1)
    return flat.reshape(b.num_rows, width, 3).swapaxes(1, 2)


def gram(a: DataFrame, b: DataFrame | None = None) -> np.ndarray:
    """a^T b, or a^T a: sums by task, then over tasks."""
    first, both = width_of(a), a.toDF("pix", *names(width_of(a))) if b is None else _beside(a, b)
    total, same = width_of(both), b is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((first, first if same else total - first))
        for batch in batches:
            m = _columns(batch, total).reshape(-1, total)
            out += m[:, :first].T @ (m if same else m[:, first:])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["at", "s"])

    got = both.select(*names(total)).mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()  # pairs of directions
    out = np.zeros(first * (first if same else total - first))
    out[got["at"].to_numpy()] = got["s"].to_numpy()
    return out.reshape(first, -1)


def combined(*terms: tuple[DataFrame, np.ndarray]) -> DataFrame:
    """The sum of block vectors times matrices, as a written table with the pixels of the first."""
    both, matrix = _beside(*(v for v, _ in terms)), np.concatenate([m for _, m in terms])
    total, width = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _columns(batch, total) @ matrix
            yield pa.RecordBatch.from_arrays([batch["pix"], *(pa.array(np.ascontiguousarray(out[:, s, k])) for k in range(width) for s in range(3))], ["pix", *names(width)])

    return written(both.mapInArrow(run, "pix long, " + ", ".join(f"{c} double" for c in names(width))), "vector")


def gone(*tables: DataFrame) -> None:
    for t in {id(t): t for t in tables}.values():
        discard_table(t)


def map_of(v: DataFrame) -> DataFrame:
    """(pix, i, q, u) of a block vector's first."""
    return v.select("pix", *(F.col(f"{s}0").alias(s) for s in STOKES))


def vector_of(sky: DataFrame) -> DataFrame:
    return sky.select(F.col("pix").cast("long").alias("pix"), *(F.col(s).cast("double").alias(f"{s}0") for s in STOKES))


class TableOperator:
    """``tod``: block_id, t, pix, w_i, w_q, w_u, value and, with templates, what they need. ``noise``: block_id, t (first row)."""

    def __init__(self, tod: DataFrame, noise: DataFrame, bandwidth: int, value: str = "value", templates: Templates | None = None, remove_mean: bool = True, method: str = "auto", fft_size: int | str | None = None):
        if templates is not None and bandwidth != 1:
            raise ValueError("templates need a bandwidth of 1")
        self.tod, self.noise, self.bandwidth, self.value, self.remove_mean, self.table = tod, noise, bandwidth, value, remove_mean, None
        own = tod.select("block_id", F.col("t").cast("long").alias("t"), F.col("pix").cast("long").alias("pix"), *(F.col(w).cast("double").alias(w) for w in pointing.WEIGHTS))
        seen = own.filter("pix >= 0")
        self.flagged = written(own.filter("pix < 0 OR pix IS NULL").select("block_id", "t"), "flagged")
        self.diagonal = bandwidth == 1 and templates is None
        if self.diagonal:  # the weight is a number of the sample
            first = noise.select("block_id", F.col("t").getItem(0).cast("double").alias("_w"))
            seen = seen.join(first, "block_id", "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
        self.by_pixel = bucketed(seen, ["pix"], "by_pixel")
        self.by_sample = None if self.diagonal else bucketed(seen, ["block_id", "t"], "by_sample")
        self.how = {"method": method, "fft_size": fft_size}
        if templates is not None:
            table = long_templates.expanded(tod, templates.orders, templates.azimuth_bins, templates.harmonics, templates.plate_length)
            self.table = written(table, "templates")
            self.fit = template_fit.factored(template_fit.packed(self.table), template_fit.packed_entries)
            self.checked = False

    def _product(self, frame: DataFrame, columns: list[str]) -> DataFrame:
        """A^T F v for several columns v of the samples."""
        v, y, fit_ = ([f"_{c}{k}" for k in range(len(columns))] for c in "vyf")
        rows = frame.select("block_id", "t", *(F.col(c).cast("double").alias(n) for c, n in zip(columns, v)))
        out = toeplitz.weighted(rows, self.noise, v, self.bandwidth, y, self.remove_mean, **self.how).select("block_id", F.col("t"), *y)
        if self.table is not None:  # a block's weight scales the fit and what the fit meets alike
            before = out
            fit = long_templates.project(self.table, template_fit.fitted(self.fit, long_templates.scatter(self.table, out, y)), fit_)
            out = out.join(fit, ["block_id", "t"], "left").select("block_id", "t", *((F.col(a) - F.coalesce(b, F.lit(0.0))).alias(a) for a, b in zip(y, fit_)))
            if not self.checked:
                self._check(before, out, y[0])
        return self._scattered(self.by_sample.join(out, ["block_id", "t"]), y)

    @staticmethod
    def _scattered(rows: DataFrame, y: list[str]) -> DataFrame:
        sums = [F.sum(F.col(w) * F.col(c)).alias(f"{s}{k}") for k, c in enumerate(y) for s, w in zip(STOKES, pointing.WEIGHTS)]
        return rows.groupBy("pix").agg(*sums)

    def _check(self, before: DataFrame, left: DataFrame, y: str) -> None:
        lengths = before.groupBy("block_id").agg(F.sqrt(F.sum(F.col(y) * F.col(y))).alias("length"))
        template_fit.checked(self.fit, long_templates.scatter(self.table, left, y), lengths)
        self.checked = True

    def right_hand_side(self) -> DataFrame:
        if self.diagonal:
            first = self.noise.select("block_id", F.col("t").getItem(0).cast("double").alias("_w"))
            rows = self.tod.filter("pix >= 0").withColumn("pix", F.col("pix").cast("long")).join(first, "block_id", "left")
            return written(self._scattered(rows.withColumn("_y0", F.col(self.value) * F.coalesce("_w", F.lit(1.0))), ["_y0"]), "vector")
        return written(self._product(self.tod, [self.value]), "vector")

    def projected(self, sky: DataFrame, p: list[str]) -> DataFrame:
        """The stored samples with A x of each column of a block vector: only the vector is shuffled."""
        maps = sky.toDF("pix", *(f"_sky_{c}" for c in names(width_of(sky))))
        total = lambda k: sum((F.col(w) * F.col(f"_sky_{s}{k}") for w, s in zip(pointing.WEIGHTS, STOKES)), F.lit(0.0))
        return self.by_pixel.join(maps, "pix").select(*self.by_pixel.columns, *(total(k).alias(c) for k, c in enumerate(p)))

    def product(self, sky: DataFrame) -> DataFrame:
        """The plan of ``apply``."""
        p = [f"_p{k}" for k in range(width_of(sky))]
        rows = self.projected(sky, p)
        if self.diagonal:
            return self._scattered(rows.withColumns({c: F.col(c) * F.col("_w") for c in p}), p)
        rows = rows.select("block_id", "t", *p).unionByName(self.flagged.select("block_id", "t", *(F.lit(0.0).alias(c) for c in p)))
        return self._product(rows, p)

    def apply(self, sky: DataFrame) -> DataFrame:
        """All columns of a block vector in one pass."""
        return written(self.product(sky), "vector")


class TableJacobi:
    def __init__(self, inverse: DataFrame):
        self.inverse = inverse

    def __call__(self, g: DataFrame) -> DataFrame:
        m = {a + b: F.col("m_" + "".join(sorted((a, b), key="iqu".index))) for a in STOKES for b in STOKES}
        return written(g.join(self.inverse, "pix").select("pix", *(sum((m[a + b] * F.col(f"{b}{k}") for b in STOKES), F.lit(0.0)).alias(f"{a}{k}") for k in range(width_of(g)) for a in STOKES)), "vector")


class TableTwoLevel:
    """M(g - AZ E^+ Z^T g) + Z E^+ Z^T g over a block vector Z; one product in all to begin with."""

    def __init__(self, operator: TableOperator, first: TableJacobi, z: DataFrame):
        self.first, self.z, self.az = first, z, operator.apply(z)
        self.e = np.linalg.pinv(gram(z, self.az), rcond=1e-15)

    def __call__(self, g: DataFrame) -> DataFrame:
        c = self.e @ gram(g, self.z).T
        smooth = combined((g, np.eye(width_of(g))), (self.az, -c))
        fine = self.first(smooth)
        out = combined((fine, np.eye(width_of(g))), (self.z, c))
        gone(smooth, fine)
        return out


def a_priori_basis(operator: TableOperator, groups: int) -> DataFrame:
    """Shares of a pixel's samples by group of time, in the slot of I, as a block vector. Groups are equal stretches of ``row``."""
    low, high = operator.tod.agg(F.min("row"), F.max("row")).first()
    at = F.least(F.floor((F.col("row") - low) * groups / (high - low + 1)), F.lit(groups - 1)).cast("int")
    share = lambda k: F.sum(F.when(F.col("grp") == k, F.col("z")).otherwise(F.lit(0.0)))
    z = written(pixel_blocks.hit_shares(operator.tod, at).groupBy("pix").agg(*(share(k).alias(f"z{k}") for k in range(groups))), "shares")
    met = z.agg(*(F.max(f"z{k}").alias(f"z{k}") for k in range(groups))).first()
    kept = [k for k in range(groups) if met[k]]
    return written(z.select("pix", *(x for n, k in enumerate(kept) for x in (F.col(f"z{k}").alias(f"i{n}"), F.lit(0.0).alias(f"q{n}"), F.lit(0.0).alias(f"u{n}")))), "basis")


def random_vector(operator: TableOperator, seed: int = 1) -> DataFrame:
    """Numbers between -1 and 1 that follow from pixel, component and seed, wherever a row lies."""
    value = lambda s: (F.pmod(F.xxhash64("pix", F.lit(s), F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1).alias(f"{s}0")
    return written(operator.tod.filter("pix >= 0").select("pix").distinct().select("pix", *map(value, STOKES)), "vector")


def lanczos_basis(operator: TableOperator, steps: int, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Ritz vectors of the operator after so many Lanczos steps, as a block vector, and their values. What a step's image has of all
    earlier vectors is one aggregation, taken twice for the sake of rounding."""
    v = random_vector(operator, seed)
    basis = combined((v, np.array([[1 / np.sqrt(gram(v)[0, 0])]])))
    gone(v)
    last, alpha, beta = basis, [], []
    for k in range(steps):
        image = operator.apply(last)
        for again in range(2):
            c = gram(basis, image)
            if not again:
                alpha.append(float(c[-1, 0]))
            old, image = image, combined((image, np.eye(1)), (basis, -c))
            gone(old)
        beta.append(float(np.sqrt(gram(image)[0, 0])))
        if k == steps - 1 or beta[-1] < 1e-12 * abs(alpha[0]):
            gone(image)
            break
        end = np.zeros((1, k + 2))
        end[0, -1] = 1 / beta[-1]
        old, basis = basis, combined((basis, np.eye(k + 1, k + 2)), (image, end))
        if last is not old:
            gone(last)
        last = combined((image, end[:, -1:]))
        gone(old, image)
    value, ritz = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    out = combined((basis, ritz))
    gone(basis, last)
    return out, value


def pcg(operator: TableOperator, precondition, tol: float = 1e-6, most: int = 3000) -> tuple[DataFrame, list[float]]:
    """The iteration of ``solver.pcg``: the map and its relative residuals, from 1."""
    one = np.eye(1)
    g = operator.right_hand_side()
    start = gram(g)[0, 0]
    x = combined((g, 0 * one))
    residuals = [1.0]
    if not start:
        return map_of(x), residuals
    mg = h = precondition(g)
    gmg = gram(g, mg)[0, 0]
    for _ in range(1, most):
        ah = operator.apply(h)
        rho = gmg / gram(h, ah)[0, 0]
        old, x = x, combined((x, one), (h, rho * one))
        new = combined((g, one), (ah, -rho * one))
        gone(old, ah)
        left = gram(new)[0, 0]
        residuals.append(float((left / start) ** 0.5))
        if left <= tol**2 * start:
            break
        m_new = precondition(new)
        now, past = gram(m_new, _beside(new, g))[0]
        spent = [g, h] + ([mg] if mg is not h else [])
        h = combined((m_new, one), (h, (now - past) / gmg * one))
        g, mg, gmg = new, m_new, now
        gone(*spent)
    return map_of(x), residuals


def enlarged_cg(operator: TableOperator, precondition, directions: int, tol: float = 1e-6, most: int = 3000, reduce: bool = False, orthodir: bool = False) -> tuple[DataFrame, list[float]]:
    """The iteration of ``solver.enlarged_cg``: parts of the residual are equal stretches of the pixels in order."""
    r0 = operator.right_hand_side()
    start = gram(r0)[0, 0]
    x, residuals = combined((r0, np.zeros((1, 1)))), [1.0]
    if not start:
        return map_of(x), residuals
    at = index_sets.numbered(r0.select("pix"), ["pix"], "position")
    size = at.count()
    part = F.floor(F.col("position") * directions / max(1, size))
    r = written(r0.join(at, "pix").select("pix", *(F.when(part == k, F.col(f"{s}0")).otherwise(F.lit(0.0)).alias(f"{s}{k}") for k in range(directions) for s in STOKES)), "vector")
    gone(r0)
    whole = np.ones((directions, 1))  # r @ whole is the residual
    p = precondition(r)
    past: list[tuple[DataFrame, DataFrame, np.ndarray]] = []
    for _ in range(1, most):
        ap = operator.apply(p)
        square = gram(p, ap)
        val, vec = np.linalg.eigh((square + square.T) / 2)
        keep = val > max(val.max(), 0) * 1e-12
        if not keep.any():
            break
        scale = vec[:, keep] / np.sqrt(val[keep])  # p @ scale are the directions
        alpha = scale.T @ gram(p, r)
        before = x, r
        x, r = combined((x, np.eye(1)), (p, scale @ alpha @ whole)), combined((r, np.eye(width_of(r))), (ap, -scale @ alpha))
        gone(*before)
        inner = gram(r)
        left = (whole.T @ inner @ whole)[0, 0]
        residuals.append(float(np.sqrt(max(left, 0.0) / start)))
        if left <= tol**2 * start:
            break
        for old in past[:-1]:
            gone(*old[:2])
        past = [*past[-1:], (p, ap, scale)]
        if reduce and not orthodir and not keep.all():
            length, turn = np.linalg.eigh(inner)
            turn = turn[:, length > length.max() * 1e-24]
            old_r, r, whole = r, combined((r, turn)), turn.T @ whole
            gone(old_r)
        z = precondition(ap if orthodir else r)
        turn = scale if orthodir else np.eye(width_of(r))
        for old, image, of in past if orthodir else past[-1:]:
            c = of @ of.T @ gram(image, z) @ turn
            before_z, z = z, combined((z, turn), (old, -c))
            gone(before_z)
            turn = np.eye(turn.shape[1])
        kept = max(1, int(keep.sum()))
        p = combined((z, np.eye(width_of(z), kept))) if reduce and orthodir and not keep.all() and kept < width_of(z) else z
    return map_of(x), residuals
