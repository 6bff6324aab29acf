"""From samples to maps: flags, noise weights, pixel blocks and their cut, solve, products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.operators import flags, noise as noise_ops, pixel_blocks, pointing, solver, table_solver, toeplitz
from skyloom.plans.config import Config
from skyloom.sources import sinks
from skyloom.sources.staging import written

TOD = ("obs_id", "det", "block_id", "t", "row", "pix", "w_i", "w_q", "w_u", "signal", "noise")


@dataclass
class Maps:
    sky: DataFrame  # pix, i, q, u, hits, rcond: observed pixels that were kept
    residuals: list[float]
    noise: DataFrame
    removed: DataFrame

    def full_sky(self, nside: int) -> DataFrame:
        return pixel_blocks.full_sky(self.sky, 12 * nside * nside, ["i", "q", "u", "rcond", "hits"])


def check(tod: DataFrame, config: Config) -> None:
    if missing := [c for c in TOD if c not in tod.columns]:
        raise ValueError(f"samples lack {', '.join(missing)}")
    if tod.isEmpty():
        raise ValueError("there are no samples")
    keys = ("obs_id", "block_id", "t", "pix")
    told = tod.agg(F.max("pix"), *(F.count(F.when(F.col(k).isNull(), 1)) for k in keys)).first()
    if any(told[1:]):
        raise ValueError(f"samples without {', '.join(k for k, n in zip(keys, told[1:]) if n)}")
    if told[0] >= 12 * config.nside**2:
        raise ValueError("a pixel lies outside the sphere")


def check_noise(noise: DataFrame, tod: DataFrame) -> None:
    """Each block of the samples has one row of weights, and it isn't empty."""
    rows = noise.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.size("t"), F.lit(0))).alias("least"))
    odd = tod.select("block_id").distinct().join(rows, "block_id", "left").filter("n IS NULL OR n > 1 OR least < 1").limit(5).collect()
    if odd:
        raise ValueError("blocks without exactly one row of noise weights: " + ", ".join(str(r.block_id) for r in odd))


def prepare(tod: DataFrame, config: Config) -> DataFrame:
    """Detector limit, flags, scaling; ``value`` is signal plus noise."""
    if config.limit_det:
        tod = flags.detectors(tod, config.limit_det)
    if "flags" in tod.columns:
        own = F.col("det_flags") if "det_flags" in tod.columns else None
        tod = flags.masked(tod, flags.flagged(F.col("flags"), config.shared_mask, own, config.det_mask))
    tod = flags.scaled(tod, config.signal_fraction, config.downscale)
    return tod.withColumn("noise", F.lit(0.0)) if config.noiseless else tod


def with_scan(tod: DataFrame, scan: DataFrame, config: Config) -> DataFrame:
    """Sweep, azimuth and plate angle of every sample."""
    scan = flags.scan_sweeps(scan) if config.sweeps_from_flags else flags.fixed_sweeps(scan, config.poly_baseline, config.fsample)
    return tod.join(scan.select("obs_id", "t", "sweep", "az", "hwp_angle"), ["obs_id", "t"])


#: What a pointing gives a sample: its pixel and Stokes weights, as expressions over the samples' columns.
Pointing = Callable[[DataFrame], dict[str, Column]]


def make_maps(config: Config, tod: DataFrame, noise: DataFrame | None = None, scan: DataFrame | None = None, pointing_of: Pointing | None = None) -> Maps:
    """``noise``: block_id and first row t; estimated from the noise column where absent.  ``pointing_of``: columns pix, w_i, w_q, w_u from
    the samples (detector angles, say) where these don't hold them already."""
    config = config.checked()
    if pointing_of is not None:
        tod = tod.withColumns(pointing_of(tod))
    check(tod, config)
    tod = written(prepare(tod, config), "samples")
    if config.noiseless or config.uniform_w:
        noise = noise_ops.uniform(tod)
    elif noise is None:
        noise = noise_ops.inverse_noise(tod, "noise", config.fsample, config.bandwidth, config.apodise)
    noise = written(noise.select("block_id", "t"), "noise")
    check_noise(noise, tod)
    if config.bandwidth > 1:
        toeplitz.checked_bandwidth(noise, tod.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")))
    weight = tod.join(noise.select("block_id", F.col("t").getItem(0).alias("_w")), "block_id", "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    blocks = written(pointing.weight_blocks(weight, F.col("_w")), "blocks")
    removed = pixel_blocks.degenerate(blocks, config.rcond_cut)
    tod = pixel_blocks.without_degenerate(tod, removed).withColumn("value", F.col("signal") + F.col("noise"))
    if config.map_maker == "MT":
        if scan is None:
            raise ValueError("templates need the scan")
        tod = with_scan(tod, scan, config)
    tod = written(tod, "samples")
    inverse = pixel_blocks.inverse(blocks, config.rcond_cut)
    found_templates = config.templates() if config.map_maker == "MT" else None
    try:
        found, residuals = _on_driver(config, tod, noise, inverse, found_templates)
    except solver.TooMany:
        found, residuals = _on_tables(config, tod, noise, inverse, found_templates)
    sky = found.join(pixel_blocks.kept(blocks, config.rcond_cut).select("pix", "hits", "rcond"), "pix")
    return Maps(sky, residuals, noise, removed)


def _on_driver(config: Config, tod: DataFrame, noise: DataFrame, inverse: DataFrame, templates: solver.Templates | None) -> tuple[DataFrame, list[float]]:
    operator = solver.NormalOperator(tod, noise, config.bandwidth, templates=templates, remove_mean=config.remove_mean, **config.products())
    precondition = solver.BlockJacobi(inverse, operator.pixels)
    if config.precond:
        basis = solver.a_priori_basis(tod, operator, config.z_2lvl or 8) if config.precond == 1 else solver.lanczos_basis(operator, config.z_2lvl or 8)
        precondition = solver.TwoLevel(operator, precondition, basis)
    if config.solver:
        found = solver.enlarged_cg(operator, precondition, config.enlarge, config.tol, config.maxiter, config.block_reduction, config.ortho_alg == 0)
    else:
        found = solver.pcg(operator, precondition, config.tol, config.maxiter)
    return operator.frame(found.x), found.residuals


def _on_tables(config: Config, tod: DataFrame, noise: DataFrame, inverse: DataFrame, templates: solver.Templates | None) -> tuple[DataFrame, list[float]]:
    """The same beyond what the driver holds of pixels or templates: map vectors are tables."""
    operator = table_solver.TableOperator(tod, noise, config.bandwidth, templates=templates, remove_mean=config.remove_mean, **config.products())
    precondition = table_solver.TableJacobi(written(inverse, "inverse"))
    if config.precond:
        groups = config.z_2lvl or 8
        basis = table_solver.a_priori_basis(operator, groups) if config.precond == 1 else table_solver.lanczos_basis(operator, groups)[0]
        precondition = table_solver.TableTwoLevel(operator, precondition, basis)
    if config.solver:
        return table_solver.enlarged_cg(operator, precondition, config.enlarge, config.tol, config.maxiter, config.block_reduction, config.ortho_alg == 0)
    return table_solver.pcg(operator, precondition, config.tol, config.maxiter)


def run(config: Config, tod: DataFrame, noise: DataFrame | None = None, scan: DataFrame | None = None) -> Maps:
    """``make_maps`` and its files."""
    maps = make_maps(config, tod, noise, scan)
    sinks.write_products(maps, config.checked())
    return maps


