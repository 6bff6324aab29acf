"""Fits of templates by orthogonal elimination: nearly and wholly dependent templates, many templates, blocks over many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import orthogonal
from skyloom.operators import solver, template_fit, templates
from skyloom.sources.staging import written


def entries(n, how, angle, sweep=101):
    t = np.arange(n)
    classes, bins = how.expand({"t": t, "sweep": t // sweep, "az": np.sin(t / 40.0), "hwp_angle": t / angle})
    return np.tile(t, len(classes)), np.concatenate([b for b, _ in classes]), np.concatenate([w for _, w in classes]), bins


def fit_of(row, column, w, bins, d, pieces=orthogonal.piecewise):
    """(T tau, largest part of a template of length 1 in what is left, over the length of d)."""
    norm = np.sqrt(np.bincount(column, w * w, bins))
    unit = w / np.where(norm > 0, norm, 1)[column]
    factors, front = pieces(row, column, unit, np.arange(bins), np.ones(bins, bool))
    assert front.m.size == 0
    x = np.zeros(bins)
    orthogonal.backward(factors, orthogonal.forward(factors, np.bincount(column, unit * d[row], bins)), x)
    fit = np.bincount(row, unit * x[column], len(d))
    return fit, np.abs(np.bincount(column, unit * (d - fit)[row], bins)).max() / np.linalg.norm(d)


def dense_fit(row, column, w, bins, d):
    m = np.zeros((len(d), bins))
    np.add.at(m, (row, column), w)
    norm = np.linalg.norm(m, axis=0)
    m /= np.where(norm > 0, norm, 1)
    return m @ np.linalg.lstsq(m, d, rcond=1e-10)[0]


SLOW = [
    (20_000, solver.Templates(4, 0, 2, 130), 500), (20_000, solver.Templates(4, 0, 2, 130), 200), (20_000, solver.Templates(4, 100, 2, 100), 500), (6_000, solver.Templates(4, 0, 2, 130), 500),
    (6_000, solver.Templates(4, 0, 2, 130), 200), (6_000, solver.Templates(4, 100, 2, 100), 500), (20_000, solver.Templates(4, 0, 2, 130), 7), (20_000, solver.Templates(4, 0, 2, 130), 100),
]


@pytest.mark.parametrize("n,how,angle", SLOW)
def test_nearly_dependent_templates(n, how, angle):
    table = entries(n, how, angle)
    for d in (np.random.default_rng(1).normal(size=n), 1000 * np.sin(np.arange(n) / 3000) + np.random.default_rng(2).normal(size=n)):
        fit, left = fit_of(*table, d)
        assert left < 1e-6
        if n <= 6000:
            assert np.linalg.norm(fit - dense_fit(*table, d)) <= 1e-6 * np.linalg.norm(d)


@pytest.mark.parametrize("seed", range(12))
def test_dependent_templates(seed):
    """Random sparse templates; some are sums of others, wholly or but for a ten-thousandth, some are 0."""
    rng = np.random.default_rng(seed)
    n, k = 900, 40
    m = np.where(rng.random((n, k)) < 0.05, rng.normal(size=(n, k)), 0.0)
    m[: n // 3, ::3] = 0
    more = m @ np.where(rng.random((k, 12)) < 0.1, rng.normal(size=(k, 12)), 0.0)
    more += (seed % 2) * 1e-4 * np.where(more != 0, rng.normal(size=more.shape), 0.0)
    m = np.concatenate([m, more, m[:, :2], np.zeros((n, 1))], 1)
    row, column = np.nonzero(m)
    d = rng.normal(size=n)
    fit, left = fit_of(row, column, m[row, column], m.shape[1], d)
    assert left < 1e-6 and np.linalg.norm(fit - dense_fit(row, column, m[row, column], m.shape[1], d)) <= 1e-6 * np.linalg.norm(d)


def test_pieces_of_any_size_fit_alike(monkeypatch):
    table, d = entries(3000, solver.Templates(3, 20, 1, 170), 200), np.random.default_rng(4).normal(size=3000)
    want = fit_of(*table, d)[0]
    for size in (1, 60, 5000):
        monkeypatch.setattr(orthogonal, "PIECE", size)
        assert np.allclose(fit_of(*table, d)[0], want, atol=1e-8)


def test_many_templates_take_no_square_of_memory():
    """60,000 templates: all their pairs would take 29 GB."""
    t = np.arange(240_000)
    row, column, w = np.tile(t, 2), np.concatenate([t // 4, 60_000 + t % 6]), np.concatenate([np.ones(len(t)), 1.0 + t % 2])
    assert fit_of(row, column, w, 60_006, np.sin(t) * 1000)[1] < 1e-10


@pytest.fixture(scope="module")
def samples(spark):
    """Three blocks of different lengths, samples missing here and there."""
    rows = spark.createDataFrame([(b, n) for b, n in ((0, 2500), (1, 130), (2, 4000))], "block_id int, n long")
    rows = rows.select("block_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t")).filter("t % 37 <> 5")
    return rows.withColumn("sweep", F.floor(F.col("t") / 101).cast("int")).withColumn("az", F.sin(F.col("t") / 40.0)).withColumn("hwp_angle", F.col("t") / 200.0).withColumn("d", F.sin(F.col("t") * F.col("t") / 1000.0) * 100 + F.col("t") / 7.0).cache()


@pytest.mark.parametrize("chunk,fan", [(1 << 16, 16), (500, 16), (100, 3)])
def test_blocks_over_many_tasks(spark, samples, monkeypatch, chunk, fan):
    """However a block is cut, the fit is the dense one; no task sees more than its chunk or the fronts of a few."""
    monkeypatch.setattr(template_fit, "FAN", fan)
    table = templates.expanded(samples, 3, 6, 1, 130)
    fit = template_fit.factored(template_fit.packed(table, chunk), template_fit.packed_entries)
    assert fit.top == next(k for k in range(20) if fan**k > 3999 // chunk)
    tau = template_fit.fitted(fit, templates.scatter(table, samples, "d"))
    got = {(r.block_id, r.t): r.y for r in templates.project(table, tau).collect()}
    long = table.toPandas()
    for b, part in long.groupby("block_id"):
        t = np.sort(part["t"].unique())
        d = np.sin(t * t / 1000.0) * 100 + t / 7.0
        want = dense_fit(np.searchsorted(t, part["t"].to_numpy()), part["bin"].to_numpy(), part["w"].to_numpy(), int(part["bin"].max()) + 1, d)
        assert np.allclose([got[b, x] for x in t], want, atol=1e-6 * np.linalg.norm(d))
    left = samples.join(templates.project(table, tau), ["block_id", "t"]).withColumn("left", F.col("d") - F.col("y"))
    lengths = samples.groupBy("block_id").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("length"))
    template_fit.checked(fit, templates.scatter(table, left, "left"), lengths)
    with pytest.raises(template_fit.Inexact):
        template_fit.checked(fit, templates.scatter(table, samples, "d"), lengths)
    if chunk == 100:
        assert fit.factors.filter("level > 0 AND place >= 0").count() > 10
        assert fit.factors.agg(F.max(F.size("local") + F.size("rest"))).first()[0] < 60


def test_expansion_moves_no_sample(spark, samples):
    """Samples are read once and stay where they are, whatever the number of classes; the others that are read are blocks and sweeps."""
    plan = templates.expanded(written(samples), 3, 6, 1, 130)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and "Exchange hash" not in plan


def test_left_over_by_chunks(samples):
    """What a fit leaves of two values at once is what the long tables leave, also of samples that have no sweep and blocks without any template."""
    rows = samples.withColumn("sweep", F.when(F.col("t") % 50 != 7, F.col("sweep"))).withColumn("e", F.cos(F.col("t") / 3.0)).withColumn("pix", F.when(F.col("t") % 4 > 0, F.col("t") % 9))
    for orders, bins, harmonics in ((3, 6, 1), (2, 0, 0)):
        long = templates.expanded(rows, orders, bins, harmonics, 130)
        packed = template_fit.packed_samples(templates.beside(rows, orders, bins, harmonics, 130), ["d", "e", "az"], 300)
        fit = template_fit.factored(packed, template_fit.sample_entries)
        got = template_fit.left_over(packed, fit, ["d", "e"], ["az"]).toPandas().set_index(["block_id", "t"]).sort_index()
        tau = template_fit.fitted(fit, templates.scatter(long, rows, ["d", "e"]))
        want = rows.join(templates.project(long, tau, ["y0", "y1"]), ["block_id", "t"], "left").toPandas().set_index(["block_id", "t"]).sort_index()
        assert len(got) == len(want) and (got["az"] == want["az"]).all() and (got["pix"] == want["pix"].fillna(-1)).all()
        for c, y in (("d", "y0"), ("e", "y1")):
            assert np.allclose(got[c], want[c] - want[y].fillna(0.0), atol=1e-9 * np.linalg.norm(want[c]))


def test_sums_of_near_and_far_numbers():
    for at in (np.array([5, 3, 5, 9]), np.array([10**9, 3, 10**9, 7]), np.zeros(0, int)):
        met, (got,) = solver._sums(at, [np.arange(len(at)) + 1.0])
        assert dict(zip(met, got)) == {k: sum(n + 1.0 for n in range(len(at)) if at[n] == k) for k in set(at.tolist())}


def test_driver_and_tables_fit_alike(samples):
    table = templates.expanded(samples, 3, 6, 1, 130)
    fit = template_fit.factored(template_fit.packed(table, 300), template_fit.packed_entries)
    right = templates.scatter(table, samples, "d")
    sizes = {r.block_id: r.n for r in table.groupBy("block_id").agg((F.max("bin") + 1).alias("n")).collect()}
    first = {b: sum(n for c, n in sizes.items() if c < b) for b in sizes}
    own = template_fit.DriverFit(fit, first, sum(sizes.values()))
    amp = np.zeros(sum(sizes.values()))
    for r in right.collect():
        amp[first[r.block_id] + r.bin] = r.amp
    tau = own(amp)
    assert np.allclose(own(np.stack([amp, 2 * amp], 1)), np.stack([tau, 2 * tau], 1), atol=1e-6 * np.abs(tau).max())
    assert all(abs(r.tau - tau[first[r.block_id] + r.bin]) <= 1e-6 * np.abs(tau).max() for r in template_fit.fitted(fit, right).collect())


def test_a_wrong_fit_raises(spark, samples, monkeypatch):
    rows = samples.select("*", (F.col("t") % 9).alias("pix"), F.lit(1.0).alias("w_i"), F.lit(0.0).alias("w_q"), F.lit(0.0).alias("w_u"), F.col("d").alias("value"))
    noise = spark.createDataFrame([(b, [1.0]) for b in range(3)], "block_id int, t array<double>")
    op = solver.NormalOperator(rows, noise, 1, templates=solver.Templates(3, 6, 1, 130))
    op.right_hand_side()
    op.fit.size = op.fit.size * 1.001
    with pytest.raises(template_fit.Inexact):
        op.right_hand_side()
