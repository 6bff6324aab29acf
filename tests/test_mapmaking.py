import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import numeric
from skyloom.operators import flags, noise, pixel_blocks, pointing, solver, table_solver, template_fit, templates, toeplitz
from skyloom.plans import config as C, mapmaker
from skyloom.sources import readers, sinks

PIX, N, BLOCKS = 20, 260, 3


def samples(seed=0, pixels=PIX, n=N, blocks=BLOCKS):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(blocks):
        pix = (np.arange(n) * 7 + b * 3 + rng.integers(0, 3, n)) % pixels
        psi = rng.uniform(0, math.pi, n)
        for t in range(n):
            rows.append((b, 0, b, t, b * n + t, int(pix[t]), 1.0, math.cos(2 * psi[t]), math.sin(2 * psi[t])))
    return rows


SCHEMA = "obs_id int, det int, block_id int, t long, row long, pix long, w_i double, w_q double, w_u double, signal double, noise double"


def tod(spark, rows, signal, noise_):
    return spark.createDataFrame([(*r, float(s), float(e)) for r, s, e in zip(rows, signal, noise_)], SCHEMA).repartition(3)


def dense(rows, pixels=PIX):
    a = np.zeros((len(rows), 3 * pixels))
    for k, r in enumerate(rows):
        if r[5] >= 0:
            a[k, 3 * r[5] : 3 * r[5] + 3] = r[6:9]
    return a


def weights(row, n=N, blocks=BLOCKS, remove_mean=False):
    one = numeric.dense_toeplitz(np.array(row), n)
    one = one @ (np.eye(n) - 1 / n) if remove_mean else one
    return np.kron(np.eye(blocks), one)


def noise_rows(spark, row, blocks=BLOCKS):
    return spark.createDataFrame([(b, [float(x) for x in row]) for b in range(blocks)], "block_id int, t array<double>")


def by_pix(df, pixels=PIX):
    out = np.zeros((pixels, 3))
    for r in df.select("pix", "i", "q", "u").collect():
        out[r.pix] = (r.i, r.q, r.u)
    return out.ravel()


def test_adjoint_and_products(spark):
    rows = samples()
    for k in range(0, len(rows), 11):
        rows[k] = (*rows[k][:5], -1, *rows[k][6:])
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=3 * PIX), rng.normal(size=len(rows))
    a = dense(rows)
    frame = tod(spark, rows, y, y)
    sky = spark.createDataFrame([(p, *map(float, x[3 * p : 3 * p + 3])) for p in range(PIX)], "pix long, i double, q double, u double")
    ax = {r.row: r.y for r in pointing.project(frame, sky).collect()}
    assert np.allclose([ax[k] for k in range(len(rows))], a @ x)
    assert np.allclose(by_pix(pointing.scatter(frame, "signal")), a.T @ y)
    assert np.allclose(by_pix(pointing.normal(frame, sky, F.lit(2.0))), a.T @ (2 * a @ x))
    coo = pointing.to_long(frame)
    vec = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "col long, x double")
    full = {r.row: r.y for r in pointing.multiply(coo, vec, frame).collect()}
    assert np.allclose([full[k] for k in range(len(rows))], a @ x)
    wide = {r.row: (r.cols, r.vals) for r in pointing.to_wide(coo).collect()}
    assert wide[1] == ([3 * rows[1][5] + s for s in range(3)], list(rows[1][6:9]))


def test_flagged_samples_meet_in_no_task(spark):
    """Most samples flagged: their keys are spread, and they get 0."""
    rows = spark.range(2000).select(F.col("id").alias("row"), F.when(F.col("id") % 10 > 0, -1).otherwise(F.col("id") % 7).cast("int").alias("pix"), F.lit(1.0).alias("w_i"), F.lit(0.0).alias("w_q"), F.lit(0.0).alias("w_u"), F.array(F.lit(1)).alias("more"))
    sky = spark.range(7).select(F.col("id").cast("int").alias("pix"), (F.col("id") + 1.0).alias("i"), F.lit(0.0).alias("q"), F.lit(0.0).alias("u"))
    assert rows.select(pointing._sky_key(rows).alias("k")).filter("k < 0").distinct().count() > 1700
    got = pointing.project(rows, sky).collect()
    assert len(got) == 2000 and all(r.y == (0 if r.pix < 0 else r.pix + 1) for r in got)


def test_worked_sparse_example(spark):
    idx, val = [0, 1, 2, 4, 0, 2, 0, 2, 2, 3, 3, 4, 1, 4, 1, 3], [1, 7, 2, 8, 5, 3, 5, 6, 2, 9, 8, 6, 1, 3, 6, 4]
    coo = spark.createDataFrame([(k // 2, k % 2, i, v) for k, (i, v) in enumerate(zip(idx, val))], "row long, j int, col long, val long")
    x = spark.createDataFrame([(k, k + 1) for k in range(5)], "col long, x long")
    assert [r.y for r in pointing.multiply(coo, x).orderBy("row").collect()] == [15, 46, 14, 23, 42, 62, 17, 28]
    y = spark.createDataFrame([(k, k + 1) for k in range(8)], "row long, y long")
    assert [r.x for r in pointing.multiply_transposed(coo, y).orderBy("col").collect()] == [36, 62, 47, 125, 73]


@pytest.mark.parametrize("rows,rcond", [([(1, 1, 0), (1, 0, 1), (1, -1, 0), (1, 0, -1)], 0.5), ([(1, 1, 0), (1, 0, 1), (1, -1, 0)], 0.125), ([(1, 1, 0), (1, -1, 0)], 0.0)])
def test_rcond(spark, rows, rcond):
    df = spark.createDataFrame([(0, *map(int, r)) for r in rows], "pix long, w_i long, w_q long, w_u long")
    assert pixel_blocks.with_rcond(pointing.weight_blocks(df)).first().rcond == rcond


def test_wide_and_narrow_products_in_chunks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=BLOCKS * N)
    frame = tod(spark, samples(), v, v)
    row = rng.normal(size=40)
    got = {(r.block_id, r.t): r.y for r in toeplitz.wide_product(frame, noise_rows(spark, row), "signal", chunk=64).collect()}
    want = weights(row) @ v
    assert np.allclose([got[b, t] for b in range(BLOCKS) for t in range(N)], want)
    small = {(r.block_id, r.t): r.y for r in toeplitz.narrow_product(frame, "signal", row[:5].tolist()).select("block_id", "t", "y").collect()}
    assert np.allclose([small[b, t] for b in range(BLOCKS) for t in range(N)], weights(row[:5]) @ v)
    meaned = {(r.block_id, r.t): r.y for r in toeplitz.weighted(frame, noise_rows(spark, row), "signal", 40).collect()}
    assert np.allclose([meaned[b, t] for b in range(BLOCKS) for t in range(N)], weights(row, remove_mean=True) @ v)


def test_gaps_in_a_gappy_product(spark):
    rows = spark.createDataFrame([(0, t, t, v) for t, v in enumerate([1, 2, 4, 8, 16])], "block_id int, t long, row long, v long")
    gaps = spark.createDataFrame([(2, 1)], "id0 long, len int")
    assert [r.y for r in toeplitz.gappy_product(rows, gaps, [10, 2, 3], "v").orderBy("row").collect()] == [14, 46, 0, 118, 176]
    packed = flags.gaps_dropped(rows, gaps).orderBy("row").collect()
    assert [(r.row, r.packed) for r in packed] == [(0, 0), (1, 1), (3, 2), (4, 3)]
    long = spark.createDataFrame([(0, 9000)], "id0 long, len int")
    assert flags.in_gaps(spark.range(10000).withColumnRenamed("id", "row"), long).filter("in_gap").count() == 9000


def test_sweeps(spark):
    scan = spark.createDataFrame([(0, t, f) for t, f in enumerate([1, 1, 9, 1, 8, 8, 2, 8])], "obs_id int, t long, flags int")
    bounds = flags.sweep_bounds(flags.scan_sweeps(scan)).orderBy("sweep").collect()
    assert [r.t0 for r in bounds] == [0, 2, 4, 7] and bounds[-1].t1 == 7
    with pytest.raises(ValueError):
        flags.flagged(F.col("flags"), -1)


ROW = [1.0, 0.3, 0.1]


@pytest.mark.parametrize("remove_mean,chunk", [(False, 64), (True, 64), (False, 1 << 18), (True, 1 << 18)])
def test_normal_operator_is_dense(spark, remove_mean, chunk):
    rows, rng = samples(), np.random.default_rng(3)
    d = rng.normal(size=len(rows))
    frame = tod(spark, rows, d, d).withColumn("value", F.col("signal"))
    op = solver.NormalOperator(frame, noise_rows(spark, ROW), 3, remove_mean=remove_mean, chunk=chunk)
    a, w = dense(rows), weights(ROW, remove_mean=remove_mean)
    assert np.allclose(op.right_hand_side(), a.T @ w @ d)
    x = rng.normal(size=(3 * PIX, 2))
    assert np.allclose(op.apply(x), a.T @ w @ a @ x)


def test_solvers_reach_the_dense_answer(spark):
    rows, rng = samples(), np.random.default_rng(4)
    x = rng.normal(size=3 * PIX)
    a, w = dense(rows), weights(ROW)
    d = a @ x + 0.1 * rng.normal(size=len(rows))
    want = np.linalg.solve(a.T @ w @ a, a.T @ w @ d)
    frame = tod(spark, rows, d, 0 * d).withColumn("value", F.col("signal"))
    op = solver.NormalOperator(frame, noise_rows(spark, ROW), 3, remove_mean=False)
    inverse = pixel_blocks.inverse(pointing.weight_blocks(frame))
    jacobi = solver.BlockJacobi(inverse, op.pixels)
    found = solver.pcg(op, jacobi, 1e-10, 60)
    assert found.converged and found.residuals[0] == 1.0 and np.allclose(found.x, want, atol=1e-7)
    assert np.allclose(by_pix(op.frame(found.x)), want, atol=1e-7)
    assert len(solver.pcg(op, jacobi, 1e-30, 4).residuals) == 4
    for orthodir, reduce in ((False, False), (True, False), (False, True)):
        block = solver.enlarged_cg(op, jacobi, 3, 1e-9, 60, reduce, orthodir)
        assert block.converged and np.allclose(block.x, want, atol=1e-6)
    for z in (solver.a_priori_basis(frame, op, 3), solver.lanczos_basis(op, 5)):
        two = solver.pcg(op, solver.TwoLevel(op, jacobi, z), 1e-10, 60)
        assert two.converged and np.allclose(two.x, want, atol=1e-7)


def on_tables(spark, seed, n=150, blocks=2, pixels=8):
    """(dense system, right-hand side, operator, inverse blocks) of a few pixels, map vectors as tables."""
    rows, rng = samples(seed, pixels, n, blocks), np.random.default_rng(seed)
    a, w = dense(rows, pixels), weights(ROW, n, blocks)
    d = a @ rng.normal(size=3 * pixels) + 0.1 * rng.normal(size=len(rows))
    frame = tod(spark, rows, d, 0 * d).withColumn("value", F.col("signal"))
    op = table_solver.TableOperator(frame, noise_rows(spark, ROW, blocks), 3, remove_mean=False)
    return a.T @ w @ a, a.T @ w @ d, op, pixel_blocks.inverse(pointing.weight_blocks(frame))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_stay_where_they_are(spark):
    """No exchange over stored samples in the projection, none at all with diagonal noise; flagged samples count as 0."""
    rows = samples(5, 8, 150, 2)
    frame = tod(spark, rows, np.ones(300), np.zeros(300)).withColumn("value", F.col("signal"))
    frame = frame.withColumn("pix", F.when(F.col("row") % 7 == 0, -1).otherwise(F.col("pix")))
    a = dense([(*r[:5], -1 if r[4] % 7 == 0 else r[5], *r[6:]) for r in rows], 8)
    x = np.random.default_rng(2).normal(size=(24, 2))
    v = spark.createDataFrame([(p, *map(float, x[3 * p : 3 * p + 3].T.ravel())) for p in range(8)], "pix long, " + ", ".join(f"{c} double" for c in table_solver.names(2)))
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = table_solver.TableOperator(frame, noise_rows(spark, [2.0], 2), 1)
        v = table_solver.combined((v, np.eye(2)))
        assert plan_of(plain.product(v)).count("Exchange hashpartitioning") == 1  # the vector's
        assert np.allclose(flat(plain.apply(v)), 2 * a.T @ a @ x) and np.allclose(flat(plain.right_hand_side())[:, 0], 2 * a.T @ np.ones(300))
        banded = table_solver.TableOperator(frame, noise_rows(spark, ROW, 2), 3)
        assert plan_of(banded.projected(v, ["p0", "p1"])).count("Exchange hashpartitioning") == 1
        w = weights(ROW, 150, 2, True)
        assert np.allclose(flat(banded.apply(v)), a.T @ w @ a @ x) and np.allclose(flat(banded.right_hand_side())[:, 0], a.T @ w @ np.ones(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)


class Dense:
    """What the driver's solvers need of a system."""

    def __init__(self, a, b):
        self.a, self.b, self.pixels = a, b, np.arange(len(b) // 3)

    def right_hand_side(self):
        return self.b

    def apply(self, x):
        return self.a @ x


def flat(v, pixels=8):
    """A block vector as numpy."""
    k = table_solver.width_of(v)
    out = np.zeros((pixels, 3, k))
    for r in v.collect():
        out[r.pix] = np.array([[r[f"{s}{c}"] for c in range(k)] for s in "iqu"])
    return out.reshape(3 * pixels, k)


def test_block_vectors_as_tables(spark):
    a, b, op, inverse = on_tables(spark, 31)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(24, 3))
    v = spark.createDataFrame([(p, *map(float, x[3 * p : 3 * p + 3].T.ravel())) for p in range(8)], "pix long, " + ", ".join(f"{c} double" for c in table_solver.names(3)))
    assert np.allclose(flat(v), x) and np.allclose(flat(op.right_hand_side())[:, 0], b)
    image = op.apply(v)  # all columns in one pass
    assert np.allclose(flat(image), a @ x) and np.allclose(table_solver.gram(v, image), x.T @ a @ x) and np.allclose(table_solver.gram(v), x.T @ x)
    m, n = rng.normal(size=(3, 2)), rng.normal(size=(3, 2))
    assert np.allclose(flat(table_solver.combined((v, m), (image, n))), x @ m + a @ x @ n)
    jacobi = solver.BlockJacobi(inverse, np.arange(8))
    assert np.allclose(flat(table_solver.TableJacobi(inverse)(v)), jacobi(x))
    two = table_solver.TableTwoLevel(op, table_solver.TableJacobi(inverse), v)
    assert np.allclose(flat(two(image)), solver.TwoLevel(Dense(a, b), jacobi, x)(a @ x), atol=1e-9)


@pytest.mark.parametrize("reduce,orthodir", [(False, False), (True, True)])
def test_enlarged_cg_on_tables(spark, reduce, orthodir):
    a, b, op, inverse = on_tables(spark, 32)
    jacobi = solver.BlockJacobi(inverse, np.arange(8))
    want = solver.enlarged_cg(Dense(a, b), jacobi, 4, 1e-9, 3, reduce, orthodir)
    sky, residuals = table_solver.enlarged_cg(op, table_solver.TableJacobi(inverse), 4, 1e-9, 3, reduce, orthodir)
    assert np.allclose(residuals, want.residuals, rtol=1e-5, atol=1e-9) and np.allclose(by_pix(sky, 8), want.x, atol=1e-7)


def test_lanczos_basis_on_tables(spark):
    a, b, op, inverse = on_tables(spark, 33)
    basis, values = table_solver.lanczos_basis(op, 3)
    start = flat(table_solver.random_vector(op))[:, 0]
    z = flat(basis)
    want = solver.lanczos_basis(Dense(a, b), 3, start=start)
    assert np.allclose(z.T @ z, np.eye(3), atol=1e-9) and np.allclose(np.abs(np.sum(z * want, 0)), 1, atol=1e-8)
    q = np.linalg.qr(np.stack([np.linalg.matrix_power(a / np.linalg.norm(a), k) @ start for k in range(3)], 1))[0]
    assert np.allclose(values, np.linalg.eigvalsh(q.T @ a @ q), rtol=1e-6) and np.allclose(np.diag(z.T @ a @ z), values)
    system, jacobi = Dense(a, b), solver.BlockJacobi(inverse, np.arange(8))
    for v in (basis, table_solver.a_priori_basis(op, 3)):
        own = solver.pcg(system, solver.TwoLevel(system, jacobi, flat(v)), 1e-9, 3)
        sky, residuals = table_solver.pcg(op, table_solver.TableTwoLevel(op, table_solver.TableJacobi(inverse), v), 1e-9, 3)
        assert np.allclose(residuals, own.residuals, rtol=1e-6) and np.allclose(by_pix(sky, 8), own.x, atol=1e-8)


def test_more_pixels_than_the_driver_holds(spark, tmp_path, monkeypatch):
    """Tables of map vectors: the same maps, with templates and with any solver and preconditioner."""
    rows, rng = samples(n=120, blocks=2), np.random.default_rng(9)
    x = rng.normal(size=3 * PIX)
    frame = tod(spark, rows, dense(rows) @ x, 0 * np.arange(len(rows)))
    scan = spark.createDataFrame([(b, t, 0, math.sin(t / 9), t * 0.3) for b in range(2) for t in range(120)], "obs_id int, t long, flags int, az double, hwp_angle double")
    base = {"path_output": str(tmp_path), "ref": "x", "nside": 2, "fsample": 10.0, "tol": 1e-5, "maxiter": 4}
    mt = C.build("", base, {"map_maker": "MT", "sss": True, "sbins": 3})
    on_driver = by_pix(mapmaker.make_maps(mt, frame, scan=scan).sky)
    monkeypatch.setattr(solver, "DRIVER_PIXELS", 5)
    on_tables = mapmaker.make_maps(mt, frame, scan=scan)
    assert np.allclose(by_pix(on_tables.sky), on_driver, atol=1e-6)
    block = C.build("", base, {"uniform_w": True, "bandwidth": 1, "solver": 1, "enlarge": 2, "precond": 2, "z_2lvl": 3})
    got = by_pix(mapmaker.make_maps(block, frame).sky)
    assert (got != 0).sum() > 40 and np.allclose(got[got != 0], x[got != 0], atol=1e-3)  # some pixels are cut


def test_pointing_from_expressions(spark, tmp_path):
    rows, rng = samples(), np.random.default_rng(10)
    x = rng.normal(size=3 * PIX)
    frame = tod(spark, rows, dense(rows) @ x, 0 * np.arange(len(rows))).withColumn("cell", F.col("pix")).withColumn("two_psi", F.atan2("w_u", "w_q")).drop("pix", "w_i", "w_q", "w_u")
    how = lambda df: {"pix": F.col("cell"), "w_i": F.lit(1.0), "w_q": F.cos("two_psi"), "w_u": F.sin("two_psi")}
    maps = mapmaker.make_maps(C.build("", {"path_output": str(tmp_path), "ref": "x", "nside": 2, "uniform_w": True}), frame, pointing_of=how)
    assert np.allclose(by_pix(maps.sky), x, atol=1e-5)
    sinks.write_map_parts(maps.sky, str(tmp_path / "parts"), 2)
    back = sorted((r.pix, r.hits, r.i) for r in readers.map_parts(spark, str(tmp_path / "parts")).collect())
    assert back == sorted((r.pix, r.hits, r.i) for r in maps.sky.collect())


def test_wide_gappy_product_and_its_blocks(spark):
    n, row = 80, [1.0 / (1 + k) for k in range(20)]
    rng = np.random.default_rng(12)
    v = rng.normal(size=(2, n))
    rows = spark.createDataFrame([(b, t, b * n + t, float(v[b, t])) for b in range(2) for t in range(n)], "block_id int, t long, row long, d double")
    gaps = spark.createDataFrame([(30, 25), (100, 4)], "id0 long, len long")
    own = spark.createDataFrame([(b, [float(x) * (b + 1) for x in row]) for b in range(2)], "block_id int, t array<double>")
    got = {(r.block_id, r.t): r.y for r in toeplitz.gappy_product(rows, gaps, own, "d").collect()}
    open_ = np.ones((2, n))
    open_[0, 30:55] = 0
    open_[1, 20:24] = 0
    for b in range(2):
        want = open_[b] * (numeric.dense_toeplitz(np.array(row) * (b + 1), n) @ (open_[b] * v[b]))
        assert np.allclose([got[b, t] for t in range(n)], want)
    pieces = toeplitz.gappy_blocks(rows, gaps, 20).groupBy("block_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last")).collect()
    assert sorted((r.block_id, r.piece, r.n, r["last"]) for r in pieces) == [(0, 0, 30, 29), (0, 1, 25, 24), (1, 0, 80, 79)]
    with pytest.raises(ValueError, match="band"):
        toeplitz.checked_bandwidth(own, spark.createDataFrame([(0, 19), (1, 80)], "block_id int, n long"))
    assert numeric.example_row(2, 3).tolist() == [10, 2, 3] and numeric.example_row(3, 4).tolist() == [2, -1, 0, 0] and 1 <= numeric.example_row(1, 5).min()


def test_chunks_of_a_long_block(spark):
    """Narrow products and sweeps are the same however an observation is cut."""
    rng = np.random.default_rng(13)
    v, f = rng.normal(size=60), rng.integers(0, 16, 60)
    rows = spark.createDataFrame([(0, t, float(v[t]), int(f[t])) for t in range(60)], "obs_id int, t long, d double, flags int").withColumn("block_id", F.col("obs_id"))
    for chunk in (4, 7, 1000):
        y = {r.t: r.y for r in toeplitz.narrow_product(rows, "d", [2.0, -1.0, 0.5], chunk=chunk).collect()}
        assert np.allclose([y[t] for t in range(60)], numeric.dense_toeplitz(np.array([2.0, -1.0, 0.5]), 60) @ v)
        s = {r.t: r.sweep for r in flags.scan_sweeps(rows, chunk=chunk).collect()}
        assert [s[t] for t in range(60)] == np.cumsum([0] + [int((f[t - 1] & f[t]) < 8 and f[t] >= 8) for t in range(1, 60)]).tolist()


def test_constant_azimuth_and_empty_sweeps(spark):
    flat = spark.createDataFrame([(0, t, 4.0, 4.0, 4.0) for t in range(5)], "block_id int, t long, az double, az_min double, az_max double")
    assert {r.bin for r in templates.scan_synchronous(flat, 6).collect()} == {0}
    with pytest.raises(ValueError):
        flags.fixed_sweeps(flat, 0.01, 10.0)


def test_other_parameter_names():
    cfg = C.build("Lambda = 128\nZ_2lvl = 4\nptcomm_flag = 6\nenlFac = 2\nbs_red = 1\nfixed_polybase = 1\npolybaseline_length = 12.5\nhwpssbaseline_length = 7", {"path_output": "o", "ref": "r"})
    assert (cfg.bandwidth, cfg.z_2lvl, cfg.enlarge, cfg.block_reduction, cfg.sweeps_from_flags, cfg.poly_baseline, cfg.plate_baseline) == (128, 4, 2, True, False, 12.5, 7.0)


def test_block_reduction():
    """Parts of a residual that depend on each other from the start, and ones that come to."""
    rng = np.random.default_rng(21)
    root = rng.normal(size=(30, 30))

    class Plain:
        a = root @ root.T + 30 * np.eye(30)
        widths: list[int] = []

        def right_hand_side(self):
            b = np.zeros(30)
            b[:6] = 1.0  # the other parts are 0
            return b

        def apply(self, x):
            self.widths.append(x.shape[1])
            return self.a @ x

    op = Plain()
    found = solver.enlarged_cg(op, lambda g: g, 5, 1e-10, 60, reduce=True)
    assert found.converged and np.allclose(op.a @ found.x, op.right_hand_side(), atol=1e-8)
    assert op.widths[0] == 5 and op.widths[1] < 5 and op.widths[-1] <= op.widths[1]


def test_templates_are_filtered_out(spark):
    rows, rng = samples(), np.random.default_rng(5)
    t = np.array([r[3] for r in rows])
    az, plate, sweep = np.sin(t / 9.0), t * 0.37, t // 65
    x = rng.normal(size=3 * PIX)
    a = dense(rows)
    how = solver.Templates(2, 5, 1, 130)
    columns = []
    for b in range(BLOCKS):
        own = slice(b * N, (b + 1) * N)
        classes, bins = how.expand({"t": t[own], "sweep": sweep[own], "az": az[own], "hwp_angle": plate[own]})
        full = np.zeros((len(rows), bins))
        for bin_, w in classes:
            full[np.arange(N) + b * N, bin_] += w
        columns.append(full)
    m = np.concatenate(columns, 1)
    d = a @ x + m @ (5 * rng.normal(size=m.shape[1]))
    scan = spark.createDataFrame([(r[0], r[3], int(s), float(z), float(p)) for r, s, z, p in zip(rows, sweep, az, plate)], "obs_id int, t long, sweep int, az double, hwp_angle double")
    frame = tod(spark, rows, d, 0 * d).withColumn("value", F.col("signal")).join(scan, ["obs_id", "t"])
    op = solver.NormalOperator(frame, noise_rows(spark, [2.0]), 1, templates=how)
    f = 2 * (np.eye(len(rows)) - m @ np.linalg.pinv(m))
    assert np.allclose(op.right_hand_side(), a.T @ f @ d, atol=1e-6)
    assert np.allclose(op.apply(x), a.T @ f @ a @ x, atol=1e-7)
    jacobi = solver.BlockJacobi(pixel_blocks.inverse(pointing.weight_blocks(frame, F.lit(2.0))), op.pixels)
    found = solver.pcg(op, jacobi, 1e-9, 200)
    assert np.allclose(a.T @ f @ (d - a @ found.x), 0, atol=1e-4)
    with pytest.raises(ValueError):
        solver.NormalOperator(frame, noise_rows(spark, [2.0]), 2, templates=how)


def test_long_template_tables(spark):
    scan = spark.createDataFrame([(0, t, t // 5, 0.0, float(t % 7)) for t in range(10)], "block_id int, t long, sweep int, az_min double, az double").withColumn("az_max", F.lit(6.0)).withColumn("hwp_angle", F.col("t") / 3)
    scan = scan.withColumn("t0", F.col("sweep") * 5).withColumn("t1", F.col("t0") + 4).withColumn("n_sweeps", F.lit(2))
    poly = templates.polynomials(scan, 3).collect()
    assert sorted({r.bin for r in poly}) == list(range(6)) and [r.w for r in sorted(poly, key=lambda r: (r.bin, r.t)) if r.bin == 4] == [1, -0.125, -0.5, -0.125, 1]
    assert [r.bin for r in templates.scan_synchronous(scan, 3).orderBy("t").collect()] == [min(2, (t % 7) // 2) for t in range(10)]
    plate = {(r.t, r.bin): r.w for r in templates.plate_synchronous(scan, 1, 5, 2, first=6).collect()}
    assert np.isclose(plate[7, 7], math.cos(7 / 3)) and np.isclose(plate[7, 9], math.sin(7 / 3))
    table = templates.polynomials(scan, 3)
    data = scan.withColumn("d", F.col("t") * F.col("t") * 1.0)
    tau = templates.amplitudes(templates.inverted(templates.kernel(table)), templates.scatter(table, data, "d"))
    fit = {r.t: r.y for r in templates.project(table, tau).collect()}
    assert np.allclose([fit[t] for t in range(10)], [t * t for t in range(10)])


def test_noise_estimates(spark):
    rng = np.random.default_rng(6)
    v = 1e-3 * rng.normal(size=BLOCKS * N)
    frame = tod(spark, samples(), v, v)
    got = noise.inverse_noise(frame, "noise", 10.0, 16).orderBy("block_id").collect()
    for r in got:
        row, _ = numeric.inverse_noise_row(v[r.block_id * N : (r.block_id + 1) * N], 10.0, 16)
        assert r.n == N and np.allclose(r.t, row)
    assert noise.spectra(frame, "noise", 10.0).count() == BLOCKS * (N // 2 + 1)


@pytest.mark.parametrize("n", [1000, 1021, 777])
def test_noise_of_a_block_over_many_tasks(spark, monkeypatch, n):
    """Even, prime and odd lengths: the same spectrum, fit and first row as a task has that holds the block."""
    rng = np.random.default_rng(n)
    v = {b: np.cumsum(rng.normal(size=n)) * 1e-3 + rng.normal(size=n) * 1e-2 + 0.01 * np.arange(n) for b in range(2)}
    rows = spark.createDataFrame([(b, t, float(x)) for b, own in v.items() for t, x in enumerate(own)] + [(7, t, float(t % 5)) for t in range(40)], "block_id int, t long, d double").repartition(4)
    monkeypatch.setattr(noise, "LONG", 100)
    monkeypatch.setattr(noise, "TASK", 256)
    got = noise.spectra(rows, "d", 25.0).toPandas()
    for b, own in v.items():
        f, power = numeric.periodogram(own, 25.0)
        mine = got[got["block_id"] == b].sort_values("k")
        assert mine["k"].tolist() == list(range(n // 2 + 1)) and np.allclose(mine["f"], f)
        assert np.allclose(mine["power"], power, rtol=1e-6, atol=1e-12 * power.max())
    assert (got["block_id"] == 7).sum() == 21
    rows_ = {r.block_id: r for r in noise.inverse_noise(rows, "d", 25.0, 20, "gaussian").collect()}
    for b, own in v.items():
        want, p = numeric.inverse_noise_row(own, 25.0, 20, "gaussian")
        assert rows_[b].n == n and np.allclose(rows_[b].t, want, rtol=1e-3, atol=1e-4 * want[0]) and len(rows_) == 3


def test_stretches_of_an_inverse_transform():
    for n, lam in ((64, 10), (101, 30), (4096, 700)):
        s = np.random.default_rng(n).normal(size=n // 2 + 1)
        weight = np.where((np.arange(len(s)) > 0) & ((np.arange(len(s)) < n // 2) | (n % 2 == 1)), 2.0, 1.0)
        whole = sum(numeric.partial_inverse((s * weight)[at : at + 13], at, n, lam).real for at in range(0, len(s), 13)) / n
        assert np.allclose(whole, np.fft.irfft(s, n)[:lam])


def test_input_is_checked(spark, tmp_path):
    rows = samples(n=30, blocks=2)
    frame, cfg = tod(spark, rows, np.zeros(60), np.zeros(60)), C.build("", {"path_output": str(tmp_path), "ref": "x", "nside": 2, "bandwidth": 3})
    with pytest.raises(ValueError, match="without block_id"):
        mapmaker.make_maps(cfg, frame.withColumn("block_id", F.when(F.col("row") != 5, F.col("block_id"))))
    for odd in (noise_rows(spark, [1.0, 0.1, 0.0], 1), noise_rows(spark, [1.0], 2).union(noise_rows(spark, [2.0], 1)), noise_rows(spark, [], 2)):
        with pytest.raises(ValueError, match="exactly one row"):
            mapmaker.make_maps(cfg, frame, noise=odd)
    for bad in ({"product": "x"}, {"fft_size": "large"}):
        with pytest.raises(ValueError):
            C.build("", {"path_output": "a", "ref": "b"}, bad)
    assert C.build("product = fft\nfft_size = 4096", {"path_output": "a", "ref": "b"}).products() == {"method": "fft", "fft_size": 4096}


def test_whole_run(spark, tmp_path):
    rows, rng = samples(), np.random.default_rng(7)
    x = rng.normal(size=3 * PIX)
    rows += [(0, 0, BLOCKS, t, BLOCKS * N + t, 21, 1.0, 1.0, 0.0) for t in range(5)]  # one angle only
    a = np.zeros((len(rows), 3 * PIX))
    a[: BLOCKS * N] = dense(rows[: BLOCKS * N])
    frame = tod(spark, rows, a @ x, np.zeros(len(rows))).withColumn("flags", F.when(F.col("row") % 50 == 3, 1).otherwise(0))
    cfg = C.build("tol = 1e-9 # tight\nnside = 2\n# comment\nuniform_w = 1", {"path_output": str(tmp_path / "out")}, {"ref": "r1"})
    maps = mapmaker.run(cfg, frame)
    assert np.allclose(by_pix(maps.sky), x, atol=1e-6)
    assert [r.pix for r in maps.removed.collect()] == [21]
    assert maps.full_sky(2).count() == 48
    out = tmp_path / "out"
    head, values = sinks.read_fits_map((out / "mapQ_r1.fits").read_bytes())
    assert head["ORDERING"] == "NESTED" and head["NSIDE"] == "2" and head["COORDSYS"] == "C"
    assert np.allclose(values[:PIX], x[1::3], atol=1e-6) and not values[PIX:].any()
    hits = sinks.read_fits_map((out / "Hits_r1.fits").read_bytes())[1]
    assert hits.sum() == sum(1 for r in rows[: BLOCKS * N] if r[4] % 50 != 3)
    raw = (out / "pcg_residuals_r1.dat").read_bytes()
    assert struct.unpack(f"<{len(raw) // 8}d", raw) == tuple(maps.residuals)
    assert "nside = 2" in (out / "parameters_r1.toml").read_text()
    assert len((out / "mapI_r1.fits").read_bytes()) % 2880 == 0


def test_estimated_noise_and_templates_run(spark, tmp_path):
    rows, rng = samples(8), np.random.default_rng(8)
    x = rng.normal(size=3 * PIX)
    e = 1e-3 * rng.normal(size=len(rows))
    frame = tod(spark, rows, dense(rows) @ x, e)
    base = {"path_output": str(tmp_path), "ref": "x", "nside": 2, "fsample": 10.0}
    ml = mapmaker.make_maps(C.build("", base, {"bandwidth": 8, "remove_mean": False}), frame)
    assert np.allclose(by_pix(ml.sky), x, atol=0.01)
    scan = spark.createDataFrame([(b, t, 0, math.sin(t / 9), t * 0.3) for b in range(BLOCKS) for t in range(N)], "obs_id int, t long, flags int, az double, hwp_angle double")
    mt = mapmaker.make_maps(C.build("", base, {"map_maker": "MT", "npoly": 1, "poly_baseline": 20.0, "maxiter": 300}), frame, scan=scan)
    got = by_pix(mt.sky).reshape(-1, 3)
    assert np.allclose(got[:, 1:], x.reshape(-1, 3)[:, 1:], atol=0.02)  # the offset of I is a template


def test_settings():
    with pytest.raises(ValueError):
        C.build("", {}, {"ref": "a"})
    for bad in ({"nside": 3}, {"nnz": 2}, {"map_maker": "XX"}, {"precond": 5}, {"shared_mask": -1}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            C.build("", {"path_output": "a", "ref": "b"}, bad)
    cfg = C.build("tol=1e-3\nref = file", {"ref": "trait", "path_output": "p"}, {"tol": 0.5})
    assert (cfg.ref, cfg.tol, cfg.bandwidth) == ("trait", 0.5, 16384)
    assert C.build("", {"path_output": "a", "ref": "b", "map_maker": "MT"}).bandwidth == 1


def test_raw_and_ascii_sources(spark, tmp_path):
    pix = np.array([[0, 1, 2], [9, 10, 11]], "<u4")
    w, s = np.arange(6.0).reshape(2, 3), np.array([5.0, 6.0])
    for name, data in (("pixels", pix), ("weights", w), ("signal", s)):
        (tmp_path / f"{name}_4.dat").write_bytes(data.tobytes())
    got = readers.raw_samples(spark, *(str(tmp_path / f"{n}_*.dat") for n in ("pixels", "weights", "signal"))).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(4, 0, 0, 0.0, 1.0, 2.0, 5.0), (4, 1, 3, 3.0, 4.0, 5.0, 6.0)]
    (tmp_path / "m_0.txt").write_text("1 2.5 3 4\n0 1\n")
    assert [tuple(r) for r in readers.ell(spark, str(tmp_path / "m_*.txt")).orderBy("line", "j").collect()] == [(0, 0, 0, 1, 2.5), (0, 0, 1, 3, 4.0), (0, 1, 0, 0, 1.0)]
    assert readers.synthetic(spark, 10, 1).filter("signal >= 0 AND signal < 10").count() == 10
    wide = spark.createDataFrame([(0, [1, 3], [2.5, 4.0])], "row long, cols array<long>, vals array<double>")
    sinks.write_ell(wide, str(tmp_path / "ell"))
    assert spark.read.text(str(tmp_path / "ell")).first().value == "1 2.5 3 4.0"
    with pytest.raises(ValueError):
        sinks.fits_map(np.zeros(5), 1)


def test_streamed_map_is_the_batch_map(spark, tmp_path):
    from skyloom.streaming import accumulate

    rows = samples(9)
    d = dense(rows) @ np.random.default_rng(9).normal(size=3 * PIX)
    frame = tod(spark, rows, d, 0 * d)
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = accumulate.sums(stream, "signal").writeStream.outputMode("complete").format("memory").queryName("sky_sums").start()
    try:
        run.processAllAvailable()
        got = by_pix(accumulate.solved(spark.table("sky_sums")))
    finally:
        run.stop()
    want = by_pix(pixel_blocks.solved(pointing.weight_blocks(frame), pointing.scatter(frame, "signal")))
    assert np.allclose(got, want)


def test_templates_of_a_block_in_chunks(spark, tmp_path, monkeypatch):
    """A block with templates lies in several rows, lacks samples here and there, and gives the dense result; none holds its kernel whole."""
    kept = [r for r in samples() if r[3] % 37 > 4]
    rng, how = np.random.default_rng(15), solver.Templates(2, 5, 1, 130)
    t, block = np.array([r[3] for r in kept]), np.array([r[2] for r in kept])
    az, plate, sweep = np.sin(t / 9.0), t * 0.37, t // 65
    columns = []
    for b in range(BLOCKS):
        own = np.flatnonzero(block == b)
        classes, bins = how.expand({"t": t[own], "sweep": sweep[own], "az": az[own], "hwp_angle": plate[own]})
        full = np.zeros((len(kept), bins))
        for bin_, w in classes:
            full[own, bin_] += w
        columns.append(full)
    m, a, x = np.concatenate(columns, 1), dense(kept), rng.normal(size=3 * PIX)
    d = a @ x + m @ (5 * rng.normal(size=m.shape[1]))
    scan = spark.createDataFrame([(r[0], r[3], int(s), float(z), float(p)) for r, s, z, p in zip(kept, sweep, az, plate)], "obs_id int, t long, sweep int, az double, hwp_angle double")
    frame = tod(spark, kept, d, 0 * d).withColumn("value", F.col("signal")).join(scan, ["obs_id", "t"])
    op = solver.NormalOperator(frame, noise_rows(spark, [2.0]), 1, templates=how, chunk=50)
    assert op.rows.groupBy("block_id").count().agg(F.min("count")).first()[0] >= 5
    f = 2 * (np.eye(len(kept)) - m @ np.linalg.pinv(m))
    assert np.allclose(op.right_hand_side(), a.T @ f @ d, atol=1e-6)
    assert np.allclose(op.apply(np.stack([x, -2 * x], 1)), a.T @ f @ a @ np.stack([x, -2 * x], 1), atol=1e-7)
    monkeypatch.setattr(solver, "DRIVER_CROSS", 5)  # an iteration in two jobs
    jobs = solver.NormalOperator(frame, noise_rows(spark, [2.0]), 1, templates=how, chunk=50)
    assert op.cross is not None and jobs.cross is None
    assert np.allclose(jobs.apply(np.stack([x, -2 * x], 1)), a.T @ f @ a @ np.stack([x, -2 * x], 1), atol=1e-7)
    for name in ("DRIVER_FACTORS", "DRIVER_BINS"):
        monkeypatch.setattr(solver, name, 5)
        with pytest.raises(solver.TooMany):
            solver.NormalOperator(frame, noise_rows(spark, [2.0]), 1, templates=how)
        monkeypatch.undo()


def test_sums_come_to_the_driver_in_few_rows(spark, monkeypatch):
    """Not in batches of four numbers: a row a task."""
    seen, own = [], type(spark.range(1)).toArrow
    op = solver.NormalOperator(tod(spark, samples(), dense(samples()) @ np.ones(3 * PIX), np.zeros(len(samples()))).withColumn("value", F.col("signal")), noise_rows(spark, [2.0]), 1)
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: seen.append(own(df)) or seen[-1])
    a = dense(samples())
    assert np.allclose(op.apply(np.arange(3.0 * PIX)), 2 * a.T @ a @ np.arange(3.0 * PIX))
    assert [t.num_rows <= 4 < PIX for t in seen] == [True]


@pytest.mark.parametrize("orthodir,vectors", [(False, 5), (True, 7)])
def test_block_vectors_that_the_driver_holds(orthodir, vectors):
    """Residuals, directions, images and one more, of as many columns as there are directions; orthodir has two sets more."""
    import tracemalloc

    rng, n = np.random.default_rng(5), 3 * 100_000
    scale, turn, want = rng.uniform(1, 2, n), np.ones(n) / n**0.5, rng.normal(size=n)

    class Operator:
        def apply(self, x):
            return scale[:, None] * x + 5 * turn[:, None] * (turn @ x) if x.ndim > 1 else scale * x + 5 * turn * (turn @ x)

        def right_hand_side(self):
            return self.apply(want)

    tracemalloc.start()
    found = solver.enlarged_cg(Operator(), lambda g: g, 8, 1e-10, 60, orthodir=orthodir)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.converged and np.allclose(found.x, want, atol=1e-6)
    assert peak < vectors * 8 * 8 * n


def test_templates_of_a_chunk_are_fitted_there(spark, monkeypatch):
    """The driver sees what several chunks share, not the factors of all chunks: their number alone is no reason for vectors as tables."""
    monkeypatch.setattr(solver, "DRIVER_CROSS", 5)
    n, how = 6000, solver.Templates(4, 0, 2, 130)
    frame = spark.range(n).select(F.lit(0).alias("block_id"), F.col("id").alias("t"), (F.col("id") % 37).alias("pix"), F.lit(1.0).alias("w_i"), F.cos(F.col("id") * 1.7).alias("w_q"), F.sin(F.col("id") * 1.7).alias("w_u"))
    frame = frame.withColumn("value", F.sin(F.col("t") * F.col("t") / 900) * 100).withColumn("sweep", F.floor(F.col("t") / 101)).withColumn("hwp_angle", F.col("t") / 500.0)
    weights = spark.createDataFrame([(0, [2.0])], "block_id int, t array<double>")
    op = solver.NormalOperator(frame, weights, 1, templates=how, chunk=500)
    assert sum(f.solve.size + f.r.size for f in op.fit.factors) < 9000 < op.rows.agg(F.sum(F.length("solve") + F.length("r")) / 8).first()[0]
    assert len(op.fit.known) < 20 * 12
    monkeypatch.setattr(solver, "DRIVER_FACTORS", 9000)
    t, rng = np.arange(n), np.random.default_rng(3)
    op, x = solver.NormalOperator(frame, weights, 1, templates=how, chunk=500), rng.normal(size=(3 * 37, 2))
    classes, bins = how.expand({"t": t, "sweep": t // 101, "hwp_angle": t / 500.0})
    m, a = np.zeros((n, bins)), np.zeros((n, 111))
    for at, w in classes:
        m[t, at] += w
    for s, w in enumerate((np.ones(n), np.cos(t * 1.7), np.sin(t * 1.7))):
        a[t, 3 * (t % 37) + s] = w
    m /= np.linalg.norm(m, axis=0)
    left = lambda v: v - m @ np.linalg.lstsq(m, v, rcond=1e-10)[0]
    assert np.allclose(op.apply(x), 2 * a.T @ left(a @ x), atol=1e-6 * np.linalg.norm(x))
    assert np.allclose(op.right_hand_side(), 2 * a.T @ left(np.sin(t * t / 900.0) * 100), atol=1e-4)
    op.fit.factors = op.fit.factors[:-1]  # a wrong fit of what chunks share
    with pytest.raises(template_fit.Inexact):
        op.right_hand_side()


@pytest.mark.parametrize("sent", [1 << 20, 10])
def test_stacked_products_over_tasks_of_bounded_size(spark, monkeypatch, sent):
    """Tasks are as many as the entries ask for, also where a row is long; vectors that are sent or dealt give the same."""
    monkeypatch.setattr(pointing, "ENTRIES", 100)
    monkeypatch.setattr(pointing, "SENT", sent)
    level = spark.range(1500).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 90).alias("row"), (F.col("id") % 41 - 1).alias("col"), (F.col("id") % 5).alias("val"))
    coo, x = pointing.stacked([level, level.filter("col < 20")]), spark.range(-1, 41).select(F.col("id").alias("col"), (F.col("id") % 11).alias("x"))
    want = coo.toPandas().query("col >= 0")
    got = pointing.multiply_stacked(coo, x)
    assert got.rdd.getNumPartitions() >= 20
    assert {(r.level, r.row): r.y for r in got.collect()} == (want["val"] * (want["col"] % 11)).groupby([want["level"], want["row"]]).sum().to_dict()
    back = pointing.multiply_stacked_transposed(coo, got)
    total = want.merge(got.toPandas(), on=["level", "row"])
    assert {r.col: r.x for r in back.collect()} == (total["val"] * total["y"]).groupby(total["col"]).sum().to_dict()


def test_products_over_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(pointing, "ENTRIES", 100)
    coo = spark.range(1500).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 90).alias("row"), (F.col("id") % 41 - 1).alias("col"), (F.col("id") % 5).alias("val"))
    got = pointing.multiply(coo, spark.range(-1, 41).select(F.col("id").alias("col"), (F.col("id") % 11).alias("x")))
    want = coo.toPandas().query("col >= 0")
    assert got.rdd.getNumPartitions() >= 15
    assert {r.row: r.y for r in got.collect()} == (want["val"] * (want["col"] % 11)).groupby(want["row"]).sum().to_dict()


def test_blocks_over_a_quarter_million_samples_are_spread(spark):
    """A task's transform holds no more than that, nor a tile of a long one."""
    short, long = noise._parted(spark.range(1 << 19).select(F.lit("a").alias("block_id"), F.col("id").alias("t"), F.lit(1.0).alias("d")), "block_id")
    assert long is not None and long.count() == 1 << 19 and short.count() == 0
    n1, n2, width, height = noise._shape(1 << 19)
    assert max(n1 * width, n2 * height) <= 1 << 18


def test_jobs_over_chunks_take_few_at_a_time(spark):
    """However many chunks a task has, Python sees a few at once; sums are by task."""
    from skyloom.sources.staging import wide_rows, written

    n = 5000
    tod = spark.range(n).select(F.lit("a").alias("block_id"), F.col("id").alias("t"), (F.col("id") % 7).alias("pix"), F.lit(1.0).alias("w_i"), (F.col("id") % 3 * 1.0).alias("w_q"), (F.col("id") % 5 - 2.0).alias("w_u"), F.sin("id").alias("value"))
    rows = written(tod, "samples")
    op = solver.NormalOperator(rows, spark.createDataFrame([("a", [10.0, 2.0, 3.0])], "block_id string, t array<double>"), 3, remove_mean=False, chunk=100)
    sizes = lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches)
    with wide_rows(spark):
        assert max(r.n for r in op.rows.coalesce(1).mapInArrow(sizes, "n long").collect()) <= 4
    parts = op._plain_job(None)
    assert parts.count() <= 7 * parts.rdd.getNumPartitions()
    whole = solver.NormalOperator(rows, spark.createDataFrame([("a", [10.0, 2.0, 3.0])], "block_id string, t array<double>"), 3, remove_mean=False)
    assert np.allclose(op.right_hand_side(), whole.right_hand_side(), atol=1e-9)
    assert np.allclose(op.apply(np.arange(21.0)), whole.apply(np.arange(21.0)), atol=1e-7)
