"""Every query with SQL gives the SQL's rows; the others run and give rows."""

import os

import duckdb
import pytest

import __spark_entry__
from skyloom.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    shown = lambda v: f"{v:.10g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = __spark_entry__.oracle_sql()[name]
    want = con.execute(f"SELECT {', '.join(f'{c:s}' if c != 'list' else '\"list\"' for c in columns)} FROM ({sql})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)
    assert len(want) or name == "degenerate_pixels"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"ecg_map", "two_level_map", "lanczos_map", "pcg_residuals"}))
def test_others_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_users_beyond_the_sphere(spark, con, tmp_path):
    """At nside 16 a map has 3,072 pixels; larger tables have more users."""
    con.execute(f"COPY (SELECT * REPLACE (user_id * 997 % 7000 AS user_id) FROM events) TO '{tmp_path}/events.parquet'")
    beyond = duckdb.connect()
    beyond.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert beyond.execute("SELECT count(*) FROM events WHERE user_id >= 3072").fetchone()[0]
    want = beyond.execute(f"SELECT pix, value FROM ({ORACLE['fits_round_trip']})").fetchall()
    assert rows(QUERIES["fits_round_trip"](spark, str(tmp_path)).select("pix", "value").collect()) == rows(want)


def test_more_templates_than_the_driver_holds(spark, con, monkeypatch):
    """The query goes on with vectors as tables."""
    from skyloom.operators import solver
    from skyloom.plans import queries

    monkeypatch.setattr(solver, "DRIVER_FACTORS", 1)
    monkeypatch.setattr(queries, "_samples", lambda *a, own=queries._samples: own(*a).filter("t < 100"))
    found = queries._marginalised(spark, SF, 7.0, solver.Templates(1, 2, 0, 1), 50).collect()
    assert found and all(r.solved == 1 for r in found)


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"pix", "hits", "rcond", "i", "q", "u"}


def test_maps_of_the_tables_are_dense_ones(spark):
    """The numbers of the map that ``pcg_map`` judges, and of the system with templates, against dense algebra."""
    import numpy as np
    from pyspark.sql import functions as F

    from skyloom.functions import numeric
    from skyloom.operators import pointing, solver
    from skyloom.plans import queries

    rows, inverse = queries._solvable(spark, SF)
    rows = rows.withColumn("sweep", F.floor(F.col("t") / 101).cast("int")).withColumn("hwp_angle", F.col("t") / 100.0)
    table = rows.toPandas().sort_values(["block_id", "t"]).reset_index(drop=True)
    pixels = np.sort(table["pix"].unique())
    a = np.zeros((len(table), 3 * len(pixels)))
    for s, w in enumerate(pointing.WEIGHTS):
        a[np.arange(len(table)), 3 * np.searchsorted(pixels, table["pix"]) + s] = table[w]
    d, how = table["value"].to_numpy(), solver.Templates(4, 0, 2, 130)
    banded, filtered = np.zeros((len(d), len(d))), np.zeros((len(d), len(d)))
    for _, own in table.groupby("block_id"):
        at = own.index.to_numpy()
        banded[np.ix_(at, at)] = numeric.dense_toeplitz(np.array([10.0, 2, 3]), len(at))
        classes, bins = how.expand({c: own[c].to_numpy() for c in ("t", "sweep", "hwp_angle")})
        t = np.zeros((len(at), bins))
        for bin_, w in classes:
            t[np.arange(len(at)), bin_] += w
        u, size, _ = np.linalg.svd(t / np.maximum(np.linalg.norm(t, axis=0), 1e-300), full_matrices=False)
        u = u[:, size > 1e-10]
        filtered[np.ix_(at, at)] = np.eye(len(at)) - u @ u.T
    jacobi = solver.BlockJacobi(inverse, pixels)
    plain = solver.NormalOperator(rows, queries._noise_rows(spark, SF, [10, 2, 3]), 3, remove_mean=False)
    found = solver.pcg(plain, jacobi, 1e-10, 60).x
    assert np.allclose(found, np.linalg.lstsq(a.T @ banded @ a, a.T @ banded @ d, rcond=None)[0], rtol=1e-6, atol=1e-6 * np.abs(found).max())
    marginal = solver.NormalOperator(rows, queries._noise_rows(spark, SF, [1.0]), 1, templates=how)
    x = np.random.default_rng(3).normal(size=a.shape[1])
    assert np.allclose(marginal.apply(x), a.T @ filtered @ (a @ x), atol=1e-5 * np.linalg.norm(x))
    assert np.allclose(marginal.right_hand_side(), a.T @ filtered @ d, atol=1e-6 * np.linalg.norm(d) * 10)
