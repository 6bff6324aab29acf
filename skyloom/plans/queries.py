"""Queries over the driver's tables, each with the same result in SQL where SQL has one.

Values are exact integers divided once at the end where possible, so sums in any order agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyloom.functions import numeric
from skyloom.operators import flags, index_sets, noise, pixel_blocks, pointing, solver, table_solver, template_fit, templates, toeplitz
from skyloom.sources import readers, sinks
from skyloom.sources.staging import shared_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Samples in SQL, as readers.event_samples makes them.
_BASE = """
WITH ev AS (SELECT event_id, event_id AS row, event_type AS block_id, user_id AS user_pix, user_id * 24 + hour(ts) AS hour_pix, CAST(1 AS BIGINT) AS w_i,
  CAST([1, 0, -1, 0][event_id % 4 + 1] AS BIGINT) AS w_q, CAST([0, 1, 0, -1][event_id % 4 + 1] AS BIGINT) AS w_u,
  CAST(round(value * 100) AS BIGINT) AS d, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events),
s AS (SELECT *, {pix} AS pix FROM ev),
blocks AS (SELECT pix, count(*) AS hits, CAST(sum(w_i * w_i) AS BIGINT) AS b_ii, CAST(sum(w_i * w_q) AS BIGINT) AS b_iq, CAST(sum(w_i * w_u) AS BIGINT) AS b_iu,
  CAST(sum(w_q * w_q) AS BIGINT) AS b_qq, CAST(sum(w_q * w_u) AS BIGINT) AS b_qu, CAST(sum(w_u * w_u) AS BIGINT) AS b_uu FROM s GROUP BY pix),
rhs AS (SELECT pix, CAST(sum(w_i * d) AS BIGINT) AS i, CAST(sum(w_q * d) AS BIGINT) AS q, CAST(sum(w_u * d) AS BIGINT) AS u FROM s GROUP BY pix),
adj AS (SELECT *, b_qq * b_uu - b_qu * b_qu AS aa, b_iu * b_qu - b_iq * b_uu AS ab, b_iq * b_qu - b_iu * b_qq AS ac,
  b_ii * b_uu - b_iu * b_iu AS ad, b_iq * b_iu - b_ii * b_qu AS ae, b_ii * b_qq - b_iq * b_iq AS af FROM blocks),
cond AS (SELECT *, det, CASE WHEN det = 0 THEN 0.0 ELSE CAST(abs(det) AS DOUBLE) / CAST(
  greatest(abs(b_ii) + abs(b_iq) + abs(b_iu), abs(b_iq) + abs(b_qq) + abs(b_qu), abs(b_iu) + abs(b_qu) + abs(b_uu)) *
  greatest(abs(aa) + abs(ab) + abs(ac), abs(ab) + abs(ad) + abs(ae), abs(ac) + abs(ae) + abs(af)) AS DOUBLE) END AS rcond
  FROM (SELECT *, b_ii * aa + b_iq * ab + b_iu * ac AS det FROM adj))
"""


def query(sql: str | None = None, pix: str = "user_pix"):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = _BASE.replace("{pix}", pix) + sql if "FROM" in sql and not sql.lstrip().startswith("--") else sql
        return f

    return add


def _samples(spark: SparkSession, sf_dir: str, pix: Column | None = None) -> DataFrame:
    return readers.event_samples(spark, sf_dir, pix)


def _pointing(spark: SparkSession, sf_dir: str, pix: Column | None = None) -> DataFrame:
    return readers.event_pointing(spark, sf_dir, pix)


def _sky(rows: DataFrame) -> DataFrame:
    return rows.select("pix").distinct().select("pix", (F.col("pix") % 7).alias("i"), (F.col("pix") % 5).alias("q"), (F.col("pix") % 3).alias("u"))


def _rounded(value: str, digits: int) -> Column:
    """What floating sums in another order agree on; no negative zero."""
    return F.round(value, digits) + F.lit(0.0)


_SKY = ", sky AS (SELECT DISTINCT pix, pix % 7 AS i, pix % 5 AS q, pix % 3 AS u FROM s)"


# pixel blocks and the binned map ------------------------------------------------------------------------------------


@query("SELECT pix, hits FROM blocks")
def hits_map(spark, sf_dir):
    return pointing.weight_blocks(_pointing(spark, sf_dir)).select("pix", "hits")


@query("SELECT * FROM blocks", "hour_pix")
def weight_blocks(spark, sf_dir):
    return pointing.weight_blocks(_pointing(spark, sf_dir, readers.pixel_of_user_hour()))


@query("SELECT * FROM rhs")
def at_d(spark, sf_dir):
    return pointing.scatter(_pointing(spark, sf_dir), "d")


@query("""SELECT pix, hits, rcond, CAST(aa * i + ab * q + ac * u AS DOUBLE) / det AS i, CAST(ab * i + ad * q + ae * u AS DOUBLE) / det AS q,
  CAST(ac * i + ae * q + af * u AS DOUBLE) / det AS u FROM cond JOIN rhs USING (pix) WHERE rcond > 0.1""")
def binned_map_iqu(spark, sf_dir):
    return pixel_blocks.solved_rows(pointing.sums(_pointing(spark, sf_dir), "d"))


@query("SELECT pix, hits, rcond FROM cond", "hour_pix")
def rcond_map(spark, sf_dir):
    return pixel_blocks.with_rcond(pointing.weight_blocks(_pointing(spark, sf_dir, readers.pixel_of_user_hour()))).select("pix", "hits", "rcond")


@query("SELECT pix, hits FROM cond WHERE rcond <= 0.1", "hour_pix")
def degenerate_pixels(spark, sf_dir):
    return pixel_blocks.degenerate(pointing.weight_blocks(_pointing(spark, sf_dir, readers.pixel_of_user_hour()))).select("pix", "hits")


@query("SELECT row, CASE WHEN rcond <= 0.1 THEN -1 ELSE pix END AS pix, CASE WHEN rcond <= 0.1 THEN 0.0 ELSE CAST(d AS DOUBLE) END AS signal FROM s JOIN cond USING (pix)", "hour_pix")
def degenerate_cut(spark, sf_dir):
    rows = _pointing(spark, sf_dir, readers.pixel_of_user_hour())
    bad = pixel_blocks.degenerate(pointing.weight_blocks(rows))
    return pixel_blocks.without_degenerate(rows.withColumn("signal", F.col("d").cast("double")), bad).select("row", "pix", "signal")


@query("""SELECT pix, hits, rcond, CAST(aa AS DOUBLE) / det AS m_ii, CAST(ab AS DOUBLE) / det AS m_iq, CAST(ac AS DOUBLE) / det AS m_iu,
  CAST(ad AS DOUBLE) / det AS m_qq, CAST(ae AS DOUBLE) / det AS m_qu, CAST(af AS DOUBLE) / det AS m_uu FROM cond WHERE rcond > 0.1""")
def block_jacobi(spark, sf_dir):
    return pixel_blocks.inverse(pointing.weight_blocks(_pointing(spark, sf_dir)))


@query("SELECT pix, CASE WHEN b_ii <> 0 THEN 1.0 / b_ii ELSE 0.0 END AS i, CASE WHEN b_qq <> 0 THEN 1.0 / b_qq ELSE 0.0 END AS q, CASE WHEN b_uu <> 0 THEN 1.0 / b_uu ELSE 0.0 END AS u FROM blocks", "hour_pix")
def diagonal_jacobi(spark, sf_dir):
    return pixel_blocks.diagonal(pointing.weight_blocks(_pointing(spark, sf_dir, readers.pixel_of_user_hour())))


_BLOCK_WEIGHT = "length(block_id) % 3 + 1"


@query(f""", wb AS (SELECT pix, count(*) AS hits, CAST(sum(w_i * w_i * w) AS BIGINT) AS b_ii, CAST(sum(w_i * w_q * w) AS BIGINT) AS b_iq, CAST(sum(w_i * w_u * w) AS BIGINT) AS b_iu,
  CAST(sum(w_q * w_q * w) AS BIGINT) AS b_qq, CAST(sum(w_q * w_u * w) AS BIGINT) AS b_qu, CAST(sum(w_u * w_u * w) AS BIGINT) AS b_uu,
  CAST(sum(w_i * d * w) AS BIGINT) AS i, CAST(sum(w_q * d * w) AS BIGINT) AS q, CAST(sum(w_u * d * w) AS BIGINT) AS u FROM (SELECT *, {_BLOCK_WEIGHT} AS w FROM s) GROUP BY pix)
SELECT pix, hits, CAST((b_qq * b_uu - b_qu * b_qu) * i + (b_iu * b_qu - b_iq * b_uu) * q + (b_iq * b_qu - b_iu * b_qq) * u AS DOUBLE)
  / (b_ii * (b_qq * b_uu - b_qu * b_qu) + b_iq * (b_iu * b_qu - b_iq * b_uu) + b_iu * (b_iq * b_qu - b_iu * b_qq)) AS i FROM wb
WHERE b_ii * (b_qq * b_uu - b_qu * b_qu) + b_iq * (b_iu * b_qu - b_iq * b_uu) + b_iu * (b_iq * b_qu - b_iu * b_qq) <> 0""")
def diag_weighted_map(spark, sf_dir):
    rows = _pointing(spark, sf_dir).withColumn("w", F.length("block_id") % 3 + 1)
    return pixel_blocks.solved_rows(pointing.sums(rows, "d", F.col("w")), cut=0.0).select("pix", "hits", "i")


@query("SELECT pix, grp, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY pix) AS z FROM (SELECT pix, row % 4 AS grp, count(*) AS n FROM s GROUP BY 1, 2)")
def deflation_z(spark, sf_dir):
    return pixel_blocks.hit_shares(_pointing(spark, sf_dir), F.col("row") % 4)


@query("SELECT r.pix, coalesce(b.hits, 0) AS hits, coalesce(x.i, 0) AS i FROM (SELECT range AS pix FROM range(3072)) r LEFT JOIN blocks b USING (pix) LEFT JOIN rhs x USING (pix)")
def full_sky_fill(spark, sf_dir):
    return pixel_blocks.full_sky(pointing.sums(_pointing(spark, sf_dir), "d").select("pix", "hits", "i"), 12 * 16**2, ["hits", "i"])


@query("SELECT pix, hits, rcond, CAST(aa * i + ab * q + ac * u AS DOUBLE) / det AS i FROM cond JOIN rhs USING (pix) WHERE rcond > 0.1")
def map_parts_round_trip(spark, sf_dir):
    """Binary parts of a map, written by ranges of pixels and read back."""
    path = shared_path(spark, "parts")
    sinks.write_map_parts(pixel_blocks.solved_rows(pointing.sums(_pointing(spark, sf_dir), "d")), path, 3)
    return readers.map_parts(spark, path).select("pix", "hits", "rcond", "i")


@query("SELECT r.pix, CAST(coalesce(b.hits, 0) AS DOUBLE) AS value FROM (SELECT range AS pix FROM range(3072)) r LEFT JOIN blocks b USING (pix)")
def fits_round_trip(spark, sf_dir):
    """A map over the sphere as FITS, read back in stretches. Users beyond the sphere's 3,072 pixels have no place on it."""
    path = shared_path(spark, "fits")
    rows = _pointing(spark, sf_dir).filter(F.col("pix") < 12 * 16**2)
    sinks.write_fits(pointing.weight_blocks(rows), "hits", path, "Hits.fits", 16)
    return readers.fits_map(spark, f"{path}/Hits.fits", 1000)


@query("SELECT j, col, CAST(val AS DOUBLE) AS val, count(*) AS n FROM (SELECT 0 AS j, 3 * pix AS col, w_i AS val FROM s UNION ALL SELECT 1, 3 * pix + 1, w_q FROM s UNION ALL SELECT 2, 3 * pix + 2, w_u FROM s) GROUP BY 1, 2, 3")
def ell_round_trip(spark, sf_dir):
    """The pointing matrix as ASCII lines, read back."""
    path = shared_path(spark, "ell")
    sinks.write_ell(pointing.to_wide(pointing.to_long(_pointing(spark, sf_dir))), path)
    return readers.ell(spark, path).groupBy("j", "col", "val").agg(F.count(F.lit(1)).alias("n"))


# pointing products ---------------------------------------------------------------------------------------------------


@query(_SKY + " SELECT row, w_i * i + w_q * q + w_u * u AS y FROM s JOIN sky USING (pix)")
def unpoint_ax(spark, sf_dir):
    rows = _pointing(spark, sf_dir)
    return pointing.project(rows, _sky(rows)).select("row", "y")


@query(_SKY + " SELECT row, CASE WHEN row % 5 = 0 THEN 0 ELSE w_i * i + w_q * q + w_u * u END AS y FROM s JOIN sky USING (pix)")
def unpoint_flagged(spark, sf_dir):
    rows = _pointing(spark, sf_dir)
    return pointing.project(flags.masked(rows, F.col("row") % 5 == 0), _sky(rows)).select("row", "y")


@query(_SKY + """, y AS (SELECT pix, w_i, w_q, w_u, w_i * i + w_q * q + w_u * u AS y FROM s JOIN sky USING (pix))
SELECT pix, CAST(sum(w_i * y) AS BIGINT) AS i, CAST(sum(w_q * y) AS BIGINT) AS q, CAST(sum(w_u * y) AS BIGINT) AS u FROM y GROUP BY pix""")
def at_a_x(spark, sf_dir):
    rows = _pointing(spark, sf_dir)
    return pointing.normal(rows, _sky(rows), F.lit(1))


@query("SELECT row, 0 AS j, 3 * pix AS col, w_i AS val FROM s UNION ALL SELECT row, 1, 3 * pix + 1, w_q FROM s UNION ALL SELECT row, 2, 3 * pix + 2, w_u FROM s")
def ell_to_coo(spark, sf_dir):
    return pointing.to_long(_pointing(spark, sf_dir))


def _lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").cast("long").alias("val"))


@query("--\nSELECT l_orderkey AS row, CAST(sum(CAST(l_quantity AS BIGINT) * (l_suppkey % 11)) AS BIGINT) AS y FROM lineitem GROUP BY 1")
def lineitem_ax(spark, sf_dir):
    coo = _lineitem(spark, sf_dir)
    return pointing.multiply(coo, coo.select("col").distinct().withColumn("x", F.col("col") % 11))


@query("--\nSELECT l_suppkey AS col, CAST(sum(CAST(l_quantity AS BIGINT) * (l_orderkey % 13)) AS BIGINT) AS x FROM lineitem GROUP BY 1")
def lineitem_aty(spark, sf_dir):
    coo = _lineitem(spark, sf_dir)
    return pointing.multiply_transposed(coo, coo.select("row").distinct().withColumn("y", F.col("row") % 13))


_LEVELS = """--
WITH m AS (SELECT 0 AS level, l_orderkey AS row, l_suppkey AS col, CAST(l_quantity AS BIGINT) AS val FROM lineitem UNION ALL SELECT 1, l_partkey, l_suppkey, l_linenumber FROM lineitem)
"""


def _levels(spark, sf_dir):
    more = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_linenumber").cast("long").alias("val"))
    return pointing.stacked([_lineitem(spark, sf_dir), more])


@query(_LEVELS + "SELECT level, row, CAST(sum(val * (col % 11)) AS BIGINT) AS y FROM m GROUP BY 1, 2")
def composite_ax(spark, sf_dir):
    coo = _levels(spark, sf_dir)
    return pointing.multiply_stacked(coo, coo.select("col").distinct().withColumn("x", F.col("col") % 11))


@query(_LEVELS + "SELECT col, CAST(sum(val * (row % 13 + level)) AS BIGINT) AS x FROM m GROUP BY 1")
def composite_aty(spark, sf_dir):
    coo = _levels(spark, sf_dir)
    return pointing.multiply_stacked_transposed(coo, coo.select("level", "row").distinct().withColumn("y", F.col("row") % 13 + F.col("level")))


@query("--\nSELECT count(DISTINCT l_orderkey) AS rows, count(*) AS entries, count(DISTINCT l_suppkey) AS columns, CAST(0 AS BIGINT) AS flagged FROM lineitem")
def matrix_info(spark, sf_dir):
    return pointing.describe(_lineitem(spark, sf_dir))


# index sets ----------------------------------------------------------------------------------------------------------


def _sets(spark, sf_dir):
    p = _pointing(spark, sf_dir)
    return p.filter("event_id % 3 = 0").select("pix"), p.filter("event_id % 5 < 2").select("pix")


_AB = ", a AS (SELECT DISTINCT pix FROM s WHERE event_id % 3 = 0), b AS (SELECT DISTINCT pix FROM s WHERE event_id % 5 < 2)"


@query(_AB + " SELECT pix FROM a UNION SELECT pix FROM b")
def set_or(spark, sf_dir):
    return index_sets.union(*_sets(spark, sf_dir), "pix")


@query(_AB + " SELECT pix FROM a INTERSECT SELECT pix FROM b")
def set_and(spark, sf_dir):
    return index_sets.intersection(*_sets(spark, sf_dir), "pix")


@query(" SELECT count(DISTINCT pix) AS n FROM s", "hour_pix")
def set_card(spark, sf_dir):
    return index_sets.cardinality(_pointing(spark, sf_dir, readers.pixel_of_user_hour()), "pix")


@query(" SELECT pix, row_number() OVER (ORDER BY pix) - 1 AS position FROM (SELECT DISTINCT pix FROM s)", "hour_pix")
def sort_distinct(spark, sf_dir):
    return index_sets.sorted_distinct(_pointing(spark, sf_dir, readers.pixel_of_user_hour()), "pix")


@query(_AB + " SELECT pix, position FROM (SELECT pix, row_number() OVER (ORDER BY pix) - 1 AS position FROM a) WHERE pix IN (SELECT pix FROM b)")
def map_and(spark, sf_dir):
    return index_sets.positions_of_common(*_sets(spark, sf_dir), "pix")


@query(" SELECT row, s.pix, position FROM s JOIN (SELECT pix, row_number() OVER (ORDER BY pix) - 1 AS position FROM (SELECT DISTINCT pix FROM s)) USING (pix)")
def reindex(spark, sf_dir):
    rows = _pointing(spark, sf_dir)
    return index_sets.reindexed(rows.select("row", "pix"), "pix", index_sets.sorted_distinct(rows, "pix")).select("row", "pix", "position")


@query(_AB + " SELECT a.pix, CAST(CASE WHEN b.pix IS NULL THEN a.pix % 7 ELSE a.pix % 5 END AS BIGINT) AS v FROM a LEFT JOIN b ON a.pix = b.pix")
def merge_copy(spark, sf_dir):
    a, b = (x.distinct() for x in _sets(spark, sf_dir))
    return index_sets.copied(a.withColumn("v", F.col("pix") % 7), b.withColumn("v", F.col("pix") % 5), "pix", "v")


@query(_AB + " SELECT a.pix, CAST(a.pix % 7 + CASE WHEN b.pix IS NULL THEN 0 ELSE a.pix % 5 END AS BIGINT) AS v FROM a LEFT JOIN b ON a.pix = b.pix")
def merge_sum(spark, sf_dir):
    a, b = (x.distinct() for x in _sets(spark, sf_dir))
    return index_sets.added(a.withColumn("v", F.col("pix") % 7), b.withColumn("v", F.col("pix") % 5), "pix", "v")


@query(" SELECT pix, CAST(sum(d) AS BIGINT) AS d FROM s GROUP BY pix")
def scatter_sum(spark, sf_dir):
    return index_sets.scattered_sum(_pointing(spark, sf_dir), "pix", "d")


@query(" SELECT row, d FROM (SELECT row, d, lag(d) OVER (PARTITION BY block_id ORDER BY t) AS p FROM s) WHERE d < p")
def order_check(spark, sf_dir):
    return index_sets.out_of_order(_samples(spark, sf_dir), "d", ["t"], ["block_id"]).select("row", "d")


@query(" SELECT pix, max(row) AS last_row, count(*) AS samples FROM s GROUP BY pix")
def pix_to_last_sample(spark, sf_dir):
    return index_sets.last_samples(_pointing(spark, sf_dir))


# Toeplitz ------------------------------------------------------------------------------------------------------------


def _toeplitz_sql(row: list[int], source: str = "s") -> str:
    terms = " + ".join([f"{row[0]} * d"] + [f"{r} * (coalesce(lag(d, {k}) OVER w, 0) + coalesce(lead(d, {k}) OVER w, 0))" for k, r in enumerate(row) if k])
    return f"SELECT block_id, t, CAST({terms} AS BIGINT) AS y FROM {source} WINDOW w AS (PARTITION BY block_id ORDER BY t)"


@query(_toeplitz_sql([10, 2, 3]))
def toeplitz_lag3(spark, sf_dir):
    return toeplitz.narrow_product(_samples(spark, sf_dir), "d", [10, 2, 3]).select("block_id", "t", "y")


@query(_toeplitz_sql([2, -1]))
def toeplitz_second_difference(spark, sf_dir):
    return toeplitz.narrow_product(_samples(spark, sf_dir), "d", [2, -1, 0]).select("block_id", "t", "y")


_GAPPY = ", z AS (SELECT block_id, t, row, CASE WHEN row % 100 >= 40 AND row % 100 < 47 THEN 0 ELSE d END AS d FROM s), p AS (" + _toeplitz_sql([10, 2, 3], "z").replace("t, CAST", "t, row, CAST") + ")"


def _gaps(rows: DataFrame, every: int = 100, at: int = 40, length: int = 7) -> DataFrame:
    """Gaps of ``length`` rows in each hundred."""
    return rows.select((F.floor(F.col("row") / every) * every + at).alias("id0")).distinct().withColumn("len", F.lit(length))


@query(_GAPPY + " SELECT block_id, t, CASE WHEN row % 100 >= 40 AND row % 100 < 47 THEN 0 ELSE y END AS y FROM p")
def toeplitz_gappy(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    return toeplitz.gappy_product(rows, _gaps(rows), [10, 2, 3], "d").select("block_id", "t", "y")


@query(" SELECT row, CASE WHEN row % 100 >= 40 AND row % 100 < 47 THEN 0 ELSE d END AS d FROM s")
def gap_reset(spark, sf_dir):
    rows = _pointing(spark, sf_dir)
    return flags.gaps_reset(rows, _gaps(rows), "d").select("row", "d")


@query(" SELECT block_id, row, row_number() OVER (PARTITION BY block_id ORDER BY row) - 1 AS packed, d FROM s WHERE NOT (row % 100 >= 40 AND row % 100 < 47)")
def gap_mask(spark, sf_dir):
    rows = _pointing(spark, sf_dir)
    return flags.gaps_dropped(rows, _gaps(rows), by=["block_id"]).select("block_id", "row", "packed", "d")


@query(" SELECT row, CASE WHEN row % 100 >= 40 AND row % 100 < 47 THEN 0 ELSE d END AS d FROM s")
def gap_fill(spark, sf_dir):
    rows = _pointing(spark, sf_dir)
    return flags.gaps_filled(flags.gaps_dropped(rows, _gaps(rows), by=["block_id"]), rows, "d")


@query(" SELECT row, CASE WHEN row % 100 >= 40 AND row % 100 < 47 THEN 0 ELSE d END AS d FROM s WHERE NOT (row % 100 >= 43 AND row % 100 < 47)")
def gap_reduce(spark, sf_dir):
    rows = _pointing(spark, sf_dir)
    return flags.gaps_reduced(rows, _gaps(rows), 3, "d").select("row", "d")


@query(" SELECT block_id, t, round(d - avg(d) OVER (PARTITION BY block_id), 6) + 0.0 AS y FROM s")
def block_mean_removed(spark, sf_dir):
    return toeplitz.mean_removed(_samples(spark, sf_dir), "d").select("block_id", "t", _rounded("d", 6).alias("y"))


@query(f" SELECT block_id, t, CAST(({_BLOCK_WEIGHT}) * d AS BIGINT) AS y FROM s")
def diagonal_weights(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    weights = rows.select("block_id").distinct().withColumn("t", F.array((F.length("block_id") % 3 + 1).cast("long")))
    return toeplitz.diagonal_product(rows, weights, "d").select("block_id", rows["t"], "y")


@query(" SELECT block_id, count(*) AS n, min(row) AS first_row FROM s GROUP BY block_id")
def block_sizes(spark, sf_dir):
    return flags.block_sizes(_pointing(spark, sf_dir))


def _noise_rows(spark, sf_dir, row: list[float]) -> DataFrame:
    return _pointing(spark, sf_dir).select("block_id").distinct().withColumn("t", F.array(*map(F.lit, map(float, row))))


@query(""" SELECT a.block_id, a.t, round(sum(10.0 / (1 + abs(a.t - b.t)) * b.d), 3) + 0.0 AS y
  FROM s a JOIN s b ON a.block_id = b.block_id AND b.t BETWEEN a.t - 63 AND a.t + 63 GROUP BY 1, 2""")
def toeplitz_fft(spark, sf_dir):
    row = [float(10 / (1 + k)) for k in range(64)]
    out = toeplitz.wide_product(_samples(spark, sf_dir), _noise_rows(spark, sf_dir, row), "d", chunk=4096)
    return out.select("block_id", "t", _rounded("y", 3).alias("y"))


# flags, sweeps, scan ---------------------------------------------------------------------------------------------------


@query(" SELECT row, CASE WHEN (event_id % 16) & 5 <> 0 OR (event_id % 8) & 2 <> 0 THEN -1 ELSE pix END AS pix FROM s")
def flag_mask(spark, sf_dir):
    return flags.masked(_pointing(spark, sf_dir), flags.flagged(F.col("event_id") % 16, 5, F.col("event_id") % 8, 2)).select("row", "pix")


def _scan(spark, sf_dir):
    return _samples(spark, sf_dir).select(F.col("block_id").alias("obs_id"), "t", (F.col("event_id") % 16).cast("int").alias("flags"), "event_id")


@query(""" SELECT obs_id, t, CAST(sum(edge) OVER (PARTITION BY obs_id ORDER BY t) AS INT) AS sweep FROM (
  SELECT block_id AS obs_id, t, CASE WHEN p IS NOT NULL AND (p & f) < 8 AND f >= 8 THEN 1 ELSE 0 END AS edge FROM (
    SELECT block_id, t, event_id % 16 AS f, lag(event_id % 16) OVER (PARTITION BY block_id ORDER BY t) AS p FROM s))""")
def sweep_segments(spark, sf_dir):
    return flags.scan_sweeps(_scan(spark, sf_dir)).select("obs_id", "t", "sweep")


@query(" SELECT block_id AS obs_id, CAST(t // 250 AS INT) AS sweep, min(t) AS t0, max(t) AS t1 FROM s GROUP BY 1, 2")
def sweep_fixed(spark, sf_dir):
    return flags.sweep_bounds(flags.fixed_sweeps(_scan(spark, sf_dir), 10.0, 25.0))


@query(" SELECT row, CAST(d AS DOUBLE) * 0.5 AS signal, CAST(d AS DOUBLE) / 2.0 AS noise FROM s WHERE length(block_id) < 6")
def scaled_samples(spark, sf_dir):
    rows = _pointing(spark, sf_dir).select("row", F.length("block_id").alias("det"), F.col("d").cast("double").alias("signal"), F.col("d").cast("double").alias("noise"))
    return flags.scaled(flags.detectors(rows, 6), 0.5, 4.0).select("row", "signal", "noise")


# templates ---------------------------------------------------------------------------------------------------------------

_SWEEP = 101


def _swept(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("sweep", F.floor(F.col("t") / _SWEEP).cast("int"))
    bounds = flags.sweep_bounds(rows, "block_id")
    count = bounds.groupBy("block_id").agg(F.max("sweep").alias("_last"))
    return rows.join(bounds, ["block_id", "sweep"]).join(count, "block_id").withColumn("n_sweeps", F.col("_last") + 1)


_LEG = """, l AS (SELECT block_id, t, 2 * (t - t0) - n AS a, n FROM (SELECT block_id, t, min(t) OVER w AS t0, max(t) OVER w - min(t) OVER w AS n FROM s WINDOW w AS (PARTITION BY block_id, t // 101)))"""


_POLYNOMIALS = ("CAST(1.0 AS DOUBLE)", "x", "(3 * x * x - 1) / 2", "(5 * x * x * x - 3 * x) / 2")
_X = ", x AS (SELECT block_id, t, CASE WHEN n > 0 THEN CAST(a AS DOUBLE) / n ELSE 0.0 END AS x, CAST(t // 101 AS INT) AS sweep, CAST(max(t // 101) OVER (PARTITION BY block_id) AS INT) + 1 AS n_sweeps FROM l)"


def _add_legendre() -> None:
    for k, value in enumerate(_POLYNOMIALS):
        def run(spark, sf_dir, k=k):
            rows = _swept(spark, sf_dir)
            w = templates.legendre_column(k, templates.sweep_position(F.col("t"), F.col("t0"), F.col("t1")))
            return rows.withColumn("w", w).select("block_id", "t", _rounded("w", 9).alias("w"))

        run.__name__ = f"legendre_p{k}"
        query(_LEG + _X + f" SELECT block_id, t, round({value}, 9) + 0.0 AS w FROM x")(run)


_add_legendre()


@query(_LEG + _X + " " + " UNION ALL ".join(f"SELECT block_id, t, CAST({k} * n_sweeps + sweep AS INT) AS bin, round({value}, 9) + 0.0 AS w FROM x" for k, value in enumerate(_POLYNOMIALS)))
def polynomial_templates(spark, sf_dir):
    return templates.polynomials(_swept(spark, sf_dir), 4).select("block_id", "t", "bin", _rounded("w", 9).alias("w"))


@query(" SELECT block_id, t, CAST(least(9, (d - lo) * 10 // (hi - lo)) AS INT) AS bin FROM (SELECT block_id, t, d, min(d) OVER w AS lo, max(d) OVER w AS hi FROM s WINDOW w AS (PARTITION BY block_id))")
def az_bins(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("az", F.col("d"))
    return templates.scan_synchronous(rows.join(templates.azimuth_range(rows, "block_id"), "block_id"), 10).select("block_id", "t", "bin")


@query(" SELECT block_id AS obs_id, min(d) AS az_min, max(d) AS az_max FROM s GROUP BY 1")
def az_range(spark, sf_dir):
    return templates.azimuth_range(_samples(spark, sf_dir).select(F.col("block_id").alias("obs_id"), F.col("d").alias("az")))


@query(" SELECT block_id, t, CAST(t // 400 AS INT) AS bin FROM s")
def hwp_bins(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("hwp_angle", F.lit(0.0))
    return templates.plate_synchronous(rows, 1, 400, 1 << 20).filter(f"bin < {1 << 20}").select("block_id", "t", "bin")


_T = ", tm AS (SELECT block_id, t, CAST(t // 101 AS INT) AS bin, CAST(1 AS BIGINT) AS w, d FROM s UNION ALL SELECT block_id, t, CAST(100000 + event_id % 6 AS INT), 1 + event_id % 2, d FROM s)"


def _exact_templates(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    return rows, _templates_of(rows)


def _templates_of(rows: DataFrame) -> DataFrame:
    base = rows.select("block_id", "t", F.floor(F.col("t") / _SWEEP).cast("int").alias("bin"), F.lit(1).cast("long").alias("w"))
    return base.unionByName(rows.select("block_id", "t", (F.lit(100000) + F.col("event_id") % 6).cast("int").alias("bin"), (1 + F.col("event_id") % 2).alias("w")))


@query(_T + " SELECT block_id, bin, CAST(sum(w * d) AS BIGINT) AS amp FROM tm GROUP BY 1, 2")
def template_amps(spark, sf_dir):
    rows, table = _exact_templates(spark, sf_dir)
    return templates.scatter(table, rows, "d")


@query(_T + " SELECT x.block_id, x.bin AS a, y.bin AS b, CAST(sum(x.w * y.w) AS BIGINT) AS k FROM tm x JOIN tm y ON x.block_id = y.block_id AND x.t = y.t GROUP BY 1, 2, 3")
def template_kernel(spark, sf_dir):
    return templates.kernel(_exact_templates(spark, sf_dir)[1])


@query(_T + " SELECT block_id, t, CAST(sum(w * (bin % 9)) AS BIGINT) AS y FROM tm GROUP BY 1, 2")
def template_project(spark, sf_dir):
    table = _exact_templates(spark, sf_dir)[1]
    return templates.project(table, table.select("block_id", "bin").distinct().withColumn("tau", (F.col("bin") % 9).cast("long")))


@query(_T + " SELECT DISTINCT block_id, bin, 1 AS fits FROM tm")
def template_filtered(spark, sf_dir):
    """Amplitudes of the templates that fit the data best: what they leave is orthogonal to every template."""
    rows = written(_samples(spark, sf_dir).select("event_id", "block_id", "t", "d"), "samples")
    table = _templates_of(rows)
    right = written(templates.scatter(table, rows, "d"), "amplitudes")
    fit = template_fit.factored(template_fit.packed(table), template_fit.packed_entries)
    tau = written(template_fit.fitted(fit, right), "fitted")
    left = rows.join(templates.project(table, tau), ["block_id", "t"]).withColumn("left", F.col("d") - F.col("y"))
    both = templates.scatter(table, left, "left").join(right.select("block_id", "bin", F.col("amp").alias("whole")), ["block_id", "bin"])
    return both.select("block_id", "bin", (F.abs("amp") <= 1e-8 * (F.abs("whole") + 1e4)).cast("int").alias("fits"))


# estimation and solvers ---------------------------------------------------------------------------------------------------


@query(""", n AS (SELECT block_id, count(*) AS n, regr_slope(d, t) AS b, avg(d) AS dm, avg(t) AS tm FROM s GROUP BY 1),
v AS (SELECT block_id, t, n, (d - dm - b * (t - tm)) * (0.5 - 0.5 * cos(2 * pi() * t / n)) AS v, pow(0.5 - 0.5 * cos(2 * pi() * t / n), 2) AS w2 FROM s JOIN n USING (block_id)),
f AS (SELECT block_id, n, k, sum(v * cos(2 * pi() * (k * t % n) / n)) AS c, sum(v * sin(2 * pi() * (k * t % n) / n)) AS z, sum(w2) AS w FROM v, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2, 3)
SELECT block_id, CAST(k AS BIGINT) AS k, round(25.0 * k / n, 9) AS f, round(log10(2 * (c * c + z * z) / (25.0 * w)), 5) AS log_power FROM f WHERE 2 * k < n""")
def noise_psd(spark, sf_dir):
    """The first 64 frequencies of each block's periodogram, which has them all."""
    out = noise.spectra(_samples(spark, sf_dir), "d", 25.0)
    return out.filter("k BETWEEN 1 AND 64").select("block_id", "k", F.round("f", 9).alias("f"), F.round(F.log10("power"), 5).alias("log_power"))


@query()
def noise_inverse(spark, sf_dir):
    return noise.inverse_noise(_samples(spark, sf_dir), "d", 25.0, 32)


@query(" SELECT DISTINCT block_id, 1 AS fits FROM s")
def noise_inverse_fits(spark, sf_dir):
    """Whether each block's fitted model lies nearer to its spectrum, by sums in the table, than with any parameter a twentieth off (within its
    bounds)."""
    rows = written(_samples(spark, sf_dir), "samples")
    names, low, high = ("log_sigma2", "alpha", "knee", "fmin"), numeric.FIT_LOW, numeric.FIT_HIGH
    joined = noise.spectra(rows, "d", 25.0).filter("k > 0 AND power > 0").join(noise.inverse_noise(rows, "d", 25.0, 32).select("block_id", *names), "block_id")

    def misfit(moved: int | None, by: float = 1.0) -> Column:
        s, a, knee, fmin = (F.col(c) if k != moved else F.greatest(F.lit(low[k]), F.least(F.lit(high[k]), F.col(c) * by)) for k, c in enumerate(names))
        return F.sum(F.pow(s + F.log10(1 + F.pow((F.col("f") + fmin) / knee, a)) - F.log10("power"), 2))

    told = joined.groupBy("block_id").agg(misfit(None).alias("own"), F.least(*(misfit(k, by) for k in range(4) for by in (0.95, 1.05))).alias("others"))
    return told.select("block_id", (F.col("own") <= F.col("others") * (1 + 1e-9)).cast("int").alias("fits"))


@query(""" SELECT block_id, CAST(k AS BIGINT) AS k, round(abs(10 + 4 * cos(2 * pi() * k / 512) + 6 * cos(4 * pi() * k / 512)), 9) AS power
  FROM (SELECT DISTINCT block_id FROM s), (SELECT unnest(range(256)) AS k)""")
def noise_effective(spark, sf_dir):
    return noise.effective_spectra(_noise_rows(spark, sf_dir, [10, 2, 3]), 512).select("block_id", "k", F.round("power", 9).alias("power"))


def _solvable(spark, sf_dir):
    rows = written(_samples(spark, sf_dir).withColumn("value", F.col("d").cast("double")), "samples")
    return rows, pixel_blocks.inverse(pointing.weight_blocks(rows))


_SOLVED = " SELECT DISTINCT pix, 1 AS solved FROM s"


def _holds(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(pix, solved): whether a pixel's part of what a map leaves of the system is small against its whole right-hand side."""
    size = right.agg(F.sqrt(F.sum(sum((F.col(s) * F.col(s) for s in "iqu"), F.lit(0.0)))).alias("_size"))
    worst = F.greatest(*(F.abs(s) for s in "iqu"))
    return left.crossJoin(F.broadcast(size)).select("pix", (worst <= tolerance * F.col("_size")).cast("int").alias("solved"))  # one row


def _solve(spark, sf_dir, how: Callable) -> DataFrame:
    """Every pixel with whether the map solves A^T F (d - A x) = 0, by the table operators rather than the solver's own."""
    rows, inverse = _solvable(spark, sf_dir)
    op = solver.NormalOperator(rows, _noise_rows(spark, sf_dir, [10, 2, 3]), 3, remove_mean=False)
    sky = op.frame(how(op, solver.BlockJacobi(inverse, op.pixels), rows).x)
    weighted = lambda df, v: pointing.scatter(toeplitz.narrow_product(df, v, [10, 2, 3], "_f"), "_f")
    left = pointing.project(rows, sky, "_p").withColumn("_r", F.col("value") - F.col("_p"))
    return _holds(weighted(left, "_r"), weighted(rows, "value"))


@query(_SOLVED)
def pcg_map(spark, sf_dir):
    return _solve(spark, sf_dir, lambda op, m, rows: solver.pcg(op, m, 1e-8, 40))


@query(_SOLVED)
def ecg_map(spark, sf_dir):
    return _solve(spark, sf_dir, lambda op, m, rows: solver.enlarged_cg(op, m, 4, 1e-8, 40))


@query(_SOLVED)
def two_level_map(spark, sf_dir):
    return _solve(spark, sf_dir, lambda op, m, rows: solver.pcg(op, solver.TwoLevel(op, m, solver.a_priori_basis(rows, op, 4)), 1e-8, 40))


@query(_SOLVED)
def lanczos_map(spark, sf_dir):
    return _solve(spark, sf_dir, lambda op, m, rows: solver.pcg(op, solver.TwoLevel(op, m, solver.lanczos_basis(op, 4)), 1e-8, 40))


@query(" SELECT CAST(1.0 AS DOUBLE) AS first, 1 AS converged FROM s LIMIT 1")
def pcg_residuals(spark, sf_dir):
    rows, inverse = _solvable(spark, sf_dir)
    op = solver.NormalOperator(rows, _noise_rows(spark, sf_dir, [10, 2, 3]), 3, remove_mean=False)
    found = solver.pcg(op, solver.BlockJacobi(inverse, op.pixels), 1e-8, 40)
    told = spark.createDataFrame(pa.table({"iter": np.arange(len(found.residuals)), "res_rel": np.array(found.residuals)}))
    return told.agg(F.min_by("res_rel", "iter").alias("first"), (F.max_by("res_rel", "iter") <= 1e-8).cast("int").alias("converged"))


def _marginalised(spark, sf_dir, angle: float, how: solver.Templates, sweep: int) -> DataFrame:
    """Every pixel with whether the map that the solver's own expansion of templates leaves solves the system by templates as tables."""
    rows = _samples(spark, sf_dir).withColumn("value", F.col("d").cast("double")).withColumn("sweep", F.floor(F.col("t") / sweep).cast("int"))
    rows = written(rows.withColumn("az", F.sin(F.col("t") / 40.0)).withColumn("hwp_angle", F.col("t") / angle), "samples")
    inverse = pixel_blocks.inverse(pointing.weight_blocks(rows))
    weights = _noise_rows(spark, sf_dir, [1.0])
    try:
        op = solver.NormalOperator(rows, weights, 1, templates=how)
        sky = op.frame(solver.pcg(op, solver.BlockJacobi(inverse, op.pixels), 1e-8, 300).x)
    except solver.TooMany:
        sky = table_solver.pcg(table_solver.TableOperator(rows, weights, 1, templates=how), table_solver.TableJacobi(written(inverse, "inverse")), 1e-8, 300)[0]
    both = written(pointing.project(rows, sky, "_p").withColumn("left", F.col("value") - F.col("_p")), "left")
    samples = template_fit.packed_samples(templates.beside(both, how.orders, how.azimuth_bins, how.harmonics, how.plate_length), [*pointing.WEIGHTS, "left", "value"])
    fit = template_fit.factored(samples, template_fit.sample_entries)
    filtered = template_fit.left_over(samples, fit, ["left", "value"], [*pointing.WEIGHTS])  # both in one pass
    sums = [F.sum(F.col(w) * F.col(c)).alias(f"{c}_{s}") for c in ("left", "value") for w, s in zip(pointing.WEIGHTS, pointing.STOKES)]
    found = written(filtered.filter("pix >= 0").groupBy("pix").agg(*sums), "sums")
    return _holds(*(found.select("pix", *(F.col(f"{c}_{s}").alias(s) for s in pointing.STOKES)) for c in ("left", "value")))


@query(_SOLVED)
def mt_map(spark, sf_dir):
    return _marginalised(spark, sf_dir, 7.0, solver.Templates(2, 8, 1, 1000), 500)


@query(_SOLVED)
def mt_map_dependent(spark, sf_dir):
    """Templates that nearly depend on each other: two slow harmonics of the plate are nearly cubic over a sweep."""
    return _marginalised(spark, sf_dir, 500.0, solver.Templates(4, 0, 2, 130), 101)
