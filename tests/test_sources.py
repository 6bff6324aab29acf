"""Files in stretches, map files by executors, numbers and sums within groups over ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import flags, index_sets, toeplitz
from skyloom.sources import readers, sinks, stores


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    pix, signal = np.arange(3000, dtype="<u4").reshape(-1, 3), np.random.default_rng(1).normal(size=1000)
    (tmp_path / "pixels_0.dat").write_bytes(pix.tobytes() + b"xx")  # what doesn't make a row is left
    (tmp_path / "pixels_12.dat").write_bytes(pix[:10].tobytes())
    (tmp_path / "pixels_13.dat").write_bytes(b"")
    (tmp_path / "signal_0.dat").write_bytes(signal.tobytes())
    got = readers.raw(spark, str(tmp_path / "pixels_*.dat"), "pixels", rows=170)
    assert got.rdd.getNumPartitions() == 6 + 1
    rows = {(r.part, r.row): r["values"] for r in got.collect()}
    assert len(rows) == 1010 and all(rows[0, k] == pix[k].tolist() for k in range(1000)) and rows[12, 9] == pix[9].tolist()
    assert np.array_equal([r["values"][0] for r in readers.raw(spark, str(tmp_path / "signal_0.dat"), "signal", rows=999).orderBy("row").collect()], signal)
    assert readers.raw(spark, str(tmp_path / "none_*.dat"), "signal").count() == 0


def test_ascii_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [" ".join(f"{k % 7 + j} {k / 4 + j}" for j in range(k % 3)) for k in range(5000)]  # some are empty
    (tmp_path / "m_3.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "m_4.txt").write_text("5 1.5\n\n6 2.5 7 3.5")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.ell(spark, str(tmp_path / "m_*.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = [(3, k, j, k % 7 + j, k / 4 + j) for k in range(5000) for j in range(k % 3)] + [(4, 0, 0, 5, 1.5), (4, 2, 0, 6, 2.5), (4, 2, 1, 7, 3.5)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("cells", [7, 1 << 20])
def test_a_map_as_fits_piece_by_piece(monkeypatch, cells):
    monkeypatch.setattr(sinks, "CELLS", cells)
    pix, values = np.array([0, 3, 4, 40, 41, 100]), np.arange(6) + 0.5
    whole = np.zeros(12 * 9)
    whole[pix] = values
    some = [(pix[:2], values[:2]), (pix[2:2], values[2:2]), (pix[2:], values[2:])]
    blob = b"".join(sinks.fits_pieces(some, 3))
    head, got = sinks.read_fits_map(blob)
    assert len(blob) % 2880 == 0 and head["NSIDE"] == "3" and np.array_equal(got, whole) and blob == sinks.fits_map(whole, 3)
    for bad in ([(np.array([5, 5]), values[:2])], [(np.array([108]), values[:1])], [(np.array([5]), values[:1]), (np.array([4]), values[:1])]):
        with pytest.raises(ValueError):
            list(sinks.fits_pieces(bad, 3))


def test_files_of_tasks_that_failed_are_not_listed(spark, tmp_path):
    class Lines(stores.FilesWriter):
        ending = ".txt"

        def blobs(self, batches):
            for b in batches:
                yield b
                yield None

    writer = Lines(f"file:{tmp_path}/out")
    good, lost = writer.write(iter([b"a", b"b"])), writer.write(iter([b"c"]))
    writer.commit([good, None])
    assert sorted(open(p, "rb").read() for p, _ in stores.listed(f"{tmp_path}/out", ".txt")) == [b"a", b"b"] and lost.files
    writer.abort([lost])
    assert len(list((tmp_path / "out").glob("*.txt"))) == 2
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "x.txt").write_bytes(b"12345")
    assert stores.listed(f"file://{tmp_path}/bare", ".txt") == [(f"{tmp_path}/bare/x.txt", 5)]


@pytest.fixture
def long_group(spark):
    """A group with nine tenths of the rows, others, gaps in t, values in no order; small ranges aren't put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 3 + 1).cast("int").alias("g"), (F.col("id") + F.floor(F.col("id") / 300) * 40).alias("t"), (F.xxhash64("id") % 50).alias("v"))
    yield rows.repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_and_sums_within_groups(spark, long_group):
    table = sorted((r.g, r.t, r.v) for r in long_group.collect())
    groups = {g: [r for r in table if r[0] == g] for g in {r[0] for r in table}}
    part = index_sets.ranged(long_group, ["g"], ["t"])
    assert part.filter("g = 0").select("_part").distinct().count() > 1  # a group in several ranges
    got = {(r.g, r.t): r.n for r in index_sets.numbered_within(long_group, ["g"], ["t"], "n").collect()}
    total = {(r.g, r.t): r.s for r in index_sets.running_total(part, ["g"], "v", "s").collect()}
    before = {(r.g, r.t): r.b for r in index_sets.with_previous(part, ["g"], "v", "b").collect()}
    for own in groups.values():
        sums = np.cumsum([r[2] for r in own])
        for k, r in enumerate(own):
            assert got[r[:2]] == k and total[r[:2]] == sums[k] and before[r[:2]] == (own[k - 1][2] if k else None)
    bad = sorted((r.g, r.t) for r in index_sets.out_of_order(long_group, "v", ["t"], ["g"]).collect())
    assert bad == sorted(r[:2] for own in groups.values() for p, r in zip(own, own[1:]) if r[2] < p[2])
    everywhere = sorted(table, key=lambda r: r[1])
    assert sorted(r.t for r in index_sets.out_of_order(long_group, "v", ["t"]).collect()) == sorted(r[1] for p, r in zip(everywhere, everywhere[1:]) if r[2] < p[2])


def test_pieces_of_a_long_block(spark, long_group):
    rows = long_group.select(F.col("g").alias("block_id"), "t", F.col("t").alias("row"))
    gaps = spark.createDataFrame([(1000, 60), (2000, 5)], "id0 long, len long")
    got = sorted((r.block_id, r.row, r.piece, r.t) for r in toeplitz.gappy_blocks(rows, gaps, 30).collect())
    want = []
    for g in range(4):
        piece, first, last = 0, None, None
        for t in sorted(r.t for r in rows.filter(F.col("block_id") == g).collect() if not 1000 <= r.t < 1060):
            piece += last is not None and t - last > 29
            first = t if last is None or t - last > 29 else first
            want.append((g, t, piece, t - first))
            last = t
    assert got == want
    packed = {(r.block_id, r.row): r.packed for r in flags.gaps_dropped(rows, gaps, by=["block_id"]).collect()}
    for g in range(4):
        own = sorted(t for b, t in packed if b == g)
        assert [packed[g, t] for t in own] == list(range(len(own)))
    plan = toeplitz.gappy_blocks(rows, gaps, 30)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # what is left reads the written pieces
