import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from skyloom.llm import pq

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("q", "code", "error", "_salt", "place"))])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *("clash",) * 5) for r in rows], SCHEMA).repartition(3)


def brute(rows, parts=4, entries=256, rounds=4):
    """Full scans in Python integers: rows (vec_id, code, error, label_error), digest of the codebooks."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        near = find()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, near) if n[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    near = find()
    error = [sum(d for d, _ in n) for n in near]
    by = {}
    for (_, _, label), e in zip(kept, error):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in n), e, by[r[2]]) for r, n, e in zip(kept, near, error)), key=str), digest


def table():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 8))
    rows = [(k, (centres[k % 9] + rng.normal(size=8) * (0.01, 0.5)[k % 2]).tolist(), (None, 1, 2)[k % 3]) for k in range(330)]
    rows += [(k, rows[5][1], 1) for k in range(1000, 1020)]  # copies
    rows += [(3, rows[7][1], 1), (None, rows[8][1], None), (None, rows[8][1], None), (40, None, 2), (41, [1.0] * 7 + [None], 2), (42, [1.0] * 7 + [float("nan")], 2), (-5, [float("inf")] * 8, 1), (-7, [-0.0004] * 8, 2)]
    rows += [(2000 + k, [round(x * 2) / 2 for x in rng.normal(size=8).tolist()], 2) for k in range(40)]  # ties
    return rows


@pytest.mark.parametrize("rows", [table(), table()[:20], [(1, None, 1)], [], [(5, [], 1), (4, [], None)], [(k, [20000.0 * (-1) ** k] * 4, k % 2) for k in range(6)]])
def test_same_as_full_scans(spark, rows):
    got = pq.with_label_errors(pq.compress(frame(spark, rows))).collect()
    want, digest = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == ({digest} if want else set())


@pytest.mark.parametrize("width,top", [(1, 3), (2, 4), (16, 700), (16, 1 << 24)])
def test_exponion_finds_the_nearest_entry_of_lowest_index(width, top):
    rng = np.random.default_rng(width)
    entries, x = rng.integers(-top, top, (100, width)), rng.integers(-top, top, (500, width))
    entries[50:60] = entries[:10]  # equal entries
    at, d = pq.Codebook(entries).nearest(x, rng.integers(0, 100, 500).astype(np.uint8))
    full = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all()


def test_exponion_looks_at_few_entries(monkeypatch):
    rng = np.random.default_rng(3)
    entries = rng.integers(-100_000, 100_000, (256, 4))
    near = rng.integers(0, 256, 2000)
    x, book, seen = entries[near] + rng.integers(-300, 300, (2000, 4)), pq.Codebook(entries), []
    own = pq.Codebook._distances
    monkeypatch.setattr(pq.Codebook, "_distances", staticmethod(lambda parts, rows, near: seen.append(len(rows) * len(near)) or own(parts, rows, near)))
    assert (book.nearest(x, near.astype(np.uint8))[0] == ((x[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) <= 2 * pq.STEP * len(x)


def test_what_has_no_code_raises(spark):
    for rows in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception, match="components|parts"):
            pq.compress(frame(spark, rows)).rows.collect()
