import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import ann


def brute(rows, k, every):
    out = []
    for q, v in rows:
        if q is None or q % every:
            continue
        others = sorted((-float(np.einsum("i,i->", np.float64(np.float32(v)), np.float64(np.float32(w)))), i) for i, w in rows if i is not None and i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(others[:k])]
    return out


def random_rows(n, d, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    return [(i, (centers[rng.integers(12)] + 0.5 * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]


def run(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, v string").repartition(4)
    return ann.nearest(df, F.col("vec_id") % every == 0, k)


def test_few_lists_of_clustered_vectors_are_searched(spark):
    """At most a fifth of the pairs scored, at a recall of 0.9 or more; no list over twice the mean."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(60, 32))
    rows = [(i, (centers[rng.integers(60)] + 0.35 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    made = ann.index(df, F.col("vec_id") % 20 == 0)
    assert made.scored_share() <= 0.2
    held = [r["count"] for r in made.lists.groupBy("list").count().collect()]
    assert 80 <= len(held) <= 8000 // ann.LIST * 2 and max(held) <= 3 * np.mean(held)
    x = np.array([v for _, v in rows], np.float64)
    q = np.arange(0, 8000, 20)
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    want = {(int(a), int(b)) for a, own in zip(q, np.argsort(-score, 1, kind="stable")[:, :20]) for b in own}
    got = {(r.query_id, r.vec_id) for r in run(spark, rows).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_centroids_are_balanced():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 8)) * 0.01, rng.normal(size=(1000, 8)) * 5]).astype(np.float32)
    c = ann.fit(x, 64)
    size = np.bincount(ann._near(x, c), minlength=len(c))
    assert size.max() <= 2 * len(x) / 64


def test_recall_and_scores(spark):
    rows = random_rows(3000, 24)
    got = run(spark, rows).collect()
    want = brute(rows, 20, 20)
    assert len(got) == len(want)
    pairs = {(r.query_id, r.vec_id) for r in got}
    assert len(pairs & {(q, i) for q, _, i, _ in want}) >= 0.97 * len(want)
    vec = {i: np.float64(np.float32(v)) for i, v in rows}
    for r in got:
        assert abs(r.score - vec[r.query_id] @ vec[r.vec_id]) < 1e-9
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    for own in by.values():
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(own, own[1:]))


def test_odd_vectors_and_ties(spark):
    rows = [(i, [float(i % 3 == 0), 1.0]) for i in range(60)] + [(100, None), (120, []), (140, [0.0, 0.0]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (200, [None, 1.0]), (220, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (7, [0.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in run(spark, rows).collect())
    usable = list(dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v) and any(v)))
    assert got == sorted(brute(usable, 20, 20))


def test_many_copies_and_few_rows(spark):
    rows = [(i, [1.0, 0.5]) for i in range(400)] + [(400, [0.1, 3.0])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in run(spark, rows).collect()) == sorted(brute(rows, 20, 20))
    assert run(spark, [(0, [1.0]), (1, [2.0])]).count() == 1
    assert run(spark, [(0, [1.0])]).count() == 0
    assert run(spark, [(0, None)]).count() == 0


def test_wide_beams_take_few_rounds():
    """A search for half of the centroids goes on from an eighth of its beam at a time, and finds the nearest."""
    rng = np.random.default_rng(4)
    graph = ann.Graph(rng.normal(size=(800, 16)).astype(np.float32))

    class Counted(np.ndarray):
        rounds = 0

        def __getitem__(self, at):
            Counted.rounds += 1
            return np.asarray(super().__getitem__(at))

    graph.edges = graph.edges.view(Counted)
    x = rng.normal(size=(50, 16)).astype(np.float32)
    for beam, least in ((400, 0.99), (32, 0.9)):
        ids, dist = graph.search(x, beam)
        far = ann._squares(x, graph.c)
        want = np.argsort(far, 1, kind="stable")[:, :beam]
        assert np.allclose(dist, np.take_along_axis(far, ids, 1), atol=1e-4) and (np.diff(dist, axis=1) >= 0).all()
        assert all(len(set(own)) == beam for own in ids.tolist())
        assert np.mean([np.isin(w, i).mean() for w, i in zip(want, ids)]) >= least
    assert Counted.rounds <= 50


def test_memory_at_the_most_lists():
    """The graph over as many centroids as there may be, the calibration of as large a sample, and a worker's search: under 500 MB each."""
    import tracemalloc

    rng = np.random.default_rng(11)
    sample = rng.normal(size=(ann.MOST * ann.PER_LIST, 9)).astype(np.float32)
    centroids = sample[:: ann.PER_LIST].copy()
    tracemalloc.start()
    try:
        graph = ann.Graph(centroids)
        assert tracemalloc.get_traced_memory()[1] < 500e6
        ratio, beam = ann.calibrate(sample, graph, 20)
        worker = ann.Graph(graph.c, graph.edges)
        ids, dist = worker.search(sample[:512], 64)
        assert ann._near(sample[:5000], centroids).shape == (5000,)
        assert tracemalloc.get_traced_memory()[1] < 500e6
    finally:
        tracemalloc.stop()
    assert graph.edges.shape == (ann.MOST, ann.DEGREE + 1) and graph.edges.dtype == np.int32 and ratio >= 1 and beam <= ann.MOST
    true = ann._squares(sample[:64], centroids).argmin(1)
    assert (ids[:64, 0] == true).mean() > 0.9


def test_edges_go_to_the_nearest():
    c = np.random.default_rng(12).normal(size=(700, 5)).astype(np.float32)
    far = ann._squares(c, c)
    np.fill_diagonal(far, np.inf)
    want = np.sort(far, 1)[:, : ann.DEGREE]
    edges = ann.Graph(c).edges
    assert np.allclose(np.take_along_axis(far, edges[:, :-1].astype(int), 1), want, rtol=1e-5, atol=1e-6) and (edges[:, -1] == (np.arange(700) + 1) % 700).all()
    for n in (1, 2, 5):
        assert ann.Graph(c[:n]).search(c[:3], 8)[0].shape[0] == 3
