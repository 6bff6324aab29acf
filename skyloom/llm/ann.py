"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more coordinate that makes all lengths equal, so that nearest by distance is largest by inner product.
There is a list for every ``LIST`` vectors (``MOST`` lists at most; beyond that lists grow).  Their centroids are fitted on a
bounded sample (``PER_LIST`` vectors a list, of the lowest id hashes) by k-means in two levels, then clusters over twice the mean of the sample are
halved until there is none.  The graph over them (each to its nearest ones) is made once, from slices of their distances, and goes to the
workers as edges; searches and calibration hold ``HELD`` numbers at a time, so memory is bounded at any number of lists.

Every vector is put on the list of its nearest centroid and, near a boundary, on those of others within ``REPLICATE`` times that
distance; a query searches the lists whose centroids lie within a ratio of the distance of the eighth, found by best-first search in
the graph.  The ratio is calibrated, not given: sample vectors ask for their true nearest in the sample, and it is the
least by which ``RECALL`` of those are found.  Vectors that lie in clusters need few lists, random ones many.

Neighbouring lists share a bucket of bounded size, where each query meets the lists that it searches, all at once; lists larger than a bucket are
cut into blocks.  Each bucket yields a query's best, and the best of those are the result.

Scores are inner products in double precision of the original vectors, each computed for the pair alone.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite component take no part, neither do
null ids and vectors of another dimension than the most frequent (of equals the smaller).  Rows that repeat id
and vector count once; an id with several vectors is a query for each and never its own neighbour.  Of equal vectors
only the k + 1 smallest ids can be among the nearest, so no more enter the lists.  An empty table gives no rows.  Only vec_id and the
vector are read, so clashing column names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.sources.staging import written

LIST, MOST, PER_LIST, DEGREE = 64, 16_384, 16, 24
REPLICATE, COPIES = 1.03, 3
#: Vectors of a bucket or block: each gives a query k rows at most, so few rows are sent on for the many pairs scored.
BLOCK = 1 << 17
#: Queries that meet a block together, least and most; up to eight such parts a block, for tasks to share, each with a copy of the block.
LEAST_ASKED, MOST_ASKED = 512, 16_384
#: What the calibration aims at, and how many sample vectors ask for it.
RECALL, ASKED = 0.95, 400
#: The distance that ratios refer to is that of the so-manieth nearest centroid (a query may be a centroid itself).
NEAREST_OF_COPY, NEAREST_OF_QUERY = 1, 8


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _means(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Plain k-means; clusters that lose all their vectors go."""
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _near(x, c)
        size = np.bincount(near, minlength=len(c))
        has = np.flatnonzero(size)
        order = np.argsort(near, kind="stable")
        c = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size[has])[:-1]]), axis=0) / size[has][:, None]
    return c


#: Numbers of a matrix of distances or scores that is held at once.
HELD = 1 << 22


def _slices(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, HELD // max(1, columns))
    return (slice(at, at + step) for at in range(0, max(1, rows), step))


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[some], c).argmin(1) for some in _slices(len(x), len(c))])


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Balanced centroids of the sample, neighbours close together in their order."""
    rng = np.random.default_rng(seed)
    tops = _means(sample, max(1, int(lists**0.5)), rng)
    of = _near(sample, tops)
    parts = [sample[of == k] for k in np.unique(of)]
    c = np.concatenate([_means(p, max(1, round(lists * len(p) / len(sample))), rng) for p in parts])
    most = 2 * max(1.0, len(sample) / lists)
    for _ in range(12):  # each round halves what is too large; copies of one vector can't be parted
        near = _near(sample, c)
        size = np.bincount(near, minlength=len(c))
        out = []
        for k in range(len(c)):
            own = sample[near == k] if size[k] > most else None
            if own is None or not np.ptp(own, 0).any():
                out.append(c[k : k + 1])
                continue
            way = np.linalg.svd(own - own.mean(0), full_matrices=False)[2][0]
            upper = (along := own @ way) > np.median(along)
            upper = upper if upper.any() else along >= np.median(along)
            out.append(np.stack([own[upper].mean(0), own[~upper].mean(0)]) if not upper.all() else c[k : k + 1])
        if sum(map(len, out)) == len(c):
            break
        c = np.concatenate(out)
    return c.astype(np.float32)


def calibrate(sample: np.ndarray, graph: Graph, k: int) -> tuple[float, int]:
    """The ratio by which ``RECALL`` of the sample's true neighbours are found, and how many lists a query may need."""
    ask = np.unique(np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int))
    q = sample[ask].copy()
    q[:, -1] = 0
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0, len(graph.c)
    best = []
    for some in _slices(len(ask), len(sample)):
        score = q[some] @ sample.T
        score[np.arange(len(score)), ask[some]] = -np.inf
        best.append(np.argpartition(-score, k - 1, 1)[:, :k].copy())  # not the whole order
    best = np.concatenate(best)
    rows, back = np.unique(best, return_inverse=True)
    lists, taken = _taken(graph, sample[rows], 32, REPLICATE, NEAREST_OF_COPY, COPIES)
    far = _squares(q, graph.c)
    to = far[np.arange(len(ask))[:, None, None], lists[back.reshape(best.shape)]]
    to = np.where(taken[back.reshape(best.shape)], to, np.inf).min(2)
    unit = np.sort(far, 1)[:, min(NEAREST_OF_QUERY, far.shape[1]) - 1]
    ratio = float(np.quantile(to / np.maximum(unit, 1e-30)[:, None], RECALL)) ** 0.5
    need = (far <= ratio**2 * unit[:, None]).sum(1)
    return max(1.0, ratio), int(min(len(graph.c), max(64, 1.25 * np.quantile(need, 0.99))))


def _taken(graph: Graph, x: np.ndarray, beam: int, ratio: float, nth: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The lists found for each row, nearest first, and which of them it takes."""
    ids, dist = graph.search(x, beam)
    near = min(nth, dist.shape[1])
    take = np.isfinite(dist) & (dist <= ratio**2 * dist[:, near - 1 : near])
    take[:, :near] |= np.isfinite(dist[:, :near])
    if most is not None:
        take[:, most:] = False
    return ids, take


class Graph:
    """Best-first search over centroids, for many vectors at a time."""

    def __init__(self, centroids: np.ndarray, edges: np.ndarray | None = None):
        self.c = centroids
        self.edges = self._linked() if edges is None else edges
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, min(64, len(centroids))).astype(int))

    def _linked(self) -> np.ndarray:
        """The nearest centroids of each, and the next in order, which keeps the graph connected; a slice of the distances at a time."""
        n, near = len(self.c), min(DEGREE, len(self.c) - 1)
        out = np.empty((n, near + 1), np.int32)
        out[:, near] = (np.arange(n) + 1) % n
        for some in _slices(n, n):
            dist = _squares(self.c[some], self.c)
            rows = np.arange(len(dist))[:, None]
            dist[rows[:, 0], some.start + rows[:, 0]] = np.inf
            if near:
                best = np.sort(np.argpartition(dist, near - 1, 1)[:, :near], 1)
                out[some, :near] = np.take_along_axis(best, np.argsort(dist[rows, best], 1, kind="stable"), 1)
        return out

    def search(self, x: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the nearest centroids found, nearest first (where fewer are found, infinity). A round goes on from the
        ``wide`` nearest, or an eighth of the beam."""
        found = [self._search(x[some], beam, wide) for some in _slices(len(x), len(self.c))]
        most = max(d.shape[1] for _, d in found)
        pad = lambda m, v: np.pad(m, ((0, 0), (0, most - m.shape[1])), constant_values=v)
        return np.concatenate([pad(i, 0) for i, _ in found]), np.concatenate([pad(d, np.inf) for _, d in found])

    def _search(self, x: np.ndarray, beam: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        rows, beam = np.arange(len(x))[:, None], min(beam, len(self.c))
        wide = max(wide, beam // 8)
        seen, met = np.zeros((len(x), len(self.c)), bool), np.empty((len(x), len(self.c)), np.int32)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        dist = _squares(x, self.c[self.entries])
        fresh = np.ones(dist.shape, bool)
        norm = (self.c * self.c).sum(1)
        own = (x * x).sum(1)
        while True:
            if dist.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
                ids, dist, fresh = ids[rows, keep], dist[rows, keep], fresh[rows, keep]
            if not fresh.any():
                order = np.argsort(dist, 1, kind="stable")
                return ids[rows, order], dist[rows, order]
            some = min(wide, int(fresh.sum(1).max()))
            pick = np.argpartition(np.where(fresh, dist, np.inf), some - 1, 1)[:, :some]
            live = fresh[rows, pick]
            fresh[rows, pick] = False
            new = self.edges[ids[rows, pick]].reshape(len(x), -1)
            at, column = np.nonzero(np.repeat(live, self.edges.shape[1], 1) & ~seen[rows, new])
            name = new[at, column]
            met[at, name] = column  # of equals one stays
            once = met[at, name] == column
            at, name = at[once], name[once]
            seen[at, name] = True
            count = np.bincount(at, minlength=len(x))
            place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            more, far = np.zeros((len(x), int(count.max())), int), np.full((len(x), int(count.max())), np.inf, dist.dtype)
            more[at, place], far[at, place] = name, np.maximum(own[at] - 2 * np.einsum("nd,nd->n", x[at], self.c[name]) + norm[name], 0)
            ids, dist, fresh = np.concatenate([ids, more], 1), np.concatenate([dist, far], 1), np.concatenate([fresh, np.isfinite(far)], 1)


def _lifted(v: np.ndarray, length: float | None) -> np.ndarray:
    """One more coordinate: what is missing to ``length`` (of a query: 0)."""
    more = np.zeros(len(v)) if length is None else np.sqrt(np.maximum(length**2 - (v.astype(np.float64) ** 2).sum(1), 0))
    return np.concatenate([v, more[:, None].astype(np.float32)], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


class Index:
    """Lists and the queries that search them. ``base``: candidates; ``lists``: bucket, list, id, v; ``asked``: bucket, id, v, lists."""

    def __init__(self, rows: DataFrame, width: int, k: int):
        place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        self.width, self.base = width, written(rows.withColumn("place", place).filter(F.col("place") <= k + 1).select("vec_id", "v"), "candidates")
        self.total, longest = self.base.agg(F.count(F.lit(1)), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
        lists = int(min(MOST, max(1, self.total // LIST)))
        told = self.base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PER_LIST * max(lists, 256)).select("v").toArrow()
        sample = _lifted(_matrix(told["v"], width), longest)
        graph = Graph(fit(sample, lists))
        self.lists_n = len(graph.c)
        sent = rows.sparkSession.sparkContext.broadcast((graph.c, graph.edges))  # MOST centroids at most, DEGREE + 1 edges each
        self.ratio, self.beam = calibrate(sample, graph, k)
        self.share = max(1, int(BLOCK * self.lists_n / (2 * max(1, self.total))))  # lists a bucket
        share, ratio, beam = self.share, self.ratio, self.beam

        def place_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = Graph(*sent.value)
            for b in _parts(batches):
                ids, take = _taken(graph, _lifted(_matrix(b["v"], width), longest), 32, REPLICATE, NEAREST_OF_COPY, COPIES)
                of, rank = np.nonzero(take)
                found = ids[of, rank]
                yield pa.RecordBatch.from_arrays([pa.array(found // share, pa.int32()), pa.array(found, pa.int32()), b["vec_id"].take(pa.array(of)), b["v"].take(pa.array(of))], ["bucket", "list", "id", "v"])

        def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = Graph(*sent.value)
            for b in _parts(batches):
                ids, take = _taken(graph, _lifted(_matrix(b["v"], width), None), beam, ratio, NEAREST_OF_QUERY, None)
                of, rank = np.nonzero(take)
                found = ids[of, rank]
                order = np.lexsort((found, of))
                of, found = of[order], found[order]
                first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] // share != found[:-1] // share)])) if len(of) else np.empty(0, int)
                at = pa.array(of[first])
                told = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(found[first] // share, pa.int32()), b["vec_id"].take(at), b["v"].take(at), told], ["bucket", "id", "v", "lists"])

        self.lists = written(self.base.mapInArrow(place_vectors, "bucket int, list int, id long, v array<float>"), "lists")
        self.asked = written(rows.filter("q").select("vec_id", "v").mapInArrow(place_queries, "bucket int, id long, v array<float>, lists array<int>"), "queries")

    def scored_share(self) -> float:
        """Pairs of a query and a vector on a list that it searches, copies too, of all pairs of a query and a vector."""
        held = self.lists.groupBy("list").count()
        wanted = self.asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        queries = self.asked.select("id", "v").distinct().count()
        return (held.join(wanted, "list").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0) / max(1, queries * self.total)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def index(vectors: DataFrame, queries: Column, k: int = 20, vector: str = "embedding") -> Index | None:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("v"), queries.alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = written(rows.dropDuplicates(["vec_id", "v"]), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return None if sizes is None else Index(rows.filter(F.size("v") == sizes["d"]), sizes["d"], k)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``queries`` picks, its k nearest found."""
    found_index = index(vectors, queries, k, vector)
    if found_index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, lists, asked = found_index.width, found_index.lists, found_index.asked
    n = F.count(F.lit(1))
    blocks = lists.groupBy("bucket").agg(F.ceil(n / BLOCK).cast("int").alias("nv"))
    parts = asked.groupBy("bucket").agg(F.greatest(F.ceil(n / MOST_ASKED), F.least(F.lit(8), F.ceil(n / LEAST_ASKED))).cast("int").alias("nq"))
    cuts = F.broadcast(blocks.join(parts, "bucket"))  # MOST rows at most
    left = lists.join(cuts, "bucket").select("bucket", F.pmod(F.xxhash64("id"), "nv").cast("int").alias("bv"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), "list", "id", "v")
    right = asked.join(cuts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("bv"), F.pmod(F.xxhash64("id"), "nq").cast("int").alias("bq"), "id", "v", "lists")

    def nearest_of(out: list, bound: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of those that can be among a query's k nearest, as each stands COPIES times at most. ``bound``: gets the least
        score that can."""
        i, j, score = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((-score, i))
        i, j, score = i[order], j[order], score[order]
        first, past = np.searchsorted(i, i, "left"), np.searchsorted(i, i, "right")
        last = np.minimum(first + COPIES * (k + 1), past) - 1
        full = past - first >= COPIES * (k + 1)
        bound[i[full]] = score[last[full]]
        near = score >= score[last] - slack
        return i[near], j[near], score[near]

    def best(found: pa.Table, wanted: pa.Table) -> pa.Table:
        i, j, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        vid = qid = np.empty(0, np.int64)
        if found.num_rows and wanted.num_rows:
            found = found.sort_by("list")
            vs, qs = _matrix(found["v"], width), _matrix(wanted["v"], width).astype(np.float64)
            vid, qid, of_list = found["id"].to_numpy(), wanted["id"].to_numpy(), found["list"].to_numpy()
            told = wanted["lists"].combine_chunks()
            asks = told.flatten().to_numpy()
            who = np.repeat(np.arange(len(qs)), told.value_lengths().to_numpy())
            order = np.argsort(asks, kind="stable")
            asks, who = asks[order], who[order]
            slack = 1e-9 * max(1.0, float(np.sqrt((qs * qs).sum(1).max() * (vs.astype(np.float64) ** 2).sum(1).max())))  # sums in another order may differ a little
            bound, out, held, room = np.full(len(qs), -np.inf), [], 0, max(1 << 16, 4 * COPIES * (k + 1) * len(qs))
            for name in np.unique(of_list):
                a, z = np.searchsorted(of_list, [name, name + 1])
                ours, own = who[slice(*np.searchsorted(asks, [name, name + 1]))], vs[a:z].astype(np.float64)
                for at in range(0, len(ours), 256):
                    rows = ours[at : at + 256]
                    score = qs[rows] @ own.T
                    score[qid[rows][:, None] == vid[a:z]] = -np.inf
                    i, j = np.nonzero((score >= bound[rows][:, None] - slack) & np.isfinite(score))
                    out.append((rows[i], a + j, score[i, j]))
                    if (held := held + len(i)) > room:
                        out, held = [nearest_of(out, bound, slack)], 0
            i, j, score = nearest_of(out, bound, slack) if out else (i, j, score)
        exact = np.einsum("ij,ij->i", qs[i], vs[j].astype(np.float64)) if len(i) else np.empty(0)
        _, once = np.unique(np.stack([i, vid[j]], 1), axis=0, return_index=True) if len(i) else (None, np.empty(0, int))
        i, j, exact = i[once], j[once], exact[once]
        order = np.lexsort((vid[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        top = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        i, j, exact = i[top], j[top], exact[top]
        vecs = wanted["v"].combine_chunks() if wanted.num_rows else pa.array([], pa.list_(pa.float32()))
        return pa.Table.from_arrays([pa.array(qid[i], pa.int64()), pa.array(vid[j], pa.int64()), pa.array(exact, pa.float64()), pa.array(_digest(vecs.take(pa.array(i, pa.int64())), width), pa.int64())], ["query_id", "vec_id", "score", "of"])

    by = ["bucket", "bv", "bq"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "query_id long, vec_id long, score double, of long")
    once = met.groupBy("query_id", "of", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _digest(vectors: pa.Array, width: int) -> np.ndarray:
    """Tells the vectors of one query id apart."""
    if not len(vectors):
        return np.empty(0, np.int64)
    bits = _matrix(vectors, width).view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (bits * (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(1).view(np.int64)
