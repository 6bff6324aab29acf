"""Least-squares fits of a block's templates to its samples, orthogonally and over many tasks.

Samples lie in chunks of time.  Each chunk takes off the templates that only it has (``functions.orthogonal``) and hands on a
small matrix of the others; ``FAN`` neighbours are put together and take off what only they have, and so on until a block has one
node left, so there are logarithmically many steps and no task holds a block's samples or all of its templates.  Every template
is taken off at one node.  A fit goes up the tree with sums of templates times samples and down again with amplitudes.

Templates have length 1 over their block.  Directions shorter than ``orthogonal.RANK`` are left out, so templates that nearly depend on
each other, or do, give bounded amplitudes; where they do, the amplitudes are one of many sets with the same fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions.orthogonal import Factor, Front, backward, eliminated, forward, piecewise, together
from skyloom.sources.staging import as_bytes, from_bytes, wide_rows, written

FAN = 16
CHUNK = 1 << 14
#: What a fit may leave of any template in the samples, of their length.
TOLERANCE = 1e-6

#: Entries (sample, bin, weight) of a chunk, from a row of a batch.
Entries = Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
_LIST = pa.list_(pa.int64())
#: Integers of ``packed_samples``.
_NUMBERS = {"t": np.int64, "pix": np.int64, "at": np.int32, "bin": np.int32}
_COLUMNS = "level int, node long, place int, local array<bigint>, rest array<bigint>, low array<bigint>, high array<bigint>, sizes array<bigint>, names binary, norm binary, solve binary, r binary"


class Inexact(ArithmeticError):
    """A fit leaves more of a template than rounding explains."""


@dataclass
class Fit:
    factors: DataFrame  # block_id, level, node, place and a node's factors one after the other (place 0); its front has place -1 and its matrix in r
    bins: DataFrame  # block_id, bin, norm, level, node: where each template is taken off
    top: int

    def doubles(self) -> tuple[int, int, int]:
        """Numbers of all factors, of those over several chunks, and of the largest chunk's."""
        n = (F.length("solve") + F.length("r")) / 8
        upper, leaf = F.when(F.col("level") > 0, n), F.when(F.col("level") == 0, n)
        return tuple(int(k or 0) for k in self.factors.filter("place >= 0").agg(F.sum(n), F.sum(upper), F.max(leaf)).first())

    def leaves(self) -> DataFrame:
        """What ``Leaf`` reads: block_id, cell, and a chunk's factors."""
        return self.factors.filter("level = 0 AND place >= 0").select("block_id", F.col("node").alias("cell"), "local", "rest", "sizes", "names", "norm", "solve", "r")


def packed(templates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(block_id, cell, t, bin, w): the long table (block_id, t, bin, w) with a row a chunk."""
    kind = templates.schema["block_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        one = lambda c, t: pa.array([table[c].cast(t).to_numpy()], pa.list_(t))
        return pa.table({"block_id": table["block_id"].slice(0, 1), "cell": table["cell"].slice(0, 1), "t": one("t", pa.int64()), "bin": one("bin", pa.int64()), "w": one("w", pa.float64())})

    rows = templates.select("block_id", F.floor(F.col("t") / chunk).alias("cell"), F.col("t").cast("long"), F.col("bin").cast("long"), F.col("w").cast("double"))
    return written(rows.groupBy("block_id", "cell").applyInArrow(run, f"block_id {kind}, cell long, t array<bigint>, bin array<bigint>, w array<double>"), "templates")


def packed_entries(b: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, bin_, w = (b[c][r].values.to_numpy(zero_copy_only=False) for c in ("t", "bin", "w"))
    return t - t.min(), bin_, w


def packed_samples(rows: DataFrame, reals: list[str], chunk: int = CHUNK) -> DataFrame:
    """(block_id, cell, t, pix, ``reals``, at, bin, w): samples beside their templates (``templates.beside``) with a row a chunk, numbers as bytes; an
    entry (bin, w) is of the chunk's sample number ``at``."""
    kind = rows.schema["block_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        bins, w = table["bin"].combine_chunks(), table["w"].combine_chunks()
        at = np.repeat(np.arange(len(bins)), np.diff(bins.offsets.to_numpy()))
        bins, w = bins.flatten(), w.flatten()
        kept = bins.is_valid().to_numpy(zero_copy_only=False)
        one = {c: table[c].to_numpy() for c in ("t", "pix", *reals)} | {"at": at[kept], "bin": bins.filter(pa.array(kept)).to_numpy(), "w": w.to_numpy(zero_copy_only=False)[kept]}
        return pa.table({"block_id": table["block_id"].slice(0, 1), "cell": table["cell"].slice(0, 1), **{c: as_bytes([v], _NUMBERS.get(c, np.float64)) for c, v in one.items()}})

    cut = rows.filter("t IS NOT NULL").select("block_id", F.floor(F.col("t") / chunk).alias("cell"), F.col("t").cast("long"), F.coalesce("pix", F.lit(-1)).cast("long").alias("pix"), *(F.col(c).cast("double") for c in reals), "bin", "w")
    schema = f"block_id {kind}, cell long, " + ", ".join(f"{c} binary" for c in ("t", "pix", *reals, "at", "bin", "w"))
    return written(cut.groupBy("block_id", "cell").applyInArrow(run, schema), "samples")


def _get(b: pa.RecordBatch, r: int, column: str) -> np.ndarray:
    return from_bytes(b, r, column, _NUMBERS.get(column, np.float64))


def sample_entries(b: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of ``packed_samples``; rows are numbered by t, as gaps are rows without templates."""
    t, at, bin_, w = (_get(b, r, c) for c in ("t", "at", "bin", "w"))
    return (t - t.min())[at], bin_.astype(np.int64), w


def _rows(block: pa.Array, level: int, node: int, factors: list[Factor], front: Front, low: np.ndarray, high: np.ndarray, names: np.ndarray, norm: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_COLUMNS``: the factors, then the front (its matrix in r) with the chunks that its columns reach. ``names``, ``norm``: a chunk's
    templates and their lengths."""
    none, real = np.zeros(0, np.int64), np.zeros(0)
    one = lambda parts, empty: np.concatenate([empty, *(p.ravel() for p in parts)])
    lists = {
        "local": [one([f.local for f in factors], none), none], "rest": [one([f.rest for f in factors], none), front.columns], "low": [none, low], "high": [none, high],
        "sizes": [np.array([n for f in factors for n in (len(f.local), *f.r.shape)], np.int64), none],
    }
    numbers = {"names": [names, none], "norm": [norm, real], "solve": [one([f.solve for f in factors], real), real], "r": [one([f.r for f in factors], real), front.m.ravel()]}
    columns = [block.take(pa.array([0, 0])), pa.array([level] * 2, pa.int32()), pa.array([node] * 2, pa.int64()), pa.array([0, -1], pa.int32())]
    columns += [*(pa.array(v, _LIST) for v in lists.values()), *(as_bytes(v, np.int64 if c == "names" else np.float64) for c, v in numbers.items())]
    return pa.RecordBatch.from_arrays(columns, ["block_id", "level", "node", "place", *lists, *numbers])


def _factors(b: pa.RecordBatch | pa.Table, r: int, number: Callable[[np.ndarray], np.ndarray]) -> list[Factor]:
    """Factors of a row, their columns as ``number`` tells."""
    sizes, local, rest = (b[c][r].values.to_numpy(zero_copy_only=False) for c in ("sizes", "local", "rest"))
    local, rest, solve, m = number(local), number(rest), from_bytes(b, r, "solve", np.float64), from_bytes(b, r, "r", np.float64)
    out, a, z, s, q = [], 0, 0, 0, 0
    for n, k, left in sizes.reshape(-1, 3).tolist():
        out.append(Factor(local[a : a + n], rest[z : z + left], solve[s : s + n * k].reshape(n, k), m[q : q + k * left].reshape(k, left)))
        a, z, s, q = a + n, z + left, s + n * k, q + k * left
    return out


class Leaf:
    """A chunk's part of a fit (``Fit.leaves``, from a row of a batch): the templates that only it has are fitted there, given the values of the others."""

    def __init__(self, b: pa.RecordBatch, r: int):
        self.names, norm = from_bytes(b, r, "names", np.int64), from_bytes(b, r, "norm", np.float64)
        self.size = np.where(norm > 0, 1 / np.where(norm > 0, norm, 1), 0.0)[:, None]
        self.factors = _factors(b, r, lambda c: np.searchsorted(self.names, c))
        self.shared = np.ones(len(self.names), bool)  # with other chunks
        for f in self.factors:
            self.shared[f.local] = False

    def places(self, bins: np.ndarray) -> np.ndarray:
        """Among ``names``; without a search of each where they lie near each other."""
        if len(bins) and bins.max() - bins.min() < 4 * len(bins):
            return np.searchsorted(self.names, np.arange(bins.min(), bins.max() + 1))[bins - bins.min()]
        return np.searchsorted(self.names, bins)

    def met(self, entries: list[tuple[np.ndarray, np.ndarray]], values: list[np.ndarray]) -> np.ndarray:
        """Templates of length 1 times values, a column a value, of ``entries``: (place, weight) of every value's numbers, class by class."""
        out = np.stack([sum((np.bincount(at, w * v, len(self.names)) for at, w in entries), np.zeros(len(self.names))) for v in values], 1)
        return out * self.size

    def handed_on(self, met: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the shared templates meet beyond what the chunk's own take of it, and the parts of these."""
        parts = forward(self.factors, met)
        return met[self.shared], parts

    def amplitudes(self, parts: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
        """Of all the chunk's templates; ``shared``: values of those of length 1."""
        x = np.zeros((len(self.names), shared.shape[1]))
        x[self.shared] = shared
        backward(self.factors, parts, x)
        return x * self.size


def _merging(level: int, fan: int) -> Callable[[pa.Table], pa.Table]:
    """The node of so many fronts: what it takes off and its own front."""

    def merge(table: pa.Table) -> pa.Table:
        parts, reach, span = [], {}, fan**level
        for b in table.sort_by("node").to_batches():
            for r in range(b.num_rows):
                columns, low, high = (b[c][r].values.to_numpy(zero_copy_only=False) for c in ("rest", "low", "high"))
                m = from_bytes(b, r, "r", np.float64)
                parts.append(Front(columns, m.reshape(-1, len(columns)) if len(columns) else np.zeros((0, 0))))
                reach |= zip(columns.tolist(), zip(low.tolist(), high.tolist()))
        front = together(parts)
        ends = np.array([reach[c] for c in front.columns.tolist()], np.int64).reshape(-1, 2)
        factor, left = eliminated(front, ends[:, 0] // span == ends[:, 1] // span)
        stay = np.isin(front.columns, left.columns)
        block = table["block_id"].combine_chunks().slice(0, 1)
        return pa.Table.from_batches([_rows(block, level, table["node"][0].as_py() // fan, [] if factor is None else [factor], left, ends[stay, 0], ends[stay, 1], np.zeros(0, np.int64), np.zeros(0))])

    return merge


def factored(chunks: DataFrame, entries: Entries) -> Fit:
    """``chunks``: block_id, cell (chunk number) and what ``entries`` reads. A table that is written: it is read twice."""
    kind = chunks.schema["block_id"].dataType.simpleString()

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                _, bin_, w = entries(b, r)
                names, at = np.unique(bin_, return_inverse=True)
                s = np.bincount(at, w * w, len(names))
                same = pa.array([r] * len(names))
                yield pa.RecordBatch.from_arrays([b["block_id"].take(same), b["cell"].cast(pa.int64()).take(same), pa.array(names, pa.int64()), pa.array(s)], ["block_id", "cell", "bin", "s"])

    with wide_rows(chunks.sparkSession):
        held = written(chunks.mapInArrow(squares, f"block_id {kind}, cell long, bin long, s double"), "held")
    bins = held.groupBy("block_id", "bin").agg(F.sqrt(F.sum("s")).alias("norm"), F.min("cell").alias("low"), F.max("cell").alias("high"))
    last = held.agg(F.max("cell")).first()[0] or 0
    top = next(k for k in range(64) if FAN**k > last)
    level = F.coalesce(*(F.when(F.floor(F.col("low") / FAN**k) == F.floor(F.col("high") / FAN**k), F.lit(k)) for k in range(top + 1)))
    bins = written(bins.withColumn("level", level).withColumn("node", F.floor(F.col("low") / F.pow(F.lit(FAN), "level")).cast("long")), "bins")
    told = held.join(bins, ["block_id", "bin"]).groupBy("block_id", "cell").agg(F.sort_array(F.collect_list(F.struct("bin", "norm", "low", "high"))).alias("told"))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row, bin_, w = entries(b, r)
                told_ = b["told"][r].values
                names, norm, low, high = (told_.field(c).to_numpy() for c in ("bin", "norm", "low", "high"))
                size = norm[np.searchsorted(names, bin_)]
                factors, front = piecewise(row, bin_, np.where(size > 0, w / np.where(size > 0, size, 1), 0.0), names, low == high)
                at = np.searchsorted(names, front.columns)
                yield _rows(b["block_id"].slice(r, 1), 0, b["cell"][r].as_py(), factors, front, low[at], high[at], names, norm)

    schema = f"block_id {kind}, {_COLUMNS}"
    told = written(told, "held")  # flat rows end here
    with wide_rows(chunks.sparkSession):
        out = written(chunks.join(told, ["block_id", "cell"]).mapInArrow(leaf, schema), "factors")
    fronts = out.filter("place = -1")
    for k in range(1, top + 1):
        new = written(fronts.groupBy("block_id", F.floor(F.col("node") / FAN)).applyInArrow(_merging(k, FAN), schema), "factors")
        out, fronts = out.unionByName(new), new.filter("place = -1")
    return Fit(out, bins.select("block_id", "bin", "norm", "level", "node"), top)


def fitted(fit: Fit, right: DataFrame) -> DataFrame:
    """(block_id, bin, tau) of T^T d (block_id, bin, amp), or tau0, tau1, ... of amp0, amp1, ...: up and down the tree, a grouped task a node;
    with a chunk a block one such step."""
    kind = fit.bins.schema["block_id"].dataType.simpleString()
    amps = [c for c in right.columns if c.startswith("amp")]
    v = [f"v{k}" for k in range(len(amps))]
    size = F.when(F.col("norm") > 0, 1 / F.col("norm")).otherwise(F.lit(0.0))
    amp = fit.bins.join(right.select("block_id", F.col("bin").cast("long"), *amps), ["block_id", "bin"], "left")
    amp = amp.select("block_id", "level", "node", "bin", *((F.coalesce(a, F.lit(0.0)) * size).alias(n) for a, n in zip(amps, v)))
    by = ("block_id", "node")

    def solved(table: pa.Table, given: pa.Table, down: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns, whether they are the node's own, their values): on the way up what the node takes off those of the others."""
        rows = table.filter(pa.compute.greater_equal(table["place"], 0))
        factors = [f for r in range(rows.num_rows) for f in _factors(rows, r, lambda c: c)]
        names = np.unique(np.concatenate([np.zeros(0, np.int64), *(f.local for f in factors), *(f.rest for f in factors)]))
        a, x, own = np.zeros((len(names), len(v))), np.zeros((len(names), len(v))), np.zeros(len(names), bool)
        for f in factors:
            f.local, f.rest = np.searchsorted(names, f.local), np.searchsorted(names, f.rest)
            own[f.local] = True
        if given.num_rows and len(names):
            bin_, value = given["bin"].to_numpy(), np.stack([given[n].to_numpy() for n in v], 1)
            at = np.minimum(np.searchsorted(names, bin_), len(names) - 1)
            known = names[at] == bin_
            for of, mine in ((a, own), (x, ~own)):
                of[at[known & mine[at]]] = value[known & mine[at]]
        parts = forward(factors, a)
        if down:
            backward(factors, parts, x)
        return names, own, x if down else -a

    def step(level: int, rows: DataFrame, down: bool) -> DataFrame:
        def run(table: pa.Table, given: pa.Table) -> pa.Table:
            block = table["block_id"] if table.num_rows else given["block_id"]
            names, own, value = solved(table, given, down) if table.num_rows else (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, len(v))))
            told = own if down else ~own
            return pa.table({"block_id": block.take(pa.array([0] * int(told.sum()), pa.int64())), "bin": pa.array(names[told], pa.int64()), **{n: pa.array(np.ascontiguousarray(value[told, k])) for k, n in enumerate(v)}})

        return fit.factors.filter(F.col("level") == level).groupBy(*by).cogroup(rows.select("block_id", "node", "bin", *v).groupBy(*by)).applyInArrow(run, f"block_id {kind}, bin long, " + ", ".join(f"{n} double" for n in v))

    at: list[DataFrame] = []
    for k in range(fit.top):
        at.append(written(amp.filter(F.col("level") == k), "amplitudes"))
        taken = step(k, at[k], False).groupBy("block_id", "bin").agg(*(F.sum(n).alias(f"s_{n}") for n in v))
        amp = amp.filter(F.col("level") > k).join(taken, ["block_id", "bin"], "left")
        amp = written(amp.select("block_id", "level", "node", "bin", *((F.col(n) - F.coalesce(f"s_{n}", F.lit(0.0))).alias(n) for n in v)), "amplitudes")
    x = step(fit.top, amp, True)
    for k in range(fit.top - 1, -1, -1):
        x = written(x, "amplitudes")
        needs = fit.factors.filter((F.col("level") == k) & (F.col("place") == -1)).select("block_id", "node", F.explode("rest").alias("bin")).join(x, ["block_id", "bin"])
        x = x.unionByName(step(k, at[k].select("block_id", "node", "bin", *v).unionByName(needs.select("block_id", "node", "bin", *v)), True))
    found = x.join(fit.bins.select("block_id", "bin", "norm"), ["block_id", "bin"])
    return found.select("block_id", F.col("bin").cast("int").alias("bin"), *((F.col(n) * size).alias(a.replace("amp", "tau")) for n, a in zip(v, amps)))


def left_over(chunks: DataFrame, fit: Fit, values: list[str], kept: list[str]) -> DataFrame:
    """(block_id, t, pix, ``kept``, ``values``): samples of ``packed_samples``, each value less what the templates fit of it."""
    kind, spark = chunks.schema["block_id"].dataType.simpleString(), chunks.sparkSession
    amps, taus = ([f"{c}{k}" for k in range(len(values))] for c in ("amp", "tau"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at, bin_, w = (_get(b, r, c) for c in ("at", "bin", "w"))
                names, place = np.unique(bin_, return_inverse=True)
                sums = [np.bincount(place, w * _get(b, r, c)[at], len(names)).astype(float) for c in values]
                same = pa.array([r] * len(names), pa.int64())
                yield pa.RecordBatch.from_arrays([b["block_id"].take(same), b["cell"].take(same), pa.array(names, pa.int32()), *map(pa.array, sums)], ["block_id", "cell", "bin", *amps])

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at, bin_, w = (_get(b, r, c) for c in ("at", "bin", "w"))
                t, out = _get(b, r, "t"), [_get(b, r, c) for c in values]
                if b["told"][r].is_valid:  # else the chunk has no templates
                    told = b["told"][r].values
                    place = np.searchsorted(told.field("bin").to_numpy(), bin_)
                    out = [v - np.bincount(at, w * told.field(x).to_numpy()[place], len(t)) for v, x in zip(out, taus)]
                yield pa.RecordBatch.from_arrays([b["block_id"].take(pa.array([r] * len(t), pa.int64())), *(pa.array(_get(b, r, c)) for c in ("t", "pix", *kept)), *map(pa.array, out)], ["block_id", "t", "pix", *kept, *values])

    with wide_rows(spark):
        sums = written(chunks.mapInArrow(met, f"block_id {kind}, cell long, bin int, " + ", ".join(f"{a} double" for a in amps)), "amplitudes")
    tau = fitted(fit, sums.groupBy("block_id", "bin").agg(*(F.sum(a).alias(a) for a in amps)))
    told = sums.select("block_id", "cell", "bin").join(tau, ["block_id", "bin"]).groupBy("block_id", "cell").agg(F.sort_array(F.collect_list(F.struct("bin", *taus))).alias("told"))
    told = written(told, "fitted")  # flat rows end here
    with wide_rows(spark):
        return written(chunks.join(told, ["block_id", "cell"], "left").mapInArrow(less, f"block_id {kind}, t long, pix long, " + ", ".join(f"{c} double" for c in (*kept, *values))), "left")


def checked(fit: Fit, left: DataFrame, lengths: DataFrame) -> None:
    """Raises unless what a fit leaves is orthogonal to all templates. ``left``: block_id, bin, amp (templates times what is left);
    ``lengths``: block_id, length (of the samples before)."""
    worst: Column = F.abs("amp") / F.when(F.col("norm") > 0, F.col("norm")) / F.when(F.col("length") > 0, F.col("length"))
    most = left.join(fit.bins, ["block_id", "bin"]).join(lengths, "block_id").agg(F.max(worst)).first()[0] or 0.0
    if not most <= TOLERANCE:
        raise Inexact(f"the fit leaves {most:.1e} of a template in the samples")


def _of_blocks(told: pa.Table, first: dict) -> np.ndarray:
    """Numbers of (block_id, bin) among the bins of all blocks."""
    return np.array([first[k] for k in told["block_id"].to_pylist()], np.int64) + told["bin"].to_numpy()


def _fetched(fit: Fit, first: dict, level: int, number: Callable[[np.ndarray], np.ndarray]) -> list[Factor]:
    """Factors from a level up, in the order in which they take off."""
    rows = fit.factors.filter(f"place >= 0 AND level >= {level}").select("block_id", "level", "node", "local", "rest", "sizes", "solve", "r").toArrow().sort_by([("level", "ascending"), ("node", "ascending")])
    return [f for b in rows.to_batches() for r in range(b.num_rows) for f in _factors(b, r, lambda c, at=first[b["block_id"][r].as_py()]: number(c + at))]


class DriverFit:
    """The same on the driver, for as many factors as it holds; bins of all blocks in one vector, a block's first at ``first[block]``."""

    def __init__(self, fit: Fit, first: dict, bins: int):
        self.factors = _fetched(fit, first, 0, lambda c: c)
        told = fit.bins.select("block_id", "bin", "norm").toArrow()
        norm = np.zeros(bins)
        norm[_of_blocks(told, first)] = told["norm"].to_numpy()
        self.size = np.where(norm > 0, 1 / np.where(norm > 0, norm, 1), 0.0)

    def __call__(self, amp: np.ndarray) -> np.ndarray:
        size = self.size[:, None] if amp.ndim > 1 else self.size
        a, x = amp * size, np.zeros(amp.shape)
        backward(self.factors, forward(self.factors, a), x)
        return x * size


class SharedFit:
    """The templates that several chunks have, on the driver: what chunks hand on (``Leaf``), in columns by ``known``, to the values of those of length 1."""

    def __init__(self, fit: Fit, first: dict):
        self.known = np.sort(_of_blocks(fit.bins.filter("level > 0").select("block_id", "bin").toArrow(), first))
        self.factors = _fetched(fit, first, 1, lambda c: np.searchsorted(self.known, c))

    def __call__(self, met: np.ndarray) -> np.ndarray:
        x = np.zeros(met.shape)
        backward(self.factors, forward(self.factors, met), x)
        return x
