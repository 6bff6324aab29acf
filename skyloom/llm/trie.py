"""The prefix tree of conversations, built compressed (Patricia) and expanded at the end.

Turns become digests of 132 bits of role and text; a conversation is the string of its turns' digests, of one width each, and
conversations with the same string are one.  Strings are sorted over the cluster and packed in chunks.  A task goes through
a chunk with a stack of the open path: neighbours share so many turns, and only where a string ends or two neighbours part
is a point created.  Members, leaves, the smallest member and the sums below are added up as points close.  Points that a chunk shares
with the chunk before or after it (prefixes of its first or last string) stay open; they go, with what the chunk holds of them,
to one last pass of the same stack, which sees at most two paths a chunk.  Every edge keeps the sums of words from each of its
turns to its end, from which the nodes with a single child are made at last.

Of texts only digests and counts of words are shuffled.  A conversation is one row with its turns' digests (22 bytes and a count
each).  The ids of equal conversations are hashed in order as they pass, so a group of any size needs constant memory; where a
group lies over several tasks, pieces of up to a megabyte of its list go to one hasher.  Parents with many children are joined
by broadcast (``hot``).

Nulls: rows without a conversation id take no part; turns are ordered null first; null role or text is empty.  Ties: equal turn numbers of a
conversation are ordered by their digests.  Repeated rows are turns of their own.  Empty texts are turns; a conversation rebuilt without
turns is a member of the root alone.  Texts of any length count whole.  An empty table gives no nodes.  conv_id, turn, role and text are read
alone, so clashing column names don't matter.  c % 20 has the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.llm.hot import with_facts
from skyloom.sources.staging import written

#: Characters of a turn's digest: 132 bits of SHA-256 in base64.
WIDTH = 22
#: A chunk's strings and characters, about.
STRINGS, CHARACTERS = 1 << 14, 1 << 23
#: Characters of a piece of an id list.
PIECE = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: structs of turn, digest and words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.base64(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))), 1, WIDTH)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), words.alias("words")).alias("e"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("e")).alias("turns"))


def rebuilt(conversations: DataFrame, span: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, key (its turns' digests joined), words (of each): the first h turns of the conversation that begins its ``span`` ids, then its own
    after as many; h is the id's crc32 modulo ``heads``."""
    own = written(turns_of(conversations), "turns")
    first = own.filter(F.col("conv_id") % span == 0).select(F.col("conv_id").alias("_of"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.withColumn("_h", h).join(first, F.col("conv_id") - F.col("conv_id") % span == F.col("_of"), "left")  # ``span`` ids have one head
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")), F.slice("turns", F.col("_h") + 1, F.size("turns")))
    return both.select("conv_id", turns.alias("t")).select("conv_id", F.array_join("t.digest", "").alias("key"), F.col("t.words").alias("words"))


# the stack -------------------------------------------------------------------------------------------------------


@dataclass(slots=True)
class Point:
    """A branch, an end or a leaf at so many turns, with what is known of its subtree but for its own edge."""

    depth: int
    n: int = 0
    conv_id: int | None = None
    leaves: int = 0
    below: int = 0
    children: int = 0

    def add(self, n: int, conv_id: int | None, leaves: int, below: int, children: int) -> None:
        self.n, self.leaves, self.below, self.children = self.n + n, self.leaves + leaves, self.below + below, self.children + children
        if conv_id is not None:
            self.conv_id = conv_id if self.conv_id is None else min(conv_id, self.conv_id)


POINT = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("leaves", pa.int64()), ("below", pa.int64()), ("children", pa.int64())])
EDGE = pa.schema([
    ("node", pa.string()), ("parent", pa.string()), ("depth", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("leaves", pa.int64()), ("below", pa.int64()), ("children", pa.int64()),
    ("suffix", pa.list_(pa.int64())), ("key", pa.string()), ("words", pa.list_(pa.int64())), ("points", pa.list_(POINT)),
])
EDGE_DDL = "node string, parent string, depth long, n long, conv_id long, leaves long, below long, children long, suffix array<bigint>, key string, words array<bigint>, points array<struct<depth:bigint,n:bigint,conv_id:bigint,leaves:bigint,below:bigint,children:bigint>>"


def name_of(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()[:32]


def shared(a: str, b: str) -> int:
    """Turns that two strings begin with in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a.startswith(b[low * WIDTH : at * WIDTH], low * WIDTH) else (low, at - 1)
    return low


def grow(rows: Iterator[tuple[str, list[int], list[Point]]], left: int, right: int) -> Iterator[dict]:
    """Edges of the compressed tree of strings in ascending order, each with the words of its turns and with points on its path.
    ``left``, ``right``: turns that the first and last share with the strings around them, -1 where nothing may follow, so that the root
    closes too.  Points at such depths come as ``points`` of one path each."""
    stack, opened, lefts = [Point(max(left, 0))], left, []
    first: tuple[str, list[int]] | None = None
    key, sums = "", [0]

    def edge(p: Point, above: Point | None) -> dict:
        a = above.depth if above else -1
        leaves, whole = p.leaves if p.children else 1, sums[p.depth] - sums[max(a, 0)]
        if above:
            above.add(p.n, p.conv_id, leaves, p.below + (p.n - 1) * whole, 1)
        suffix = [sums[p.depth] - s for s in sums[a : p.depth]] if above else [0]
        return {"node": name_of(key[: p.depth * WIDTH]), "parent": name_of(key[: a * WIDTH]) if above else None, "depth": p.depth, "n": p.n, "conv_id": p.conv_id, "leaves": leaves, "below": p.below, "children": p.children, "suffix": suffix}

    def cut(depth: int) -> Iterator[dict]:
        while stack and stack[-1].depth > depth:
            p = stack.pop()
            if depth >= 0 and (not stack or stack[-1].depth < depth):
                stack.append(Point(depth))
            if p.depth <= opened:
                lefts.append(p)
            else:
                yield edge(p, stack[-1] if stack else None)

    for new, words, points in rows:
        if first is None:
            first = new, words
        else:
            depth = shared(key, new)
            yield from cut(depth)
            opened = min(opened, depth)
        key, sums = new, [0, *accumulate(words)]
        for p in points:
            at = len(stack)
            while at and stack[at - 1].depth > p.depth:
                at -= 1
            if at and stack[at - 1].depth == p.depth:
                stack[at - 1].add(p.n, p.conv_id, p.leaves, p.below, p.children)
            else:
                stack.insert(at, p)
    yield from cut(right)
    for path, words, points in ((*(first or ("", [])), sorted(lefts, key=lambda p: p.depth)), (key, None, stack)):
        if points:
            depth = points[-1].depth
            own = words if words is not None else [b - a for a, b in zip(sums, sums[1:])]
            yield {"key": path[: depth * WIDTH], "words": own[:depth], "points": [{c: getattr(p, c) for c in Point.__slots__} for p in points]}


# over the cluster ------------------------------------------------------------------------------------------------


def _chunks(strings: DataFrame) -> DataFrame:
    """Chunks of sorted strings: lists of key, words, n and conv_id, with the turns shared with the strings around the chunk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, characters = [], 0, 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), table[c].chunk(0))
            ends = [table["key"][:1].chunk(0), table["key"][rows - 1 :].chunk(0)]
            return pa.RecordBatch.from_arrays([*(e.cast(pa.string()) for e in ends), *map(one, ("key", "words", "n", "conv_id"))], ["first", "last", "key", "words", "n", "conv_id"])

        for b in batches:
            for low in range(0, b.num_rows, step := min(1024, STRINGS)):
                some = b.slice(low, step)
                held.append(some)
                rows, characters = rows + some.num_rows, characters + some["key"].nbytes
                if rows >= STRINGS or characters >= CHARACTERS:
                    yield chunk()
                    held, rows, characters = [], 0, 0
        if rows:
            yield chunk()

    ordered = strings.select("key", "words", "n", "conv_id").repartitionByRange("key").sortWithinPartitions("key")
    chunks = written(ordered.mapInArrow(pack, "first string, last string, key array<string>, words array<array<bigint>>, n array<bigint>, conv_id array<bigint>"), "chunks")
    w = Window.orderBy("first")  # a row a chunk
    ends = chunks.select("first", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    return chunks.join(ends, "first")


def _edges(strings: DataFrame) -> DataFrame:
    """The compressed tree: ``EDGE`` without the columns of open paths."""
    schema = EDGE

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                keys, words, n, conv = (b[c][r].as_py() for c in ("key", "words", "n", "conv_id"))
                before, after = b["before"][r].as_py(), b["after"][r].as_py()
                left = 0 if before is None else shared(before, keys[0])
                right = 0 if after is None else shared(keys[-1], after)
                rows = ((k, w, [Point(len(w), m, c)]) for k, w, m, c in zip(keys, words, n, conv))
                yield from _batches(grow(rows, left, right), schema)

    def across(table: pa.Table) -> pa.Table:
        rows = ((r["key"], r["words"], [Point(**p) for p in r["points"]]) for r in table.select(["key", "words", "points"]).sort_by("key").to_pylist())
        return pa.Table.from_batches(_batches(grow(rows, -1, -1), schema), schema)

    found = written(_chunks(strings).mapInArrow(within, EDGE_DDL), "edges")
    open_ = found.filter("points IS NOT NULL").groupBy().applyInArrow(across, EDGE_DDL)  # two paths a chunk at most
    return found.filter("points IS NULL").unionByName(open_).drop("key", "words", "points")


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def ends_of(members: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of a node's conversation ids in ascending order, joined by commas. ``members``: node, conv_id."""

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's first and last node may go on in its neighbours, and long lists go in pieces
        out: list[tuple] = []
        node, low, ids, length, whole = None, 0, [], 0, False

        def flush(done: bool) -> None:
            nonlocal ids, length, whole
            text = ",".join(map(str, ids))
            out.append((node, low, None, hashlib.sha256(text.encode()).hexdigest()) if done and whole else (node, low, text, None))
            ids, length, whole = [], 0, False

        def batch() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))], ["node", "low", "piece", "ends_sha256"])

        for b in batches:
            for name, conv in zip(b["node"].to_pylist(), b["conv_id"].to_pylist()):
                if name != node:
                    if ids:
                        flush(True)
                    whole, node, low = node is not None, name, conv
                elif length >= PIECE:
                    flush(False)
                    low = conv
                ids.append(conv)
                length += 20
            if out:
                yield batch()
        if ids:
            flush(False)
            yield batch()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        done: list[tuple[str, str]] = []
        for b in batches:
            for name, piece in zip(b["node"].to_pylist(), b["piece"].to_pylist()):
                if name != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = name, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
        if node is not None:
            done.append((node, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["node", "ends_sha256"])

    ordered = members.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    found = written(ordered.mapInArrow(in_order, "node string, low long, piece string, ends_sha256 string"), "ends")
    rest = found.filter("piece IS NOT NULL").repartition("node").sortWithinPartitions("node", "low").select("node", "piece")
    return found.filter("piece IS NULL").select("node", "ends_sha256").unionByName(rest.mapInArrow(joined, "node string, ends_sha256 string"))


def _name(key: str) -> Column:
    return F.substring(F.sha2(F.col(key).cast("binary"), 256), 1, 32)


def nodes(strings: DataFrame) -> DataFrame:
    """Every node of the tree of ``strings`` (conv_id, key, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    strings = written(strings.withColumn("node", _name("key")), "strings")
    once = strings.groupBy("key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    edges = written(_edges(once), "tree")
    above = edges.filter("children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"), "children")
    edges = with_facts(edges, "parent", above, "children", ["node"])
    edges = edges.join(ends_of(strings), "node", "left")
    turns = edges.select("*", F.size("suffix").alias("_size"), F.posexplode("suffix").alias("_at", "_words"))
    top, bottom = F.col("_at") == 0, F.col("_at") == F.col("_size") - 1
    return turns.select(
        "conv_id", (F.col("depth") - F.col("_size") + 1 + F.col("_at")).cast("long").alias("depth"), F.when(top, F.col("_above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * F.col("_words")).alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends_sha256")), F.lit(NOTHING)).alias("ends_sha256"),
    )
