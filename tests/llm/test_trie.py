import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from skyloom.llm import trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("key", "node", "words", "depth", "e", "_h"))])
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, *("clash",) * 6) for r in rows], SCHEMA).repartition(3)


def sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    import base64

    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda e: (e[0], e[1], base64.b64encode(e[2])))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    return out


def brute(rows):
    seqs, nodes = sequences(rows), {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    saved, leaves = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = own + sum(saved[x] for x in kids.get(k, []))
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) if k in kids else 1
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k)))))) for k, m in nodes.items()), key=str)


def made(seed, convs=120, alphabet=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "bot"][: 1 + alphabet // 3]), " ".join(["w"] * rng.randrange(alphabet)) + str(rng.randrange(alphabet))))
    return rows


CASES = [
    (None, 0, "user", "nobody"), (0, None, "user", "null turn first"), (0, 1, "user", None), (0, 0, None, ""), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (21, 3, "u", "x y\tz"), (21, None, None, None),
    (-5, 0, "user", "one"), (-5, 1, "user", "two"), (-20, 0, "user", "head"), (-21, 0, "u", "alone"), (40, 0, "user", "long " * 50_000), (41, 0, "user", "é\x1c 世界"), (41, 1, "user", "b"), (7_000_000_000_000, 0, "user", "a"),
] + [(k, t, "user", f"t{t}") for k in (60, 61, 62, 63, 79) for t in range(40)]


@pytest.mark.parametrize("rows", [CASES, [], CASES[:1], made(1), made(2, 60, 2, 12), [(k, t, "user", "same") for k in range(300) for t in range(3)]])
def test_same_as_every_prefix(spark, rows):
    got = trie.nodes(trie.rebuilt(frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(40))
def test_chunks_of_any_size_make_the_same_tree(seed):
    """Edges of the tree of all strings at once, and by chunks with a last pass over their open paths."""
    rng = random.Random(seed)
    width = trie.WIDTH
    letters = [c * width for c in "abcd"[: rng.randrange(2, 5)]]
    strings = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(0, rng.choice([3, 6, 12])))) for _ in range(rng.randrange(1, 60))})
    word = {c: k + 1 for k, c in enumerate("abcd")}
    rows = [(s, [word[c] for c in s[::width]], rng.randrange(1, 4), rng.randrange(1000)) for s in strings]
    points = lambda part: ((s, w, [trie.Point(len(w), n, c)]) for s, w, n, c in part)
    plain = lambda edges: sorted((tuple(e[c] for c in ("node", "parent", "depth", "n", "conv_id", "leaves", "below", "children")), tuple(e["suffix"])) for e in edges)
    whole = list(trie.grow(points(rows), -1, -1))
    assert all("node" in e for e in whole)
    for size in (1, 2, 3, 7):
        closed, paths = [], []
        for low in range(0, len(rows), size):
            part = rows[low : low + size]
            left = trie.shared(rows[low - 1][0], part[0][0]) if low else 0
            right = trie.shared(part[-1][0], rows[low + size][0]) if low + size < len(rows) else 0
            for e in trie.grow(points(part), left, right):
                (closed if "node" in e else paths).append(e)
        last = trie.grow(((p["key"], p["words"], [trie.Point(**x) for x in p["points"]]) for p in sorted(paths, key=lambda p: p["key"])), -1, -1)
        assert plain(closed + list(last)) == plain(whole)


def test_many_chunks_over_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRINGS", 3)
    rows = made(5, 200, 3, 8)
    assert sorted(map(tuple, trie.nodes(trie.rebuilt(frame(spark, rows))).collect()), key=str) == brute(rows)


def test_lists_in_pieces(spark):
    members = [("a" * 32, k) for k in range(120_000)] + [("b" * 32, 5), ("c" * 32, -7), ("c" * 32, 3)]
    df = spark.createDataFrame(members, "node string, conv_id long").repartition(7)
    assert df.count() * 20 > trie.PIECE
    want = {n: sha(",".join(str(k) for m, k in members if m == n)) for n in ("a" * 32, "b" * 32, "c" * 32)}
    assert {r.node: r.ends_sha256 for r in trie.ends_of(df).collect()} == want
