import random
import re
from collections import defaultdict

from skyloom.llm import jaccard
from skyloom.llm.components import components
from tests.llm.data import frame, prose, texts

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(k)].append(d)
    return sorted((str(d), len(sets[k]), str((min(ids[find(k)]) if ids[find(k)] else None) if sets[k] else d)) for k, (d, _) in enumerate(rows))


def check(spark, rows, **more):
    got = jaccard.similarity_classes(frame(spark, rows), **more).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute([r[:2] for r in rows])


def test_defined_cases(spark):
    check(spark, texts())


def chains(seed, groups=12, members=25, most=40):
    """Groups around the threshold: each member changes its predecessor a little, so components are chains."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = prose(1000 * seed + g, rng.randrange(6, 160)).split()
        for _ in range(members):
            words = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // most) + 1)):
                words[rng.randrange(len(words))] = f"y{rng.randrange(300)}"
            rows.append((len(rows) * 7 % 1009 + 5000 * (len(rows) % 2), " ".join(words), "en", "s"))
    rng.shuffle(rows)
    return rows


def test_chains_and_hubs(spark):
    check(spark, chains(1))


def test_exact_step_alone(spark):
    check(spark, chains(3, groups=6, members=15, most=12), star_rounds=0)


def test_shuffle_join_in_place_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    check(spark, chains(4, groups=4, members=10))


def test_classes_whose_digests_begin_alike(spark, monkeypatch):
    """The workers, too, see the digest patched: by a function that travels with the plan."""
    import sys

    from pyspark import cloudpickle

    plain = jaccard.class_of
    monkeypatch.setattr(jaccard, "class_of", lambda g: (plain(g)[0] % 3, plain(g)[1]))
    cloudpickle.register_pickle_by_value(sys.modules[jaccard.__name__])
    try:
        check(spark, chains(5, groups=4, members=10))
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[jaccard.__name__])


def test_passages_that_many_share(spark):
    passage = prose(77, 60)
    check(spark, [(k, prose(3000 + k, 40 + k) + " " + passage, "en", "s") for k in range(60)] + [(100 + k, passage + f" tail{k}", "en", "s") for k in range(20)])


def test_deduplicated_keeps_one_of_each(spark):
    docs = frame(spark)
    out = jaccard.deduplicated(docs)
    assert out.columns == docs.columns
    got = out.collect()
    by = {}
    rows = [r[:2] for r in texts()]
    for (d, n, c), _ in zip(brute(rows), rows):
        by.setdefault(c, []).append(d)
    words = [r for r in got if grams(r.text)]
    assert len([r for r in got if not grams(r.text)]) == sum(not grams(t) for _, t in rows)
    assert len({frozenset(grams(r.text)) for r in words}) == len(words)
    assert all(r.doc_id not in range(61, 66) for r in got)
    assert len(words) == len({r.root for r in jaccard.similarity_classes(docs).collect() if r.n_shingles})


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(50)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a in parent if find(a) != a}


def test_empty_table(spark):
    assert jaccard.similarity_classes(frame(spark).limit(0)).count() == 0
    assert jaccard.deduplicated(frame(spark).limit(0)).count() == 0
