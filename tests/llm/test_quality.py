import re
from collections import Counter

import numpy as np


from skyloom.llm import quality
from tests.llm.data import frame, prose, texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_statistics(spark):
    got = quality.quality(frame(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = sorted((str(d), *brute(t)) for d, t, *_ in texts())
    assert sorted((str(r[0]), *r[1:7]) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def table(spark, groups):
    """Statistics with vectors as wished: {(lang, source): array of (log words, log word length, root of marks, log share of distinct words)}."""
    rows = []
    for (lang, source), x in groups.items():
        for w, length, marks, distinct in x:
            n = max(10, round(np.exp(w)))
            chars = round(n * np.exp(length))
            rows.append((len(rows), n, chars, 0, 0, 0, max(0, round(marks**2 * chars)), max(1, min(n, round(n * np.exp(distinct)))), f"{lang}\x01{source}", False))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, n_distinct long, grp string, base_failed boolean"
    return spark.createDataFrame(rows, schema).repartition(3)


def by_group(rng, n, mean, mix):
    return np.array(mean) + rng.normal(size=(n, 4)) @ np.array(mix)


def dense(x):
    """The estimate in numpy over one group's whole vectors: distances, log determinant of the best three quarters."""
    live = np.median(np.abs(x - np.median(x, 0)), 0) > 0
    x = x[:, live]
    n, p = x.shape
    need, mid = int(np.ceil(quality.TRIM * n)), np.median(x, 0)
    mad = 1.4826 * np.sort(np.abs(x - np.sort(x, 0)[(n - 1) // 2]), 0)[(n - 1) // 2]
    mid = np.sort(x, 0)[(n - 1) // 2]
    z = (x - mid) / mad
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    u = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0) * mad
    distance = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    ended = []
    for m, s in ((mid, np.diag(mad**2)), (x.mean(0), np.cov(x.T, bias=True)), (mid, u.T @ u / n)):
        last = np.inf
        while True:
            d2 = distance(m, s)
            near = x[d2 <= np.sort(d2)[need - 1]]
            m, s = near.mean(0), np.cov(near.T, bias=True)
            if (det := np.linalg.slogdet(s)[1]) >= last - 1e-9:
                break
            last = det
        ended.append((det, m, s))
    det, m, s = min(ended, key=lambda e: round(e[0], 6))
    near = x[distance(m, s) <= quality.CONSISTENT_75[p - 1] * quality.CHI_975[p - 1]]
    return distance(near.mean(0), np.cov(near.T, bias=True) * quality.CONSISTENT_975[p - 1]), det, p


def groups_of_many_shapes():
    """Correlated vectors, each group with its own place, scale and correlation; one in twenty is odd only against the correlation."""
    rng = np.random.default_rng(11)
    out = {}
    for k, (n, scale, slope) in enumerate(((400, 1.0, 0.9), (300, 0.4, -0.8), (120, 1.6, 0.0), (60, 0.7, 0.5))):
        mix = np.diag([0.5, 0.05, 0.02, 0.05]) * scale
        mix[0, 3] = slope * 0.1  # longer ones have more or fewer distinct words
        x = by_group(rng, n, [5.5 + 0.4 * k, 1.5 + 0.15 * k, 0.17 + 0.03 * k, -0.6 + 0.1 * k], mix)
        x[:: 20, 3] -= np.sign(slope or 1) * 0.6 * scale
        out["ab"[k % 2], f"s{k}"] = x
    return out


def test_same_as_a_dense_estimate_by_group(spark):
    rng = np.random.default_rng(5)
    one = by_group(rng, 200, [5.5, 1.6, 0.17, -0.5], np.diag([0.5, 0.05, 0.02, 0.05]))
    copies = {("a", "thrice"): np.repeat(one, 3, 0), ("a", "alike"): np.repeat(one[:1], 100, 0)}
    stats = table(spark, groups_of_many_shapes() | copies)
    rows = stats.select("grp", *quality.vector()).collect()
    told = {r.grp: r for r in quality.estimates(stats).collect()}
    # copies alone have no scatter: their language judges them
    assert {g: r.pool for g, r in told.items()} == {g: "la" if g.endswith("alike") else g for g in told}
    kept, x = [], []
    for grp, r in told.items():
        own = np.array([g[1:] for g in rows if g.grp == grp], float)
        every = np.array([g[1:] for g in rows if g.grp == grp or r.pool == "l" + g.grp[0]], float)
        d2, det, p = dense(every)
        w, m = np.array(r.w), np.array(r.m)
        mine = (((every - m) @ w.T) ** 2).sum(1)
        assert p == r.p == 4 and abs(det - r.logdet) < 1e-6
        assert np.allclose(mine, d2, rtol=1e-6)  # nothing is added to a scatter
        if r.pool == grp:
            kept.append(d2 <= quality.CUT[p - 1])
            x.append(own[:, :4])
    kept, x = np.concatenate(kept), np.concatenate(x)
    assert (~kept).sum() > 20
    # one fixed diagonal for all groups can't give that verdict, whatever its cut
    plain = (((x - np.median(x, 0)) / np.median(np.abs(x - np.median(x, 0)), 0)) ** 2).sum(1)
    assert min(int(((plain <= cut) != kept).sum()) for cut in np.sort(plain)) > 10


def test_documents_that_are_all_alike_are_kept(spark):
    alike = quality.judged(table(spark, {("en", "a"): np.array([[5.5, 1.6, 0.17, -0.5]] * 80)})).collect()
    assert len(alike) == 80 and all(r.kept and r.d2 == 0 for r in alike)


def natural(seed, words, symbols=0.0):
    """Prose with commas and stops here and there, and so many symbols a character."""
    rng = np.random.default_rng(seed)
    text = " ".join(w + ("," if rng.random() < 0.1 else "." if rng.random() < 0.07 else "") for w in prose(seed, words).split())
    return text + " " * bool(symbols) + "#" * int(symbols * len(text))


def test_verdicts_on_texts(spark):
    """Symbols reject, odd ones don't; small groups are judged by their language or by all."""
    docs = [(k, natural(k, 60 + k % 90), "en", "a") for k in range(200)]
    docs += [(1000 + k, natural(500 + k, 90, 0.25), "en", "a") for k in range(5)] + [(2000 + k, natural(600 + k, 90) + " & <b", "en", "a") for k in range(5)]
    docs += [(3000 + k, natural(k, 60 + k % 90, 0.25 * (k in (0, 3, 44))), ("it", "de", "fr")[k % 3], f"s{k % 20}") for k in range(240)]  # 4 a group; 80 a language
    docs += [(4000, natural(7, 80), None, None), (4001, "###" + " ###" * 9, "xx", "x"), (4002, natural(8, 80, 0.3), "xx", "x")]
    got = {r.doc_id: r for r in quality.quality(frame(spark, docs)).collect()}
    assert all(r.d2 is not None for r in got.values())
    assert {d for d, r in got.items() if not r.kept} == {*range(1000, 1005), 3000, 3003, 3044, 4001, 4002}


def test_filtered_rows_are_whole(spark):
    docs = frame(spark)
    out = quality.filtered(docs)
    assert out.columns == docs.columns
    kept = {tuple(r) for r in out.collect()}
    assert kept <= {tuple(r) for r in docs.collect()}
    assert {r[0] for r in kept} >= set(range(12, 40))  # shorter ones are odd beside the many copies here


def test_empty_table(spark):
    assert quality.quality(frame(spark).limit(0)).count() == 0
