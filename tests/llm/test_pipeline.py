import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest

import __spark_entry__
from skyloom.llm import packing
from skyloom.llm.pretokens import Encoder
from tests.llm.data import frame
from tests.llm.test_jaccard import grams
from tests.llm.test_quality import brute as quality_brute
from tests.llm.test_secrets import base, more
from tests.llm.test_tokens import BYTE


def test_run_against_brute_force(spark, tmp_path):
    """Each stage by brute force on what the one before it kept; an empty table too. The quality rule's verdict is held against a dense
    estimate in test_quality, its base rule here."""
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = frame(spark)
    assert len(corpus_pipeline.STAGES) == 4
    out = corpus_pipeline.keep_quality(spark, docs, "")
    assert out.columns == docs.columns
    kept = out.collect()
    assert all(not quality_brute(r.text)[-1] for r in kept) and len(kept) > 40
    sets, stay = [grams(r.text) for r in kept], []
    parent = list(range(len(kept)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for a, r in enumerate(kept):
        groups.setdefault(find(a), []).append(r)
    for own in groups.values():
        least = min(own, key=lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5(f"{'-' if r.doc_id is None else r.doc_id}:{r.text or ''}".encode()).hexdigest()))
        stay.append(least)
    left = {r.doc_id for r in stay}
    assert set(range(12, 40)) <= left and left.isdisjoint(range(61, 68))
    lib = Encoder(BYTE).library
    want = []
    for r in stay:
        text, at = "", 0
        spans = sorted((a, b) for a, _, b in base(r.text) + more(r.text))
        for k, (a, b) in enumerate(spans):
            if a > at or k == 0:
                text += r.text[at:a] + "[SECRET]"
            at = max(at, b)
        ids = [*lib.encode(text + r.text[at:], add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(str(r.doc_id), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(held) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + 1


def test_run_on_an_empty_table(spark, tmp_path):
    frame(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_each_operator_has_a_query(name):
    assert len([q for q in __spark_entry__.queries() if q.startswith(name + "_")]) == 1


def test_oracle_of_lists(spark):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(f"SELECT page_id, fetched_s, blocked, lists, matched FROM ({__spark_entry__.oracle_sql()['op6_temporal_lists']}) ORDER BY page_id").fetchall()
    got = __spark_entry__.queries()["op6_temporal_lists"](spark, sf).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want
