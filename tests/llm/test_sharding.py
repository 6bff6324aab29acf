import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from skyloom.llm import sharding
from tests.llm.data import frame, texts


@settings(max_examples=80, deadline=None)
@given(n=st.integers(1, 3000), seed=st.integers(0, 2**63))
def test_permutation(n, seed):
    out = sharding.permute(np.arange(n), n, seed)
    assert sorted(out.tolist()) == list(range(n))


def test_it_shuffles():
    out = sharding.permute(np.arange(100_000), 100_000, 3)
    assert abs(np.corrcoef(np.arange(100_000), out)[0, 1]) < 0.02
    assert (sharding.permute(np.arange(100_000), 100_000, 4) == out).mean() < 0.001


def test_shards(spark):
    got = sharding.shards(frame(spark)).collect()
    rows = texts()
    want = sorted((-1 if d is None else d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, *_ in rows)
    numbered = sorted(got, key=lambda r: r.row_number)
    assert [r.row_number for r in numbered] == list(range(len(rows)))
    assert [(-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in numbered] == want
    place = sharding.permute(np.arange(len(rows)), len(rows), 20240229)
    assert all((r.shard, r.slot) == (place[r.row_number] % 8, place[r.row_number] // 8) for r in got)
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and len(own) in (len(rows) // 8, len(rows) // 8 + 1)
    again = sharding.shards(frame(spark).repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert sharding.shards(frame(spark).limit(0)).count() == 0
