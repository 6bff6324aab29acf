import zlib
from array import array

import hashlib
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st

from skyloom.llm import bytebpe, counts, eliasfano, packing
from skyloom.llm.pretokens import SPACE_BLIND, Encoder
from tests.llm.data import frame, texts

BYTE, WORD, RANKS = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoders():
    return {p: Encoder(p, limit=50) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def ranks():
    import tiktoken

    return bytebpe.RankEncoder(RANKS, limit=50), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


ANY = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'abcsXYZ019.,éİſŉ<|>")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(text=ANY)
def test_ids_as_the_library(encoders, text):
    for e in encoders.values():
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids
        assert e.count(text) == len(e.library.encode(text, add_special_tokens=False).ids)


FOREIGN = [
    "Es heißt „Übung“ – ‘so’ — “quoted” it’s… €5", "Съешь ещё этих мягких французских булок, да выпей чаю. " * 400, "世界上有很多语言。你好，世界！ " * 300, "日本語のテキスト ｶﾀｶﾅ １２３", "ελληνικά Ελλάδα ΣΑΣ", "हिन्दी में पाठ ١٢٣ ไทย한국어",
    "\U0001f600\U0001f468\u200d\U0001f469\u200d\U0001f467 é́ ﬁ İstanbul ß ẞ", "a\u3000b\xa0c\u2028d\x85e\x1cf", "世<|endoftext|><|startoftext|>’<|endoftext|>x <|endof", "<|endoftext|>", "plain<|endoftext|> text <|startoftext|>",
]


def test_other_scripts_and_special_strings(encoders, monkeypatch):
    """Through tables, too: the library's ``encode`` isn't called."""
    for e in encoders.values():
        want = [e.library.encode(t, add_special_tokens=False).ids for t in FOREIGN]
        assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in FOREIGN] == want
        assert [e.count(t) for t in FOREIGN] == [len(w) for w in want]
        assert e.split is not None


def test_files_of_other_kinds(tmp_path):
    """A split or normalizer that isn't known here is left to the library."""
    from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

    t = Tokenizer.from_file(BYTE)
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\p{N}{1,3}|[^\p{N}]+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.normalizer = normalizers.Sequence([normalizers.NFKC(), normalizers.Replace("a", "b")])
    t.save(str(tmp_path / "own.json"))
    e = Encoder(str(tmp_path / "own.json"))
    assert e.split is None
    for text in [*FOREIGN, "banana 12345 ﬁ"]:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(text=ANY)
def test_rank_ids_and_round_trip(ranks, text):
    own, exact = ranks
    raw = np.frombuffer(own.encode(text), "<u4")
    ids = raw.tolist()
    assert ids == exact.encode_ordinary(text)  # though the library alone decides
    assert own.decode(ids) == text.encode()
    spans = list(zip(*own.offsets(text, raw)))
    assert len(spans) == len(ids) and (not spans or (spans[0][0] == 0 and spans[-1][1] == len(text)))
    assert all(a < b for a, b in spans)


@settings(max_examples=200, deadline=None)
@given(text=st.text("ab ", max_size=80))
def test_runs_of_few_letters(ranks, text):
    assert np.frombuffer(ranks[0].encode(text), "<u4").tolist() == ranks[1].encode_ordinary(text)


def test_whole_library_pipeline_agrees(ranks):
    for _, t, *_ in texts():
        if t and all(c not in t for c in "\x1c\x1d\x85"):
            assert ranks[0].library.encode(t, add_special_tokens=False).ids == ranks[1].encode_ordinary(t)
            assert ranks[0].library.decode(ranks[1].encode_ordinary(t)) == t


def test_token_counts(spark):
    lib = Encoder(BYTE).library
    got = sorted((str(r[0]), r[1], r[2]) for r in counts.token_counts(frame(spark), BYTE).collect())
    assert got == sorted((str(d), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in texts())
    assert counts.token_counts(frame(spark).limit(0), BYTE).count() == 0


def test_byte_bpe_digests_and_decoding(spark, ranks):
    got = sorted((str(r[0]), *r[1:]) for r in bytebpe.digests(frame(spark), RANKS).collect())
    want = []
    for d, t, *_ in texts():
        ids = ranks[1].encode_ordinary(t or "")
        places = ranks[1].decode_with_offsets(ids)[1]
        want.append((str(d), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), places))
    assert [r[:-1] for r in got] == [w[:-1] for w in sorted(want)]
    coded = bytebpe.encode(frame(spark), RANKS).collect()
    assert sorted(r[-1] for r in got) == sorted(zlib.crc32(np.array(r.starts + r.ends, "<u4").tobytes()) for r in coded)
    firsts = {str(r.doc_id): r.starts for r in coded if r.doc_id is not None and r.doc_id > 40}
    assert all(firsts[w[0]] == w[-1] for w in want if w[0] in firsts)
    back = bytebpe.decode(bytebpe.encode(frame(spark), RANKS), RANKS).collect()
    assert sorted((str(r.doc_id), r.decode_text) for r in back) == sorted((str(d), t or "") for d, t, *_ in texts())
    assert bytebpe.digests(frame(spark).limit(0), RANKS).count() == 0


def test_cut_inside_a_character(ranks):
    raw = np.frombuffer(ranks[0].encode("\U0001f9ff"), "<u4")
    ids = raw.tolist()
    assert len(ids) > 1
    assert ranks[0].decode(ids[:1]).decode(errors="replace") == "�"
    assert set(zip(*ranks[0].offsets("\U0001f9ff", raw))) == {(0, 1)}


def test_overlapping_parts_without_the_rank_library(ranks):
    """Runs of letters and of whole tokens, where ties between overlapping pairs decide."""
    own, exact = ranks
    rng = np.random.default_rng(1)
    tokens = [t.decode() for t in bytebpe.read_ranks(RANKS) if t.isalpha() and t.isascii() and len(t) > 2]
    pieces = ["".join(rng.choice(tokens, 4)) for _ in range(4000)] + [c * n for c in "aelost =-." for n in range(1, 90)] + ["".join(rng.choice(list("abo"), 60)) for _ in range(2000)]
    for p in pieces:
        assert [x.id for x in own.library.model.tokenize(bytebpe.byte_chars(p))] == exact._encode_single_piece(p.encode())


# Elias-Fano ------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(steps=st.lists(st.integers(0, 5000), max_size=1500), first=st.integers(0, 2**40))
def test_elias_fano(steps, first):
    values = np.cumsum([first, *steps])
    coded, _ = eliasfano.EliasFano.from_bytes(eliasfano.EliasFano.encode(values).to_bytes(), 0)
    assert coded.decode().tolist() == values.tolist()
    for i in {0, len(values) // 2, len(values) - 1, min(len(values) - 1, eliasfano.EVERY), min(len(values) - 1, eliasfano.EVERY - 1)}:
        assert coded[i] == values[i]
    n, top = len(values), int(values[-1])
    assert len(coded.to_bytes()) <= eliasfano.PART.size + 4 * (n // eliasfano.EVERY + 1) + 2 + n * (2 + max(0, (top // n).bit_length())) / 8 + 1


def test_file_of_nulls_and_negative_ids():
    ids = np.arange(6, dtype="<u4")
    f = eliasfano.IdFile(eliasfano.file_bytes(1, 2, [None, -7, -7, 2**62], [1, 2, 0, 3], ids.tobytes(), False) + b"\n")
    assert f.doc_ids() == [None, -7, -7, 2**62]
    assert [f[i].tolist() for i in range(4)] == [[0], [1, 2], [], [3, 4, 5]]


def test_files_round_trip(spark, tmp_path):
    lib = Encoder(WORD).library
    own = {}
    rows = sorted(((d if d is not None else -(2**63), t) for d, t, *_ in texts()), key=lambda r: r[0])
    got = eliasfano.round_trip(frame(spark), WORD, 1).orderBy("start").collect()
    assert [r.doc_id if r.doc_id is not None else -(2**63) for r in got] == [d for d, _ in rows]
    want = sorted((d, zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -(2**63), r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    eliasfano.write_files(frame(spark), str(tmp_path / "ids"), WORD, 1, file_ids=500)
    small = eliasfano.read_files(spark, str(tmp_path / "ids"))
    assert sorted((r.start, r.ids_crc32) for r in small.collect()) == sorted((r.start, r.ids_crc32) for r in got)
    assert eliasfano.round_trip(frame(spark).limit(0), WORD, 1).count() == 0


# packing ---------------------------------------------------------------------------------------------------------


def optimum(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + lengths[k] <= capacity}.values():
            place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_best_fit(lengths):
    v = np.array(lengths, np.int64)
    bound, best = packing.lower_bound(v, 20), optimum(lengths, 20)
    bins, offsets = packing.best_fit_decreasing(v, 20)
    used = len(set(bins.tolist()))
    assert bound <= best <= used <= 11 / 9 * best + 1
    for b in set(bins.tolist()):
        own = sorted((o, w) for o, w, x in zip(offsets.tolist(), lengths, bins.tolist()) if x == b)
        assert [o for o, _ in own] == np.cumsum([0, *(w for _, w in own)])[:-1].tolist() and sum(w for _, w in own) <= 20


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_packing(spark, part_rows):
    lib, capacity = Encoder(BYTE).library, 256
    got = packing.pack(frame(spark), BYTE, capacity, 0, part_rows=part_rows, with_ids=True).collect()
    want = []
    for d, t, *_ in texts():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        want += [(str(d), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(w for _, w in own)])[:-1].tolist() and sum(w for _, w in own) <= capacity
    bound = packing.lower_bound(np.array([r.length for r in got]), capacity)
    assert len(bins) <= bound + (1 if part_rows > 100 else 6)
    assert packing.pack(frame(spark).limit(0), BYTE, capacity, 0).count() == 0


def test_file_rows_come_from_samples(monkeypatch):
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (511, 3), (512, 900), (513, 70), (3000, 2000)):
        lengths = rng.integers(0, top, n).tolist()
        names = [None] * min(n, 2) + sorted(rng.integers(-(2**63), 2**63, max(n - 2, 0)).tolist())
        ends = np.cumsum([0, *lengths]).tolist()
        f = eliasfano.IdFile(eliasfano.file_bytes(0, 0, names, lengths, np.zeros(ends[-1], "<u4").tobytes(), False))
        with monkeypatch.context() as m:
            m.setattr(eliasfano.EliasFano, "decode", None)
            assert list(f.rows()) == list(zip(names, ends, ends[1:]))


def test_plain_texts_need_no_step_for_white_space():
    """The word file's split takes white space of any length alike, so texts aren't rewritten first; ids are the library's."""
    own = Encoder(WORD)
    assert own.steps == [str.lower]
    for text in ("a  b\t\tC\r\n\n d", " 's  'S\n'll", "x<|endoftext|>  <|endoftext|\t>", "\t", "", "1  2\n3 é  É", "a\xa0 b  c"):
        assert list(array("I", own.encode(text))) == own.library.encode(text, add_special_tokens=False).ids
    for pattern in (r"\s+|[\p{L}]+", r"[^\p{L}]+", r"[\p{L}]+(?=\s)", r"[\p{L}]+ ", "."):
        assert SPACE_BLIND.fullmatch(pattern) is None
