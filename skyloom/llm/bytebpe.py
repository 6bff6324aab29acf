"""Byte-level BPE from a rank file, by the ``tokenizers`` library over Arrow batches; decoding by the byte table.

The rank file's tokens become strings in which every byte is a character (``BYTE_CHARS``).  A rank file merges any two parts
whose join is a token, the least rank first and the leftmost of equals; the library merges listed pairs in the list's order.  The two
agree when each token is listed with one pair, the last that the rank rule itself merges on the token's own bytes: inside a
token's span merges happen in the same order wherever it stands, as long as none crosses its ends, so no other pair
can come to lie there.  ``merges`` finds these pairs; ids are the library's alone.  Every match of the split pattern is
encoded for itself; a match that is a token as a whole is that token.

Offsets are characters: byte lengths of the tokens, summed, looked up in the text's table of bytes to characters.  Decoding joins the
tokens' strings and reverses the byte table: characters split over tokens come together again; a cut inside a character
becomes U+FFFD in ``decode_text`` and stays as bytes in ``decode``.

Nulls: a null text is an empty one; null ids and repeated rows are kept; an empty table gives no rows; texts of any length go
whole (a worker holds one batch's texts and their ids).  doc_id and text are read alone, so clashing column names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from skyloom.llm.pretokens import BYTE_CHARS, CHAR_BYTES, NOT_PLAIN, Table, byte_chars, encoder, plain_split
from skyloom.llm.rowwise import spread


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def shown(token: bytes) -> str:
    return token.decode("latin-1").translate(BYTE_CHARS)


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last two parts that the rank rule joins to the token; None where it never comes to two."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        found = [(ranks[j], k) for k in range(len(parts) - 1) if (j := parts[k] + parts[k + 1]) in ranks]
        if not found:
            return None
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """One pair for each token, by rank. A token with one way to be cut into two needs no search: another pair can't arise."""
    out = []
    for t in sorted(ranks, key=ranks.get):
        cuts = [(t[:k], t[k:]) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pair = cuts[0] if len(cuts) == 1 else last_pair(t, ranks) if cuts else None
        if pair is not None:
            out.append(pair)
    return out


class RankEncoder:
    """``path``: a rank file; ``pattern``: the split."""

    def __init__(self, path: str, pattern: str | None = None, limit: int = 400_000):
        import public_tokenizers
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        pattern = pattern or public_tokenizers.PATTERN
        ranks = read_ranks(path)
        names = {t: shown(t) for t in ranks}
        pairs = [(names[a], names[b]) for a, b in merges(ranks)]
        self.library = Tokenizer(models.BPE({names[t]: r for t, r in ranks.items()}, pairs, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.library.decoder = decoders.ByteLevel()
        size = max(ranks.values()) + 1
        self.shown, self.lengths = [""] * size, np.zeros(size, np.int64)
        for t, r in ranks.items():
            self.shown[r], self.lengths[r] = names[t], len(t)
        self.decimal = [str(i) for i in range(size)]
        self.any, self.fast = regex.compile(pattern).findall, plain_split(pattern).findall if pattern == public_tokenizers.PATTERN else None
        merge = self.library.model.tokenize
        self.ids = Table(lambda token: array("I", [p.id for p in merge(byte_chars(token))]).tobytes(), limit)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self.ids.turn()
        split = self.fast if self.fast and NOT_PLAIN.search(text) is None else self.any
        return b"".join(map(self.ids.__getitem__, split(text)))

    def decode(self, ids: list[int]) -> bytes:
        return "".join(map(self.shown.__getitem__, ids)).translate(CHAR_BYTES).encode("latin-1")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; tokens that share a character each have the whole of it."""
        char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        return char[ends - self.lengths[ids]], char[ends - 1] + 1


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and the first and last character (exclusive) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, RankEncoder)
        for b in batches:
            texts = [t.as_py() or "" for t in b["text"]]
            ids = [np.frombuffer(codec.encode(t), "<u4") for t in texts]
            spans = [codec.offsets(t, i) for t, i in zip(texts, ids)]
            columns = [ids, *([s[k] for s in spans] for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([x.tolist() for x in c], pa.list_(pa.int32())) for c in columns)], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded bytes and their text (a cut inside a character becomes U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, RankEncoder)
        for b in batches:
            raw = [codec.decode(i.as_py() or []) for i in b["ids"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(raw, pa.binary()), pa.array([r.decode(errors="replace") for r in raw], pa.string())], ["doc_id", "bytes", "decode_text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary, decode_text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes, and the CRC-32 of the tokens' offsets
    (first characters, then ends, as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, RankEncoder)
        for b in batches:
            rows = []
            for cell in b["text"]:
                text = cell.as_py() or ""
                raw = np.frombuffer(codec.encode(text), "<u4")
                ids, places = raw.tolist(), b"".join(x.astype("<u4").tobytes() for x in codec.offsets(text, raw))
                told = ",".join(map(codec.decimal.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), zlib.crc32(places)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long")
