"""Token counts without token ids: pieces of each distinct pre-token, joined to per-document frequencies.

Each document becomes a table of distinct pre-tokens with their frequencies; each worker keeps a table of pre-tokens
with their number of pieces, filled by one call of the library's merges for each pre-token that it has not met;
the join of the two and the sum of products give the document's count.  The join stays within the worker: sent over
the cluster, the frequencies (317 rows a document on the check data) would be larger than the texts themselves, and the table
has no size bound that would let it be broadcast.  Special strings count one each, as the library's default has it.

Null text counts as empty; null ids and repeated rows are kept; an empty table gives no rows; texts of any length go whole (a worker
holds one text's distinct pre-tokens).  doc_id and text are read alone, so clashing column names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from skyloom.llm.pretokens import encoder
from skyloom.llm.rowwise import spread

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens for the tokenizers file at ``path`` (on every executor)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for b in batches:
            text = pc.fill_null(b["text"], "")
            n = [pieces.count(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(count, SCHEMA)
