"""The binned map over a stream: its state is one row of sums a pixel, whatever has come in.

An addition of this engine: weight blocks and right-hand sides are sums, so late or repeated batches need no
watermark, and the map is solved from the sums whenever it is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyloom.operators import pixel_blocks, pointing


def sums(stream: DataFrame, value: str) -> DataFrame:
    """pix, hits, the weight block's upper triangle and the right-hand side i, q, u."""
    return pointing.sums(stream, value)


def solved(state: DataFrame, cut: float = pixel_blocks.RCOND_CUT) -> DataFrame:
    return pixel_blocks.solved_rows(state, cut)
