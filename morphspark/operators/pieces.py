"""Arrow functions that take a batch a few texts at a time and give each such piece as a batch: what they hold doesn't grow with a batch, nor do the batches that go back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of the texts of a piece. A longer text is a piece by itself.
BYTES = 1 << 18


def pieces(column: pa.Array, most: int = BYTES) -> Iterator[pa.Array]:
    """Every row of the column, in its order."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(ends, most + (ends[begin - 1] if begin else 0), side="right")))
        yield column.slice(begin, end - begin)
        begin = end


def text_function(kind: str) -> Callable:
    """Makes a function from a list of texts, some of them None, to an Arrow array of as many values one of a column of texts."""

    def of(f: Callable[[list[str | None]], pa.Array]) -> Callable:
        @F.arrow_udf(kind)
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                for piece in pieces(column):
                    yield f(piece.to_pylist())

        return run

    return of
