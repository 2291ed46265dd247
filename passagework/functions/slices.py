"""Python functions over texts, applied to a slice of an Arrow batch at a time.

A batch of the session's size may hold many long texts. Only a slice of it is turned into
Python objects at once, so what a worker needs beside the batch does not grow with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts, and bytes of texts, that are Python objects at a time. One text is never cut.
SLICE_ROWS = 512
SLICE_BYTES = 1 << 20


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in slices within both bounds; a longer text is a slice of its own."""
    start, rows, size = 0, 0, 0
    for length in pa.compute.binary_length(texts).fill_null(0).to_pylist():
        if rows and (rows == SLICE_ROWS or size + length > SLICE_BYTES):
            yield texts.slice(start, rows)
            start, rows, size = start + rows, 0, 0
        rows, size = rows + 1, size + length
    if rows:
        yield texts.slice(start, rows)


def sliced(change: Callable[[list[str | None]], pa.Array], kind: T.DataType):
    """A column function of one text column from ``change``, which maps a list of texts to as many values."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in text_slices(texts):
                yield change(part.to_pylist())

    return run


def per_text(change: Callable[[str], object], kind: T.DataType):
    """A column function that applies ``change`` to every text; null stays null."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    return sliced(lambda texts: pa.array([None if t is None else change(t) for t in texts], arrow), kind)
