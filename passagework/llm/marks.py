"""Stretches to remove from documents: gathered, merged and sent back to the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import SENT_ROWS, same, save, text_key

# Bytes of stretches that may be sent to every task beside the documents' ids.
SENT_BYTES = 16 << 20


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches [start, end) as sorted stretches that don't touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([first[1:], [True]])
    return starts[first], ends[last]


def ints(rows: list[np.ndarray]) -> pa.Array:
    """A column of integer arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def per_document(stretches: DataFrame) -> DataFrame:
    """(_id, _key, starts, ends) with one row per document, from rows of arrays ``starts`` and ``ends``.

    A document's stretches are at most as many as its positions, so a row stays small.
    """
    gathered = stretches.groupBy("_id", "_key").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [
                merged(s.values.to_numpy(zero_copy_only=False), e.values.to_numpy(zero_copy_only=False))
                for s, e in zip(batch.column("starts"), batch.column("ends"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), ints([p[0] for p in pairs]), ints([p[1] for p in pairs])],
                names=["_id", "_key", "starts", "ends"],
            )

    return gathered.mapInArrow(run, gathered.schema)


def own_columns(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(_id, _key, _text) of documents; null texts read as empty."""
    return docs.select(
        F.col(id).alias("_id"), text_key(F.col(text)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )


def beside(own: DataFrame, marks: DataFrame, weight: str | None, how: str) -> DataFrame:
    """Join saved rows by document to the texts; they are sent to the tasks only if few and small.

    ``weight`` is an expression for the array elements of a row; without it the join is
    left to the planner, for rows that are no smaller than the texts.
    """
    if weight is not None:
        rows, elements = marks.agg(F.count("*"), F.coalesce(F.sum(F.expr(weight)), F.lit(0))).first()
        if rows <= SENT_ROWS and 8 * elements <= SENT_BYTES:
            marks = F.broadcast(marks)
    others = [c for c in marks.columns if c not in ("_id", "_key")]
    return own.join(marks, same(own, marks, "_id", "_key"), how).select(
        own["_id"], own["_key"], own["_text"], *[marks[c] for c in others]
    )


def apply_marks(
    own: DataFrame, stretches: DataFrame, cut: Callable, fields: list[tuple[str, str]], kind: T.DataType
) -> DataFrame:
    """(_id, _key, fields of ``cut``) per document; ``cut(text, starts, ends)`` gives a row's values.

    ``stretches`` has one row per document, see ``per_document``.
    """
    marks = save(stretches, "marks")
    marked = beside(own, marks, "2 * size(starts)", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            rows = [
                cut(
                    text.as_py(),
                    s.values.to_numpy(zero_copy_only=False).astype(np.int64) if s.is_valid else none,
                    e.values.to_numpy(zero_copy_only=False).astype(np.int64) if e.is_valid else none,
                )
                for text, s, e in zip(batch.column("_text"), batch.column("starts"), batch.column("ends"))
            ]
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), *(
                    pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)
                )],
                names=["_id", "_key", *(name for name, _ in fields)],
            )

    schema = f"_id {kind.simpleString()}, _key long, " + ", ".join(f"{n} {t}" for n, t in fields)
    return marked.mapInArrow(run, schema)
