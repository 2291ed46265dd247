"""Corpus job: clean, filter, chunk, give ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.markup import (
    MIN_TEXT_CHARS,
    decode_entities,
    drop_markup,
    drop_tags,
)
from passagework.functions.slices import per_text
from passagework.operators.steps import settle

# Chunk length and overlap in characters.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 50


def keep_long_texts(df: DataFrame, text: str = "text", min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Rows whose text has at least ``min_chars`` characters."""
    return df.filter(F.length(text) >= min_chars)


def clean_markup(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace a marked-up text by its plain form; null and empty give the empty string."""
    bare = settle(df, text, drop_tags(F.col(text)))
    decoded = bare.withColumn("_decoded", decode_entities(F.col(text)))
    plain = drop_markup(F.coalesce("_decoded", text))
    return settle(decoded, text, plain).drop("_decoded")


def clean_corpus(df: DataFrame, text: str = "text", min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Replace the text by its cleaned form and keep the rows that stay long enough.

    Cleaning never lengthens a text, so rows that start too short are dropped
    before any work is spent on them.
    """
    raw = keep_long_texts(df, text, min_chars)
    return keep_long_texts(clean_markup(raw, text), text, min_chars)


def _with_chunks(
    df: DataFrame, pieces: Column, key: str, text: str, keep_empty: bool = False
) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, text)]
    explode = F.posexplode_outer if keep_empty else F.posexplode
    exploded = df.select(key, *rest, explode(pieces).alias("chunk_id", "chunk"))
    parts = F.concat(F.col(key).cast("string"), F.lit("_"), F.col("chunk_id").cast("string"))
    # The chunk stands where the text stood; the other columns keep their order.
    kept = ["chunk" if c == text else c for c in df.columns if c != key]
    return exploded.select(parts.alias("id"), "chunk_id", *kept)


def fixed_chunks(
    df: DataFrame,
    key: str,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per fixed-stride piece of each text, with id ``<key>_<ordinal>``."""
    stride = size - overlap
    if overlap < 0 or stride <= 0:
        raise ValueError("need 0 <= overlap < size")
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), last, F.lit(stride)),
        lambda start: F.substring(F.col(text), start + 1, F.lit(size)),
    )
    return _with_chunks(df, pieces, key, text)


def boundary_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of one text, cut at the coarsest boundary that fits.

    Each piece is a window of ``size`` characters cut back to its last paragraph
    break, else line break, else space, else not at all; a break inside the first
    ``overlap`` characters does not count. The next piece starts after the first
    space or line break within the last ``overlap`` characters of the piece, else
    at the cut.
    """
    spans = []
    start = 0
    while len(text) - start > size:
        length = size
        for mark in ("\n\n", "\n", " "):
            found = text.rfind(mark, start, start + size)
            if found >= 0 and found + len(mark) - start > overlap:
                length = found + len(mark) - start
                break
        cut = start + length
        spans.append((start, cut))
        breaks = [i for i in (text.find(m, cut - overlap, cut) for m in "\n ") if i >= 0]
        start = min(breaks) + 1 if breaks else cut
    spans.append((start, len(text)))
    return spans


def split_at_boundaries(text: str, size: int, overlap: int) -> list[str]:
    """The pieces of one text."""
    return [text[start:end] for start, end in boundary_spans(text, size, overlap)]


def boundary_chunks(
    df: DataFrame,
    key: str,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per boundary-aware piece of each text; only the text crosses to Python.

    A null text gives no row, or with ``keep_empty`` one row without id and chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")

    pieces = per_text(lambda t: split_at_boundaries(t, size, overlap), T.ArrayType(T.StringType()))
    return _with_chunks(df, pieces(F.col(text)), key, text, keep_empty)
