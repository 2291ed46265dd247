"""Counts of a text that quality rules and scores are made of, one pass in Arrow batches."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import save

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops", "n_marks", "n_long",
)
_GAPS = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``.

    Words are separated by ASCII white space. A line counts as repeated when it has a word
    and equals an earlier line; a word, when a window of three words that holds it occurs
    twice or more in the text.
    """
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(words)
    lines, seen, repeated = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(_GAPS):
            lines += 1
            if line in seen:
                repeated += 1
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, k in Counter(windows).items() if k > 1}
    covered, end = 0, 0
    if often:
        for i, window in enumerate(windows):
            if window in often:
                covered += i + 3 - max(i, end)
                end = i + 3
    ascii_caps = sum(map(str.isupper, text))
    return (
        n, len(text) - sum(map(text.count, _GAPS)), sum(map(text.count, _SYMBOLS)), repeated, covered,
        len(text), lines, len(set(words)), ascii_caps, sum(map(text.count, "0123456789")),
        sum(map(text.count, ".?!")), sum(map(text.count, ",;:()\"'!?")), sum(len(w) > 24 for w in words),
    )


def with_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _key, and a long for each of ``COUNTS``), one row per document; null reads as empty."""
    own = docs.select(
        F.col(id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.col(text).alias("_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(value.as_py() or "") for value in batch.column("_text")]
            columns = list(zip(*rows)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["_id", "_key", *COUNTS],
            )

    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(run, f"_id {kind}, _key long, " + ", ".join(f"{c} long" for c in COUNTS))


def measures() -> dict[str, Column]:
    """Comparable measures of a text from its counts; 0 where the divisor is."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"),
        "capitals": share("n_upper", "n_chars"),
        "digits": share("n_digits", "n_chars"),
        "stops": share("n_stops", "n_words"),
        "marks": share("n_marks", "n_words"),
        "line_words": share("n_words", "n_lines"),
        "long_words": share("n_long", "n_words"),
    }


def labelled(counts: DataFrame, labels: DataFrame, label: str, id: str = "doc_id") -> DataFrame:
    """(_id, _label, the measures) of every labelled document, written down.

    A document labelled twice has the smaller label; rows equal in all of this count once.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(
        F.min(F.col(label)).cast("int").alias("_label")
    )
    rows = counts.join(known, "_id").select("_id", "_label", *[m.alias(name) for name, m in measures().items()])
    return save(rows.distinct(), "labelled")


def sampled(rows: DataFrame, most: int):
    """At most ``most`` rows of ``labelled``, the same in every run, as pandas.

    All of them if there are no more; else those with the smallest hash. A bound on the hash,
    ten standard deviations above what is wanted, cuts the rows before they are ordered, so
    that tasks send the driver about ``most`` rows between them, however many there are.
    """
    place = F.xxhash64("_id", *measures())
    n, spare = rows.count(), most + 10 * math.isqrt(most)
    if n > spare:
        rows = rows.where(place < -(1 << 63) + (spare << 64) // n)
    return rows.orderBy(place, "_id", *measures()).limit(most).toPandas()
