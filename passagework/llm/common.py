"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.sources.tables import work_dir

# Rows of one or two numbers each that may be sent to every task (about 16 MB); more are joined by shuffle.
SENT_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage in storage that outlives an executor, so nothing is computed twice.
    """
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = SENT_ROWS) -> bool:
    """Whether a table has few enough rows to send to every task. ``df`` should be saved."""
    return df.limit(rows + 1).count() <= rows


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """The saved table with a broadcast hint if its size allows, else as it is."""
    return F.broadcast(df) if small(df, rows) else df


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns of the same name."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def without(docs: DataFrame, rejected: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``rejected(_id, _key)`` does not name."""
    gone = sent_if_small(save(rejected.select("_id", "_key").distinct(), "rejected"))
    return docs.join(
        gone,
        docs[id].eqNullSafe(gone["_id"]) & (text_key(docs[text]) == gone["_key"]),
        "left_anti",
    )


def sha(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(F.encode(text, "UTF-8"), 256)
