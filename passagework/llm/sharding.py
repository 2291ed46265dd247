"""Contiguous shards of equal bytes, from prefix sums over a global order.

Rows are dealt into ranges of the order; each range sums its own bytes, the totals of the
ranges are summed up front, and a row's place in bytes is its range's offset plus what
precedes it in the range. Shards are cut where that place passes equal targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import save, sent_if_small

ROWS_PER_RANGE = 1_000_000


def sharded(
    rows: DataFrame, size: Column, order: Sequence[str], shards: int, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 without gaps in a shard).

    Shards are contiguous in ``order`` (nulls first, rows equal there in the order of the
    input). A row goes to the shard whose equal share of all bytes holds the row's middle, so
    a shard departs from an equal share by half a row at either end; shards within one very
    large row stay empty. A null or negative size counts as 0. Any row may repeat: ranges are
    cut between repeated rows too. An empty table gives an empty one, and rows of no size at
    all go to shard 0. Other columns are kept; those called ``shard`` or ``slot`` are
    replaced. Rows are exchanged twice, so choose the columns that are needed before.
    """
    if shards < 1:
        raise ValueError("shards have to be one or more")
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_range))
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    given = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("given"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in order], F.monotonically_increasing_id()).alias("key"),
    )
    # The range of a row is written down: it must not depend on a sample drawn anew.
    dealt = save(given.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row per range, a million times fewer than rows.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sent_if_small(save(totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    ), "offsets"))
    own = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select(
        "given", "range", "size", F.sum("size").over(own).alias("through"), F.count("*").over(own).alias("nth")
    ).join(offsets, "range")
    cut = placed.select(
        "given",
        (F.col("rows_before") + F.col("nth")).alias("nth"),
        # Twice the place of the row's middle, in shares of twice all bytes.
        F.when(F.col("all_bytes") > 0, F.least(F.lit(shards - 1), F.expr(
            f"{shards} * (2 * (bytes_before + through) - size) div (2 * all_bytes)"
        ))).otherwise(0).cast("int").alias("shard"),
    )
    cut = save(cut, "cut")
    # As many rows as shards.
    firsts = cut.groupBy("shard").agg(F.min("nth").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "given.*", "shard", (F.col("nth") - F.col("first")).alias("slot")
    )


def write_shards(rows: DataFrame, path: str) -> None:
    """Write the result of ``sharded`` with one folder per shard, rows by slot within each file."""
    per = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    per.write.mode("overwrite").partitionBy("shard").parquet(path)


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32): bytes of the text plus 1 and its unsigned checksum; null reads as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id), (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(F.encode(value, "UTF-8")).alias("text_crc32")
    )


def digest(docs: DataFrame, shards: int) -> DataFrame:
    """The contract's columns, by the law of equal bytes."""
    found = sharded(measured(docs), F.col("size"), ["doc_id", "text_crc32", "size"], shards)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
