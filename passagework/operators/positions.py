"""Order-dependent steps that must not sort one key inside one task.

A key may hold a large part of all rows, so each key is cut into buckets of its
order column. Rows are ranked inside their bucket, and a small table with one row
per bucket carries what the earlier buckets contribute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from passagework.sources.tables import save_parquet, work_dir

BUCKET_WIDTH = 4096
SAMPLE_PER_BUCKET = 32


def _bucketed(df: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """Rows with their bucket. A row without key or ordinal has no place and is left out."""
    placeable = df.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    return placeable.withColumn("_bucket", F.floor(F.col(order) / width))


def _offsets(bucketed: DataFrame, key: str) -> DataFrame:
    """One row per bucket: rows in the key's earlier buckets, and its next bucket."""
    counts = bucketed.groupBy(key, "_bucket").agg(F.count("*").alias("_rows"))
    by_key = Window.partitionBy(key).orderBy("_bucket")
    earlier = F.sum("_rows").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(
        key,
        "_bucket",
        F.coalesce(earlier, F.lit(0)).alias("_offset"),
        F.lead("_bucket").over(by_key).alias("_next_bucket"),
    )


def position_in_key(
    df: DataFrame, key: str, order: str, name: str = "position", width: int = BUCKET_WIDTH
) -> DataFrame:
    """Add the 0-based position of each row within its key.

    ``order`` is an ordinal such as a turn number, unique within the key. A task
    ranks at most one bucket of ``width`` ordinals of one key.
    """
    bucketed = _bucketed(df, key, order, width)
    within = Window.partitionBy(key, "_bucket").orderBy(order)
    return (
        bucketed.join(_offsets(bucketed, key), [key, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_bucket", "_offset", "_next_bucket")
    )


def with_next(
    df: DataFrame, key: str, order: str, columns: list[str], width: int = BUCKET_WIDTH
) -> DataFrame:
    """Add each row's ``position`` in its key, and ``next``, the given columns of the row after.

    Only a bucket's last row looks further, into the first row of the key's next bucket.
    """
    bucketed = _bucketed(df, key, order, width)
    offsets = _offsets(bucketed, key)
    within = Window.partitionBy(key, "_bucket").orderBy(order)
    row = F.struct(*columns)
    placed = (
        bucketed.join(offsets, [key, "_bucket"])
        .withColumn("_nth", F.row_number().over(within))
        .withColumn("position", F.col("_offset") + F.col("_nth") - 1)
        .withColumn("next", F.lead(row).over(within))
    )
    at_edge = F.col("next").isNull() & F.col("_next_bucket").isNotNull()
    # First rows of buckets, out of the same exchange as the rows themselves.
    starts = placed.filter("_nth = 1 and _offset > 0").select(
        key, F.col("_bucket").alias("_next_bucket"), row.alias("next")
    )
    edges = placed.filter(at_edge).drop("next").join(starts, [key, "_next_bucket"])
    kept = [*df.columns, "position", "next"]
    return placed.filter(~at_edge).select(*kept).unionByName(edges.select(*kept))


def best_before(
    df: DataFrame, key: str, order: str, value: str, name: str, width: int = BUCKET_WIDTH
) -> DataFrame:
    """Add the largest ``value`` among the rows of the key that come earlier in order."""
    bucketed = _bucketed(df, key, order, width)
    peaks = bucketed.groupBy(key, "_bucket").agg(F.max(value).alias("_peak"))
    by_key = Window.partitionBy(key).orderBy("_bucket")
    earlier = peaks.select(
        key,
        "_bucket",
        F.max("_peak").over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
    )
    within = Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        bucketed.join(earlier, [key, "_bucket"])
        .withColumn(name, F.greatest("_earlier", F.max(value).over(within)))
        .drop("_bucket", "_earlier")
    )


def position_in_table(
    df: DataFrame, order: str, name: str = "position", buckets: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in the whole table.

    The order column is unique and of any ordered type. Its values are cut into buckets at
    quantiles of a bounded sample in hash order, so buckets hold similar row counts
    whatever the distribution. Their number follows the session's shuffle partitions, so
    the offset table is small and one bucket is one task's work. Rows without a key are
    left out.
    """
    if buckets is None:
        buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.filter(F.col(order).isNotNull())
    sample = keyed.select(order).orderBy(F.xxhash64(order), order).limit(SAMPLE_PER_BUCKET * buckets)
    values = sorted(row[0] for row in sample.collect())
    kind = df.schema[order].dataType
    cuts = [F.lit(values[i * len(values) // buckets]).cast(kind) for i in range(1, buckets)] if values else []
    bucket = F.size(F.filter(F.array(*cuts), lambda cut: cut <= F.col(order))) if cuts else F.lit(0)
    bucketed = keyed.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_bucket").agg(F.count("*").alias("_rows")).select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_bucket").orderBy(order)
    return (
        bucketed.join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_bucket", "_offset")
    )


def key_at(df: DataFrame, order: str, position: int, rows_per_range: int = 1_000_000):
    """The value at a 0-based position of a column's order; None beyond the last, nulls left out.

    Only this column is shuffled, once. Its ranges are counted, and the one that holds the
    position is the only one that is sorted.
    """
    keys = df.select(F.col(order).alias("key")).filter(F.col("key").isNotNull())
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // rows_per_range))
    # Written down: the ranges come from a sample, which another run would draw anew.
    dealt = save_parquet(
        keys.repartitionByRange(ranges, "key", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()),
        work_dir(spark, "ranges"),
    )
    for row in dealt.groupBy("range").count().orderBy("range").collect():  # one row per range
        if position < row["count"]:
            found = dealt.filter(F.col("range") == row["range"]).orderBy("key").offset(position).limit(1).collect()
            return found[0]["key"]
        position -= row["count"]
    return None
