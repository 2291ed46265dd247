"""Keep an index table in step with a changing source table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.sources.tables import save_parquet, work_dir

# Changed keys that may be sent to every task.
FEW_CHANGES = 200_000


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def _digests(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    content = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(key, F.sha2(content, 256).alias(name))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Row changes between two snapshots: (key, change_type) for changed keys only.

    Only keys and digests of the compared columns are shuffled, never the texts.
    """
    before = _digests(old, key, columns, "_before")
    after = _digests(new, key, columns, "_after")
    change = (
        F.when(F.col("_before").isNull(), "insert")
        .when(F.col("_after").isNull(), "delete")
        .when(F.col("_before") != F.col("_after"), "update")
    )
    return (
        before.join(after, key, "full_outer")
        .select(key, change.alias("change_type"))
        .filter(F.col("change_type").isNotNull())
    )


def _sent_if_few(keys: DataFrame) -> DataFrame:
    """A saved table of keys, sent to every task while it is short, so that texts stay where they are."""
    return F.broadcast(keys) if keys.limit(FEW_CHANGES + 1).count() <= FEW_CHANGES else keys


def change_feed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Row changes with the new values; deleted rows carry nulls.

    The list of changed keys is written once. While it is short, only the texts of changed
    rows move.
    """
    changed = save_parquet(snapshot_diff(old, new, key, columns), work_dir(new.sparkSession, "changes"))
    fresh = new.select(key, *columns).join(_sent_if_few(changed.filter("change_type != 'delete'")), key)
    gone = changed.filter("change_type = 'delete'").select(
        key, *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in columns], "change_type"
    )
    return fresh.select(key, *columns, "change_type").unionByName(gone)


def index_upsert(index: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The index after its changed rows were replaced, added or removed.

    ``changes`` has the index's columns and ``change_type``, one row per key. It is written
    once, and its keys are sent to the index while they are few.
    """
    changes = save_parquet(changes, work_dir(index.sparkSession, "upsert"))
    kept = index.join(_sent_if_few(changes.select(key)), key, "left_anti").select(*index.columns)
    current = changes.filter(F.col("change_type") != "delete").select(*index.columns)
    return kept.unionByName(current)


def latest_versions(log: DataFrame, key: str, version: str) -> DataFrame:
    """The last logged row of each key; pre-aggregated, so a hot key is no problem."""
    fields = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(
        F.max_by(F.struct(*fields), F.col(version)).alias("_row")
    ).select(key, *[F.col(f"_row.{c}").alias(c) for c in fields])


def index_status(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """One row: source and indexed keys, missing, orphaned, and whether the index is ready."""
    sides = source.select(key, F.lit(1).alias("in_source"), F.lit(0).alias("in_index")).unionByName(
        index.select(key, F.lit(0).alias("in_source"), F.lit(1).alias("in_index"))
    )
    per_key = sides.groupBy(key).agg(
        F.max("in_source").alias("in_source"), F.max("in_index").alias("in_index")
    )
    totals = per_key.agg(
        F.coalesce(F.sum("in_source"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("in_index"), F.lit(0)).alias("indexed_rows"),
        F.count_if((F.col("in_source") == 1) & (F.col("in_index") == 0)).alias("missing"),
        F.count_if((F.col("in_source") == 0) & (F.col("in_index") == 1)).alias("orphaned"),
    )
    return totals.withColumn("ready", F.col("missing") + F.col("orphaned") == 0)
