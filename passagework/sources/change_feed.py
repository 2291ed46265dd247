"""Recorded tables: every overwrite is kept as a version and a change list, which can be streamed.

``overwrite_recorded`` writes a new version of a table and what changed since the one before.
``ChangeFeed`` is a stream source over the change lists: an offset is the number of a version,
a batch holds all rows of the versions since the last one, and each row says whether it was
inserted, updated or deleted, and in which version.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from passagework.operators.changes import change_feed
from passagework.sources.tables import save_parquet


# Bytes of a column of a change list that are read at a time.
READ_BYTES = 1 << 20


def _number(version: int) -> str:
    return f"{version:010d}"


def latest_version(spark: SparkSession, folder: str) -> int:
    """The newest version of a recorded table, -1 before the first."""
    try:
        noted = spark.read.schema("version long").json(f"{folder}/noted")
    except AnalysisException:
        return -1
    last = noted.agg(F.max("version").alias("version")).first()["version"]
    return -1 if last is None else last


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of a recorded table, by default the newest."""
    version = latest_version(spark, folder) if version is None else version
    if version < 0:
        raise FileNotFoundError(f"no recorded table in {folder}")
    return spark.read.parquet(f"{folder}/versions/{_number(version)}")


def read_changes(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The change list of one version: the table's columns, ``change_type`` and ``version``."""
    return spark.read.parquet(f"{folder}/changes/{_number(version)}")


def overwrite_recorded(new: DataFrame, folder: str, key: str) -> int:
    """Write ``new`` as the next version with its change list; returns the version.

    Keys are unique and not null. Only keys and digests are compared; the new values of
    changed rows are then fetched by their keys. A deleted row keeps its key alone. A version
    counts once it is noted, after both folders are written, so a failed attempt leaves
    nothing behind that is read and the next one replaces it. The first version's list holds
    every row as inserted.
    """
    spark = new.sparkSession
    version = latest_version(spark, folder) + 1
    table = save_parquet(new, f"{folder}/versions/{_number(version)}")
    columns = [c for c in table.columns if c != key]
    if version == 0:
        listed = table.withColumn("change_type", F.lit("insert"))
    else:
        listed = change_feed(read_version(spark, folder, version - 1), table, key, columns)
    listed.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(
        f"{folder}/changes/{_number(version)}"
    )
    # One file, so the version is noted or not.
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{folder}/noted")
    return version


def feed_schema(table: DataFrame) -> T.StructType:
    """The columns of a table's change lists."""
    return T.StructType([*table.schema.fields, T.StructField("change_type", T.StringType()), T.StructField("version", T.LongType())])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChangeFeedReader(DataSourceStreamReader):
    """Offsets are versions; a file of a change list is one task's work, read in batches."""

    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.schema = folder, schema

    def _open(self, folder: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)

    def _files(self, below: str, ending: str) -> list[str]:
        store, root = self._open(self.folder)
        found = store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{below}", allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith(ending) and not f.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        store, _ = self._open(self.folder)
        last = -1
        for path in self._files("noted", ".json"):
            with store.open_input_stream(path) as file:
                last = max([last, *(json.loads(line)["version"] for line in file.read().splitlines() if line)])
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [
            _File(path)
            for version in range(start["version"] + 1, end["version"] + 1)
            for path in self._files(f"changes/{_number(version)}", ".parquet")
        ]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        store, _ = self._open(self.folder)
        with store.open_input_file(partition.path) as file:
            # Buffered, or a row group's whole column is in memory at once.
            for batch in pq.ParquetFile(file, buffer_size=READ_BYTES).iter_batches(batch_size=1024, columns=wanted.names):
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in wanted], schema=wanted)


class ChangeFeed(DataSource):
    """``spark.readStream.format("change_feed").schema(feed_schema(table)).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def streamReader(self, schema: T.StructType) -> ChangeFeedReader:
        return ChangeFeedReader(self.options["path"], schema)


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of a recorded table's changes, from its first version on."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").schema(feed_schema(read_version(spark, folder))).load(folder)
