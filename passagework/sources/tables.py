"""Tables in and out: parquet, catalog tables, SQL, local rows and run files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVAL_ROW = T.StructType([
    T.StructField("inputs", T.StructType([
        T.StructField("messages", T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]))),
    ])),
    T.StructField("expectations", T.StructType([
        T.StructField("expected_facts", T.ArrayType(T.StringType())),
    ])),
])

RUN_FILE = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("optimized_score", T.DoubleType()),
    T.StructField("improvement", T.DoubleType()),
    # Each entry is either an object or a ["stage", score] pair, so it stays JSON text.
    T.StructField("optimization_history", T.StringType()),
])

DEMO = T.StructType([
    T.StructField("augmented", T.BooleanType()),
    T.StructField("question", T.StringType()),
    T.StructField("original_question", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("rewritten_query", T.StringType()),
])

PROGRAM_STAGE = T.StructType([
    T.StructField("demos", T.ArrayType(DEMO)),
    T.StructField("signature", T.StructType([
        T.StructField("instructions", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StructType([
            T.StructField("prefix", T.StringType()),
            T.StructField("description", T.StringType()),
        ]))),
    ])),
])


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, on storage every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="passagework-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a folder of parquet tables."""
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))


def stream_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The files of one table as a stream, whether the table is one file or a folder of files."""
    schema = read_parquet(spark, folder, table).schema
    # A stream takes a single file only where its path is a pattern.
    return spark.readStream.schema(schema).parquet(os.path.join(folder, f"{{{table}}}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Split a scan that has fewer partitions than there are task slots.

    A large table already arrives in many splits and is returned unchanged, so
    no shuffle is added to it.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


def save_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Overwrite a catalog table and read it back, so later steps do not recompute it."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name, path=path)
    return df.sparkSession.table(name)


def save_parquet(df: DataFrame, path: str) -> DataFrame:
    """Overwrite a parquet folder and read it back, so later steps do not recompute it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query_tables(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over named DataFrames."""
    return spark.sql(query, **tables)


def eval_rows(spark: SparkSession, rows: list) -> DataFrame:
    """Evaluation rows held by the caller, with the declared nested schema."""
    return spark.createDataFrame(rows, EVAL_ROW)


def first_rows(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows in a stated order; the cut happens in the plan."""
    return df.orderBy(*order).limit(limit)


def read_run_files(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Saved run records as one row per accepted stage.

    A record is a line of JSON, or with ``one_per_file`` a whole file. Runs without
    an accepted stage keep one row with a null stage.
    """
    runs = spark.read.schema(RUN_FILE).option("multiLine", one_per_file).json(path)
    entries = F.from_json("optimization_history", T.ArrayType(T.StringType()))
    return runs.select(
        "run_id", "strategy", "base_score", "optimized_score", "improvement",
        F.posexplode_outer(entries).alias("position", "entry"),
    ).select(
        "run_id", "strategy", "base_score", "optimized_score", "improvement", "position",
        F.coalesce(
            F.get_json_object("entry", "$.stage"), F.get_json_object("entry", "$[0]")
        ).alias("stage"),
        F.coalesce(
            F.get_json_object("entry", "$.score"), F.get_json_object("entry", "$[1]")
        ).cast("double").alias("score"),
    )


def read_program_files(
    spark: SparkSession, path: str, stages: list[str], one_per_file: bool = False
) -> DataFrame:
    """Saved few-shot programs as one row per demo: (file, stage, position, demo fields)."""
    schema = T.StructType([T.StructField(stage, PROGRAM_STAGE) for stage in stages])
    files = spark.read.schema(schema).option("multiLine", one_per_file).json(path).withColumn(
        "file", F.col("_metadata.file_path")
    )
    per_stage = files.select(
        "file",
        F.explode(F.array(*[
            F.struct(F.lit(stage).alias("stage"), F.col(f"`{stage}`").alias("program"))
            for stage in stages
        ])).alias("s"),
    )
    return per_stage.select(
        "file",
        "s.stage",
        F.col("s.program.signature.instructions").alias("instructions"),
        F.posexplode("s.program.demos").alias("position", "demo"),
    ).select("file", "stage", "instructions", "position", "demo.*")


def append_runs(records: DataFrame, path: str) -> None:
    """Append run records to the ledger, one partition folder per strategy."""
    records.withColumn("logged_at", F.current_timestamp()).write.mode("append").partitionBy(
        "strategy"
    ).parquet(path)
