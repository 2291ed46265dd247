"""Keep a chunk index in step with a growing folder of articles.

Every micro-batch writes its changed articles' chunks to its own folder of the
index log, named by the batch number, so a replayed batch overwrites what it wrote
before. Readers put the latest version of each changed article over the base
table; ``compact_index`` folds the log into a new base.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from passagework.operators.changes import latest_versions
from passagework.operators.corpus import MIN_TEXT_CHARS, boundary_chunks, clean_markup
from passagework.plans.jobs import Embedder, embed_words
from passagework.sources.tables import spread

LOG_SCHEMA = T.StructType([
    T.StructField("source_id", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("chunk", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("batch", T.LongType()),
])


FOLDED_SCHEMA = "through long"


def index_batch(articles: DataFrame, key: str, order: str, embed: Embedder = embed_words) -> DataFrame:
    """Chunks and vectors of the articles of one batch.

    Only the last version of an article by ``order`` counts. An article that is missing
    its text or too short after cleaning gives one row without chunk, which hides the
    article's earlier chunks; so does a row whose ``change_type``, if there is such a
    column, is ``delete``.
    """
    articles = latest_versions(articles, key, order)
    if "change_type" in articles.columns:
        gone = F.col("change_type").eqNullSafe("delete")
        articles = articles.withColumn("text", F.when(~gone, F.col("text")))
    long_enough = F.when(F.length("text") >= MIN_TEXT_CHARS, F.col("text"))
    texts = articles.select(
        F.col(key).alias("source_id"), F.col(key).alias("key"), long_enough.alias("text")
    )
    cleaned = clean_markup(texts).withColumn("text", long_enough)
    chunks = boundary_chunks(cleaned, "key", keep_empty=True)
    return embed(chunks, "chunk", "vector").select(*[c for c in LOG_SCHEMA.names if c != "batch"])


def sync_index(
    articles: DataFrame, folder: str, key: str, order: str, embed: Embedder = embed_words
) -> StreamingQuery:
    """Start a triggered sync: everything that arrived since the last one, then stop.

    ``articles`` is a streaming DataFrame with the key, ``text`` and the version column
    ``order``; ``change_type`` may mark deletions. ``embed`` adds the vectors. Progress is
    kept in ``folder``, next to the log.
    """

    def write(batch: DataFrame, number: int) -> None:
        index_batch(spread(batch, key), key, order, embed).write.mode("overwrite").parquet(
            f"{folder}/log/batch={number}"
        )

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def _folded_through(spark: SparkSession, folder: str) -> int:
    """The last batch that the current base table contains, -1 without a base."""
    try:
        folded = spark.read.schema(FOLDED_SCHEMA).json(f"{folder}/folded")
    except AnalysisException:
        return -1
    last = folded.agg(F.max("through").alias("through")).first()["through"]
    return -1 if last is None else last


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The current index: the chunks of each article's latest batch."""
    through = _folded_through(spark, folder)
    recent = spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/log").filter(F.col("batch") > through)
    newest = recent.groupBy("source_id").agg(F.max("batch").alias("batch"))
    current = recent.join(newest, ["source_id", "batch"], "left_semi").filter("id is not null")
    if through < 0:
        return current.drop("batch")
    base = spark.read.parquet(f"{folder}/base/through={through}")
    kept = base.join(newest, "source_id", "left_anti")
    return kept.unionByName(current.drop("batch"))


def compact_index(spark: SparkSession, folder: str) -> None:
    """Write a new base that contains all batches so far, for cheaper reads.

    The base counts only once it is noted in the list of folded batches, so a
    failed attempt changes nothing.
    """
    log = spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/log")
    through = log.agg(F.max("batch").alias("batch")).first()["batch"]
    if through is None or through <= _folded_through(spark, folder):
        return
    read_index(spark, folder).write.mode("overwrite").parquet(f"{folder}/base/through={through}")
    spark.createDataFrame([(through,)], FOLDED_SCHEMA).write.mode("append").json(f"{folder}/folded")
