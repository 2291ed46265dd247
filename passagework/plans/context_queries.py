"""Registered queries of the context job and of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import context as ctx
from passagework.operators.chat import answered_turns, history_pairs, latest_prompt, reply_rows
from passagework.operators.vectors import knn_join
from passagework.plans import twins
from passagework.plans.registry import query
from passagework.sources.tables import read_parquet, save_parquet, spread, work_dir

# Neighbours below this similarity are not offered, which leaves some questions without any.
MIN_SCORE = 0.45

# Passages of the context queries: each vector's document, with the gaps a corpus
# has. Blank text where labelled toxic, no text where unlabelled and French, no
# title where unlabelled, and the quality label as ordinal.
_PASSAGES = f"""
  n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  m AS (SELECT vec_id, v, list_inner_product(v, v) AS vv FROM n),
  s AS (SELECT q.vec_id AS query_id, x.vec_id AS id,
               round(list_inner_product(q.v, x.v) / sqrt(q.vv * x.vv), 9) AS score
        FROM m q JOIN m x ON q.vec_id <> x.vec_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
  p AS (SELECT query_id, rank, doc_id::VARCHAR AS id,
               CASE WHEN quality IS NOT NULL THEN source END AS title,
               coalesce(quality, 0) AS chunk_id,
               CASE WHEN toxic = 1 THEN '  ' WHEN quality IS NULL AND lang = 'fr' THEN ''
                    ELSE text END AS chunk,
               CASE WHEN n_chars < 500 THEN 'short' ELSE source || ' ' || lang || ' content' END AS content
        FROM k JOIN documents d ON d.doc_id = k.id LEFT JOIN labels USING (doc_id)
        WHERE rank <= 5 AND score >= {MIN_SCORE}),
  c AS (SELECT *, CASE WHEN chunk <> '' THEN chunk ELSE content END AS body,
               CASE WHEN chunk <> '' THEN 'chunk' ELSE 'content' END AS origin FROM p),
  t AS (SELECT query_id, rank,
               '[' || rank || '] ' ||
               CASE WHEN NOT regexp_matches(body, '{twins.NOT_WS}')
                    THEN '[No content available from passage ' || rank || ']' ELSE body END ||
               CASE WHEN title <> '' THEN ' (Title: ' || title || ')' ELSE '' END ||
               CASE WHEN chunk_id <> 0 THEN ' (Chunk_Id: ' || chunk_id || ')' ELSE '' END ||
               CASE WHEN id <> '' THEN ' (ID: ' || id || ')' ELSE '' END AS passage,
               CASE WHEN NOT regexp_matches(body, '{twins.NOT_WS}')
                    THEN 'Passage ' || rank || ': Empty content via ' || origin
                    WHEN length({twins.strip('body')}) < 10
                    THEN 'Passage ' || rank || ': Very short content (' || length({twins.strip('body')})
                         || ' chars) via ' || origin END AS issue
        FROM c),
  g AS (SELECT query_id, string_agg(passage, chr(10)||chr(10) ORDER BY rank) AS context,
               count(*) AS passages, sum(length(passage))::BIGINT AS context_chars,
               string_agg(issue, '; ' ORDER BY rank) AS issues
        FROM t GROUP BY query_id)"""


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"))


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spread(read_parquet(spark, folder, "embeddings"), "vec_id")
    found = knn_join(
        vectors, vectors, 5, query_id="vec_id", key="vec_id", vector="embedding", exclude_self=True
    ).filter(F.col("score") >= MIN_SCORE)
    documents = read_parquet(spark, folder, "documents")
    labels = read_parquet(spark, folder, "labels")
    unlabelled = F.col("quality").isNull()
    return (
        found.withColumnRenamed("id", "doc_id")
        .join(documents, "doc_id")
        .join(labels, "doc_id", "left")
        .select(
            "query_id",
            "rank",
            F.col("doc_id").cast("string").alias("id"),
            F.when(~unlabelled, F.col("source")).alias("title"),
            F.coalesce("quality", F.lit(0)).alias("chunk_id"),
            F.when(F.col("toxic") == 1, "  ")
            .when(unlabelled & (F.col("lang") == "fr"), "")
            .otherwise(F.col("text"))
            .alias("chunk"),
            F.when(F.col("n_chars") < 500, "short")
            .otherwise(F.concat_ws(" ", "source", "lang", F.lit("content")))
            .alias("content"),
        )
    )


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    contexts = ctx.build_contexts(_passages(spark, folder))
    return ctx.with_contexts(_questions(spark, folder), contexts)


@query(
    f"WITH {_PASSAGES} SELECT q.vec_id AS query_id, md5(context) AS md5, coalesce(passages, 0) AS passages, "
    "context_chars, issues, context_chars < 50 AS little_context "
    "FROM embeddings q LEFT JOIN g ON g.query_id = q.vec_id"
)
def context_build(spark: SparkSession, folder: str) -> DataFrame:
    issues = F.when(F.size("issues") > 0, F.array_join("issues", "; "))
    return _contexts(spark, folder).select(
        "query_id",
        F.md5("context").alias("md5"),
        F.col("passages").cast("long").alias("passages"),
        "context_chars",
        issues.alias("issues"),
        "little_context",
    )


@query(
    f"WITH {_PASSAGES}, a AS (SELECT q.vec_id AS query_id, coalesce(passages, 0) AS passages, "
    "coalesce(context_chars, 0) AS chars, issues, CASE WHEN passages > 0 THEN "
    f"coalesce(context, '') ELSE '{ctx.NO_PASSAGES_ANSWER.replace(chr(39), chr(39) * 2)}' END AS answer "
    "FROM embeddings q LEFT JOIN g ON g.query_id = q.vec_id), f AS (SELECT query_id, answer, "
    f"(passages <= 0)::INT + (chars <= 50)::INT + (length({twins.strip('answer')}) <= 50)::INT AS failures, "
    "(chars > 50 AND chars <= 100)::INT + (issues IS NOT NULL)::INT AS warnings FROM a) "
    "SELECT query_id, md5(answer) AS answer_md5, failures, warnings, CASE WHEN failures = 0 AND warnings <= 1 THEN 'ok' WHEN failures <= 1 "
    "THEN 'functional' ELSE 'bad' END AS verdict FROM f"
)
def context_health(spark: SparkSession, folder: str) -> DataFrame:
    """The whole context stands for the answer, as from a model that repeats what it was given."""
    answered = ctx.answer_or_apology(_contexts(spark, folder).withColumn("answer", F.col("context")))
    return ctx.retrieval_health(answered).select(
        "query_id", F.md5("answer").alias("answer_md5"), "failures", "warnings", "verdict"
    )


@query(
    "SELECT conv_id, coalesce(arg_max(text, turn), '') AS question, max(turn) AS turn "
    "FROM conversations GROUP BY conv_id"
)
def chat_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_prompt(read_parquet(spark, folder, "conversations"))


@query(
    "WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) "
    "SELECT conv_id, pos // 2 AS pair, max(text) FILTER (pos % 2 = 0) AS question, "
    "max(text) FILTER (pos % 2 = 1) AS answer FROM p GROUP BY conv_id, pos // 2 HAVING count(*) = 2"
)
def chat_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return history_pairs(read_parquet(spark, folder, "conversations"))


@query(twins.ANSWERED_TURNS)
def chat_pairs_role(spark: SparkSession, folder: str) -> DataFrame:
    return answered_turns(read_parquet(spark, folder, "conversations"))


@query(
    "SELECT sha256(conv_id || '/' || turn) AS id, conv_id, turn + 1 AS turn, 'assistant' AS role, "
    f"answer AS content FROM ({twins.ANSWERED_TURNS})"
)
def chat_replies(spark: SparkSession, folder: str) -> DataFrame:
    return reply_rows(answered_turns(read_parquet(spark, folder, "conversations")))
