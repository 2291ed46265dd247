"""Registered queries of the evaluation-set job and of batch generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators import evalset
from passagework.operators import generation as gen
from passagework.operators.chat import answered_turns
from passagework.plans import twins
from passagework.plans.registry import query
from passagework.sources.tables import read_parquet, save_parquet, work_dir

NUM_EVALS = 2500


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "documents").select("doc_id", "source", "text")


@query(
    "SELECT doc_id::VARCHAR AS doc_uri, md5(source || ': ' || text) AS md5, "
    "length(source || ': ' || text) AS chars FROM documents"
)
def eval_docs(spark: SparkSession, folder: str) -> DataFrame:
    documents = evalset.eval_documents(
        _articles(spark, folder), "doc_id", "source", "text", max_documents=None
    )
    return documents.select(
        "doc_uri", F.md5("content").alias("md5"), F.length("content").cast("long").alias("chars")
    )


@query(
    "SELECT doc_id::VARCHAR AS doc_uri, md5(source || ': ' || text) AS md5 "
    "FROM documents ORDER BY doc_id LIMIT 100"
)
def eval_docs_capped(spark: SparkSession, folder: str) -> DataFrame:
    documents = evalset.eval_documents(_articles(spark, folder), "doc_id", "source", "text")
    return documents.select("doc_uri", F.md5("content").alias("md5"))


ALLOCATED_SQL = f"""
  a AS (SELECT doc_id, text, {NUM_EVALS} // (SELECT count(*) FROM documents)
        + (row_number() OVER (ORDER BY doc_id) <= {NUM_EVALS} % (SELECT count(*) FROM documents))::INT AS evals
        FROM documents),
  allocated AS (SELECT * FROM a WHERE evals > 0)"""


@query(f"WITH {ALLOCATED_SQL} SELECT doc_id, evals::BIGINT AS evals FROM allocated")
def eval_allocate(spark: SparkSession, folder: str) -> DataFrame:
    allocated = evalset.allocate_evals(
        _articles(spark, folder).select("doc_id"), "doc_id", NUM_EVALS
    )
    return allocated.select("doc_id", F.col("evals").cast("long").alias("evals"))


@query(
    f"SELECT doc_id::VARCHAR AS key, {NUM_EVALS + 7} // (SELECT count(*) FROM documents) + (row_number() OVER "
    f"(ORDER BY doc_id::VARCHAR) <= {NUM_EVALS + 7} % (SELECT count(*) FROM documents))::INT::BIGINT AS evals FROM documents"
)
def eval_allocate_text_key(spark: SparkSession, folder: str) -> DataFrame:
    """Allotment by a key that is a text, with a remainder."""
    keys = _articles(spark, folder).select(F.col("doc_id").cast("string").alias("key"))
    allocated = evalset.allocate_evals(keys, "key", NUM_EVALS + 7)
    return allocated.select("key", F.col("evals").cast("long").alias("evals"))


_QUESTIONS = f"""{ALLOCATED_SQL},
  listed AS (SELECT doc_id, evals, list_transform(list_filter(string_split(text, '.'),
             lambda s: regexp_matches(s, '{twins.NOT_WS}')), lambda s: {twins.strip('s')}) AS f FROM allocated),
  numbered AS (SELECT doc_id, unnest(range(0, evals)) AS eval_no, f FROM listed WHERE len(f) > 0),
  chosen AS (SELECT doc_id, eval_no, f[eval_no % len(f) + 1] AS fact FROM numbered),
  asked AS (SELECT doc_id, eval_no, 'What about ' || array_to_string(string_split(fact, ' ')[1:3], ' ') || '?'
            AS question, fact FROM chosen)"""


def _question_rows(spark: SparkSession, folder: str) -> DataFrame:
    articles = _articles(spark, folder)
    allocated = evalset.allocate_evals(articles, "doc_id", NUM_EVALS, "text")
    return evalset.question_rows(allocated, "doc_id", "text")


@query(f"WITH {_QUESTIONS} SELECT doc_id, eval_no::BIGINT AS eval_no, question, fact FROM asked")
def eval_questions(spark: SparkSession, folder: str) -> DataFrame:
    return _question_rows(spark, folder).withColumn("eval_no", F.col("eval_no").cast("long"))


@query(
    f"WITH {_QUESTIONS} SELECT doc_id, eval_no::BIGINT AS eval_no, question AS request, fact AS first_fact, "
    "1::BIGINT AS facts FROM asked"
)
def eval_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation row, written as a nested table and read back as examples."""
    nested = evalset.as_eval_rows(
        _question_rows(spark, folder), "question", F.array("fact")
    ).select("doc_id", "eval_no", "inputs", "expectations")
    table = save_parquet(nested, work_dir(spark, "evals"))
    examples = evalset.training_examples(table, ["doc_id", "eval_no"], limit=None)
    return examples.select(
        "doc_id",
        F.col("eval_no").cast("long").alias("eval_no"),
        "request",
        F.get("expected_facts", F.lit(0)).alias("first_fact"),
        F.size("expected_facts").cast("long").alias("facts"),
    )


@query(
    f"WITH {_QUESTIONS} SELECT doc_id, eval_no::BIGINT AS eval_no, question AS request FROM asked "
    "ORDER BY doc_id, eval_no LIMIT 10"
)
def eval_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten of the first fifty training examples."""
    order = ["doc_id", "eval_no"]
    nested = evalset.as_eval_rows(_question_rows(spark, folder), "question", F.array("fact"))
    chosen = evalset.evaluation_slice(evalset.training_examples(nested, order), order)
    return chosen.select("doc_id", F.col("eval_no").cast("long").alias("eval_no"), "request")


_PROMPT_SQL = (
    "'" + gen.ANSWER_INSTRUCTIONS.replace("'", "''") + "' || chr(10)||chr(10)||'---'||chr(10)||chr(10)"
    " || 'Context: ' || answer || chr(10) || 'Question: ' || question || chr(10) || 'Answer:'"
)


@query(
    f"SELECT conv_id, turn, length(p) AS chars, md5(p) AS md5 FROM "
    f"(SELECT conv_id, turn, {_PROMPT_SQL} AS p FROM ({twins.ANSWERED_TURNS}))"
)
def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    turns = answered_turns(read_parquet(spark, folder, "conversations"))
    prompt = gen.render_prompt(
        gen.ANSWER_INSTRUCTIONS,
        gen.ANSWER_FIELDS,
        {"context": F.col("answer"), "question": F.col("question")},
    )
    return turns.select("conv_id", "turn", prompt.alias("p")).select(
        "conv_id", "turn", F.length("p").cast("long").alias("chars"), F.md5("p").alias("md5")
    )


@query(
    f"SELECT conv_id, turn, array_to_string({twins.keywords('question')}, ' ') AS search, question AS unchanged "
    f"FROM ({twins.ANSWERED_TURNS})"
)
def query_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    turns = answered_turns(read_parquet(spark, folder, "conversations"))
    question = F.col("question")
    rewritten = gen.keyword_query(question)
    return turns.select(
        "conv_id",
        "turn",
        gen.search_query(question, rewritten).alias("search"),
        gen.search_query(question, rewritten, use_rewriter=False).alias("unchanged"),
    )


_REPLY = T.StructType([
    T.StructField("reasoning", T.StringType()),
    T.StructField("output", T.StringType()),
])


def _echo_client():
    """A stand-in model: counts the prompt's lines and returns its last one."""

    def generate(prompts: list[str]) -> list[dict]:
        lines = [p.split("\n") for p in prompts]
        return [{"reasoning": f"{len(parts)} lines", "output": parts[-1]} for parts in lines]

    return generate


@query(
    "SELECT doc_id, len(string_split(text, chr(10))) || ' lines' AS reasoning, "
    "string_split(text, chr(10))[-1] AS output FROM documents"
)
def generate_batches(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "text")
    return gen.batch_generate(documents, "text", _echo_client, _REPLY, "doc_id")


def _judge_client():
    """A stand-in judge: scores by the length of the prompt."""

    def judge(prompts: list[str]) -> list[dict]:
        return [
            {
                "factual_accuracy": "1.0",
                "completeness": "0.5",
                "overall_score": "bad" if len(p) < 600 else str(len(p) / 4000),
                "reasoning": "by length",
            }
            for p in prompts
        ]

    return judge


@query(
    "SELECT key, round(CASE WHEN n < 600 THEN 0.0 ELSE least(1.0, n / 4000) END, 6) AS judge_score "
    "FROM (SELECT conv_id || '/' || turn AS key, length(question) + length(answer) + 1 AS n "
    f"FROM ({twins.ANSWERED_TURNS}))"
)
def judge_generate(spark: SparkSession, folder: str) -> DataFrame:
    turns = answered_turns(read_parquet(spark, folder, "conversations"))
    prompts = turns.select(
        F.concat_ws("/", "conv_id", "turn").alias("key"),
        F.concat_ws("\n", "question", "answer").alias("prompt"),
    )
    replies = gen.batch_generate(prompts, "prompt", _judge_client, gen.JUDGE_REPLY, "key")
    return gen.parse_judge(replies).select("key", F.round("judge_score", 6).alias("judge_score"))


_JUDGE_SQL = (
    "'" + gen.JUDGE_INSTRUCTIONS.replace("'", "''") + "' || chr(10)||chr(10)||'---'||chr(10)||chr(10)"
    " || 'Request: ' || question || chr(10) || 'Response: ' || answer || chr(10) || 'Expected Facts: - ' || answer"
    " || chr(10) || '- ' || question || chr(10) || 'Scores:'"
)


@query(f"SELECT conv_id, turn, length(p) AS chars, md5(p) AS md5 FROM (SELECT conv_id, turn, {_JUDGE_SQL} AS p FROM ({twins.ANSWERED_TURNS}))")
def judge_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of the judge with request, response and expected facts."""
    turns = answered_turns(read_parquet(spark, folder, "conversations"))
    prompt = gen.judge_prompt(F.col("question"), F.col("answer"), F.array("answer", "question"))
    return turns.select("conv_id", "turn", prompt.alias("p")).select(
        "conv_id", "turn", F.length("p").cast("long").alias("chars"), F.md5("p").alias("md5")
    )
