"""Batch generation: prompts, mapping rows through a caller's model, offline stand-ins."""

from __future__ import annotations

import uuid
from typing import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.metrics import judge_overall, keywords
from passagework.functions.text import strip
from passagework.operators.steps import settle
from passagework.sources.tables import save_parquet, work_dir

# Makes, in a task, the function that turns a list of prompts into a list of records.
Client = Callable[[], Callable[[list[str]], list[dict]]]

# Instructions and field labels of the answer and rewrite steps.
ANSWER_INSTRUCTIONS = (
    "Answer the user's question using only the information from the provided context passages.\n"
    "When using information from a passage, cite it with [n], where n is the passage number as provided.\n"
    'For example: "Air pollution can affect respiratory health [1]."\n'
    "Only use the passages as sources for your answer."
)
REWRITE_INSTRUCTIONS = (
    "Rewrite the user's question to optimize it for vector search retrieval.\n"
    "Make the query more specific, add relevant keywords, and ensure it captures the user's intent."
)
ANSWER_FIELDS = {"context": "Context:", "question": "Question:", "answer": "Answer:"}
REWRITE_FIELDS = {
    "original_question": "Original Question:",
    "rewritten_query": "Rewritten Query:",
}

# Our own defaults; callers pass their own texts.
JUDGE_INSTRUCTIONS = (
    "Judge whether a response rests on the facts that were expected.\n"
    "factual_accuracy: 0.0 to 1.0, lower for every claim that the facts do not support or contradict.\n"
    "completeness: 0.0 to 1.0, the share of the facts that the response covers.\n"
    "overall_score: 0.0 to 1.0; few accurate facts are worth more than many inaccurate ones.\n"
    "reasoning: which facts are covered and what is inaccurate."
)
JUDGE_FIELDS = {
    "request": "Request:", "response": "Response:", "expected_facts": "Expected Facts:", "overall_score": "Scores:",
}
QUESTION_INSTRUCTIONS = (
    "Write a question that a reader of the passage could ask and that the passage answers.\n"
    "State the facts that a right answer must hold."
)
QUESTION_FIELDS = {"passage": "Passage:", "guidelines": "Guidelines:", "question": "Question:"}
_DIVIDER = "\n\n---\n\n"

JUDGE_REPLY = T.StructType([
    T.StructField("factual_accuracy", T.StringType()),
    T.StructField("completeness", T.StringType()),
    T.StructField("overall_score", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])


def render_prompt(
    instructions: str,
    fields: dict[str, str],
    inputs: dict[str, Column],
    demos: list[dict[str, str]] | Column = (),
) -> Column:
    """One prompt per row: instructions, the few given demos, then the row's fields.

    ``fields`` maps every field to its label; a field without an input is the one
    to be generated and ends the prompt with its label. ``demos`` may also be a column
    of arrays of rendered demos, see ``demo_text``.
    """
    row = [
        F.concat(F.lit(f"{label} "), F.coalesce(inputs[name], F.lit("")))
        if name in inputs
        else F.lit(label)
        for name, label in fields.items()
    ]
    if isinstance(demos, Column):
        # Joined with a null array, the text would leave it out without a trace.
        given = F.coalesce(demos, F.array().cast("array<string>"))
        return F.concat_ws(_DIVIDER, F.lit(instructions), given, F.concat_ws("\n", *row))
    shown = [
        "\n".join(f"{label} {demo[name]}" for name, label in fields.items() if name in demo)
        for demo in demos
    ]
    return F.concat_ws(_DIVIDER, *[F.lit(t) for t in [instructions, *shown]], F.concat_ws("\n", *row))


def rewrite_prompt(question: Column, demos: list[dict[str, str]] = ()) -> Column:
    """The prompt that asks a model for a search text."""
    return render_prompt(REWRITE_INSTRUCTIONS, REWRITE_FIELDS, {"original_question": question}, demos)


def judge_prompt(
    request: Column, response: Column, expected_facts: Column, instructions: str = JUDGE_INSTRUCTIONS
) -> Column:
    """The prompt that asks a judge to score a response against a list of expected facts."""
    facts = F.array_join(F.transform(expected_facts, lambda f: F.concat(F.lit("- "), f)), "\n")
    return render_prompt(
        instructions, JUDGE_FIELDS, {"request": request, "response": response, "expected_facts": facts}
    )


def question_prompt(passage: Column, guidelines: str | Column) -> Column:
    """The prompt that asks a model for an evaluation question, with the caller's guidelines."""
    given = guidelines if isinstance(guidelines, Column) else F.lit(guidelines)
    return render_prompt(QUESTION_INSTRUCTIONS, QUESTION_FIELDS, {"passage": passage, "guidelines": given})


def stage_demos(programs: DataFrame, stage: str, limit: int) -> list[dict[str, str]]:
    """The first ``limit`` demos of a program's stage, ready for ``render_prompt``.

    ``programs`` are the demo rows of one saved program, or chosen demos with their texts.
    """
    rows = programs.filter(F.col("stage") == stage).orderBy(F.desc("augmented"), "position").limit(limit)
    return [{k: v for k, v in row.asDict().items() if isinstance(v, str) and k != "stage"} for row in rows.collect()]


def batch_generate(
    df: DataFrame,
    prompt: str,
    client: Callable[[], Callable[[list[str]], list[dict]]],
    reply: T.StructType,
    key: str,
) -> DataFrame:
    """(key, reply fields) per row: prompts mapped through a model in batches.

    ``client`` is called once per task and returns the function that turns a list
    of prompts into a list of records with the fields of ``reply``.
    """
    schema = T.StructType([df.schema[key], *reply.fields])
    names = reply.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = client()
        for batch in batches:
            replies = generate(batch[prompt].tolist())
            out = pd.DataFrame(replies, columns=names, index=batch.index)
            out.insert(0, key, batch[key])
            yield out

    return df.select(key, prompt).mapInPandas(run, schema)


def demo_text(fields: dict[str, str], values: dict[str, Column]) -> Column:
    """One demo as it stands in a prompt: the labelled fields that have a value."""
    shown = [F.concat(F.lit(f"{label} "), values[name]) for name, label in fields.items() if name in values]
    return F.concat_ws("\n", *shown)


def _tried(
    generate: Callable[[list[str]], list[dict]], prompts: list[str], names: list[str], attempts: int
) -> list[dict]:
    """Replies with an ``error`` each; a batch that keeps failing is asked prompt by prompt."""

    def ask(some: list[str]) -> list[dict]:
        replies = generate(some)
        if len(replies) != len(some):
            raise ValueError(f"{len(replies)} replies to {len(some)} prompts")
        return [{**{name: reply[name] for name in names}, "error": None} for reply in replies]

    failure = None
    for _ in range(attempts):
        try:
            return ask(prompts)
        except Exception as caught:  # whatever the caller's client raises
            failure = caught
    if len(prompts) == 1:
        return [{**{name: None for name in names}, "error": f"{type(failure).__name__}: {failure}"}]
    return [reply for prompt in prompts for reply in _tried(generate, [prompt], names, attempts)]


def stored_replies(spark: SparkSession, folder: str, reply: T.StructType) -> DataFrame:
    """(digest, reply fields) of every prompt that was ever answered without an error."""
    schema = T.StructType([T.StructField("digest", T.StringType()), *reply.fields, T.StructField("error", T.StringType())])
    try:
        kept = spark.read.schema(schema).parquet(f"{folder}/replies")
    except AnalysisException:  # nothing stored yet
        kept = spark.createDataFrame([], schema)
    return kept.where("error is null").select("digest", *reply.fieldNames()).dropDuplicates(["digest"])


def resumed_generate(
    df: DataFrame, prompt: str, client: Client, reply: T.StructType, key: str, folder: str,
    attempts: int = 3, batch_rows: int = 64, rows_per_write: int = 100_000,
) -> DataFrame:
    """(key, reply fields, error) per row, like ``batch_generate``, with the replies kept in ``folder``.

    Every different prompt is asked once, and not at all when ``folder`` holds its reply, so a
    run that was stopped goes on where it was: replies are written ``rows_per_write`` prompts
    at a time. A batch that fails is tried ``attempts`` times and then prompt by prompt; a
    prompt that fails on its own gets null fields and the ``error``, costs no other row its
    reply, and is asked again by the next run. A null prompt is asked as the empty text.
    Repeated rows and keys each get the reply of their prompt.
    """
    spark, names = df.sparkSession, reply.fieldNames()
    text = F.coalesce(F.col(prompt), F.lit(""))
    asked = save_parquet(df.select(F.col(key).alias("key"), F.sha2(text, 256).alias("digest"), text.alias("prompt")), work_dir(spark, "asked"))
    known = stored_replies(spark, folder, reply).select("digest")
    todo = save_parquet(
        asked.select("digest", "prompt").dropDuplicates(["digest"]).join(known, "digest", "left_anti"), work_dir(spark, "todo")
    )
    schema = T.StructType([T.StructField("digest", T.StringType()), *reply.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = client()
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start:start + batch_rows]
                out = pd.DataFrame(_tried(generate, part["prompt"].tolist(), names, attempts), columns=schema.fieldNames()[1:])
                out.insert(0, "digest", part["digest"].to_numpy())
                yield out

    rows = todo.count()
    slices = -(-rows // rows_per_write)
    run_name, failed = uuid.uuid4().hex, None
    for i in range(slices):
        part = todo.where(F.pmod(F.xxhash64("digest"), F.lit(slices)) == i) if slices > 1 else todo
        # Spread: a task waits for the model, not for its rows.
        part = part.repartition(max(1, min(spark.sparkContext.defaultParallelism, -(-rows // (slices * batch_rows)))))
        part.mapInPandas(run, schema).write.parquet(f"{folder}/replies/run={run_name}-{i}")
    if slices:
        fresh = spark.read.schema(schema).parquet(*[f"{folder}/replies/run={run_name}-{i}" for i in range(slices)])
        failed = fresh.where("error is not null").select("digest", "error")
    replies = stored_replies(spark, folder, reply)
    out = asked.select("key", "digest").join(replies, "digest", "left")
    if failed is not None:
        out = out.join(failed, "digest", "left")
    else:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out.select(F.col("key").alias(key), *names, "error")


def search_query(question: Column, rewritten: Column, use_rewriter: bool = True) -> Column:
    """The text to search with: the rewritten question when the rewriter is on."""
    return rewritten if use_rewriter else question


def keyword_query(question: Column) -> Column:
    """Offline stand-in for the rewriter: the question's content words."""
    return F.array_join(keywords(question), " ")


def with_candidate_answers(
    passages: DataFrame, question: str = "question", rank: str = "rank", text: str = "chunk"
) -> DataFrame:
    """Offline stand-in for the answer model: adds ``candidate`` and ``merit`` per passage.

    A passage's candidate answer is its first line and its citation. Its merit is
    the number of the question's keywords it names, then its rank.
    """
    ready = settle(
        passages,
        "_asked",
        F.struct(keywords(F.col(question)).alias("terms"), F.lower(text).alias("passage")),
    )
    named = F.size(F.filter("_asked.terms", lambda t: F.contains(F.col("_asked.passage"), t)))
    line = strip(F.split(strip(F.col(text)), "\n")[0])
    return (
        ready.withColumn("merit", F.struct(named.alias("named"), (-F.col(rank)).alias("order")))
        .withColumn("candidate", F.concat(line, F.lit(" ["), F.col(rank).cast("string"), F.lit("]")))
        .drop("_asked")
    )


def best_candidate_answer() -> Column:
    """The aggregate that picks the candidate answer with the highest merit."""
    return F.max_by("candidate", "merit")


def parse_judge(replies: DataFrame, name: str = "judge_score") -> DataFrame:
    """Add the overall judge score parsed from the reply's text fields."""
    return replies.withColumn(
        name,
        judge_overall(
            F.col("overall_score"), F.col("factual_accuracy"), F.col("completeness"), F.col("reasoning")
        ),
    )
