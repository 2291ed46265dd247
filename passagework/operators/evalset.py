"""Evaluation-set job: documents, question/fact rows, training examples, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import is_blank, strip
from passagework.operators.positions import key_at
from passagework.operators.steps import settle
from passagework.sources.tables import save_parquet, work_dir

# Document cap, row count and example limits.
MAX_DOCUMENTS = 100
NUM_EVALS = 100
TRAINING_EXAMPLES = 50
EVALUATION_EXAMPLES = 10

# A text has a sentence when something in it is neither a full stop nor white space.
ANY_SENTENCE = r"[^.\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def eval_documents(
    articles: DataFrame,
    key: str = "id",
    title: str = "title",
    text: str = "text",
    max_documents: int | None = MAX_DOCUMENTS,
) -> DataFrame:
    """(content, doc_uri): title and text joined, null when either is null.

    The first ``max_documents`` in key order; None keeps every document.
    """
    chosen = articles.select(key, title, text)
    if max_documents is not None:
        chosen = chosen.orderBy(key).limit(max_documents)
    return chosen.select(
        F.concat(F.col(title), F.lit(": "), F.col(text)).alias("content"),
        F.col(key).cast("string").alias("doc_uri"),
    )


def allocate_evals(documents: DataFrame, key: str, num_evals: int, text: str | None = None) -> DataFrame:
    """Documents with the number of evaluation rows each gets, ``num_evals`` in total.

    Spread evenly; the remainder goes to the first documents in key order, and
    documents that would get none are left out. The key is unique and of any ordered
    type; rows without one are left out. With a ``text`` column only documents with a
    sentence count, so that every allotted row can be written. Only keys are shuffled,
    to find the one up to which the remainder goes; texts stay where they are.
    """
    documents = documents.filter(F.col(key).isNotNull())
    if text is not None:
        documents = documents.filter(F.col(text).rlike(ANY_SENTENCE))
    keys = save_parquet(documents.select(key), work_dir(documents.sparkSession, "keys"))
    total = keys.count()
    if total == 0:
        return documents.withColumn("evals", F.lit(0))
    share, rest = divmod(num_evals, total)
    if rest == 0:
        return documents.withColumn("evals", F.lit(share)).filter("evals > 0")
    last = F.lit(key_at(keys, key, rest - 1)).cast(documents.schema[key].dataType)
    if share == 0:
        return documents.filter(F.col(key) <= last).withColumn("evals", F.lit(1))
    return documents.withColumn("evals", F.when(F.col(key) <= last, share + 1).otherwise(share))


def sentences(text: Column) -> Column:
    """Stripped non-blank sentences of a text."""
    parts = F.filter(F.split(text, r"\."), lambda s: ~is_blank(s))
    return F.transform(parts, strip)


def question_rows(allocated: DataFrame, key: str, text: str) -> DataFrame:
    """One row per allocated evaluation: number, question and its fact.

    Offline stand-in for a question writer: each question asks about the opening
    words of a sentence, whose text is the fact; sentences are used in turn.
    """
    listed = settle(allocated.select(key, "evals", text), "_facts", sentences(F.col(text)))
    turns = F.transform(
        F.sequence(F.lit(0), F.col("evals") - 1),
        lambda n: F.element_at("_facts", (n % F.size("_facts") + 1).cast("int")),
    )
    rows = listed.filter(F.size("_facts") > 0).select(
        key, F.posexplode(turns).alias("eval_no", "fact")
    )
    opening = F.array_join(F.slice(F.split("fact", " "), 1, 3), " ")
    return rows.select(
        key, "eval_no", F.concat(F.lit("What about "), opening, F.lit("?")).alias("question"), "fact"
    )


def as_eval_rows(rows: DataFrame, question: str, facts: Column) -> DataFrame:
    """Add the nested ``inputs`` and ``expectations`` columns of an evaluation table."""
    message = F.struct(F.lit("user").alias("role"), F.col(question).alias("content"))
    return rows.select(
        "*",
        F.struct(F.array(message).alias("messages")).alias("inputs"),
        F.struct(facts.alias("expected_facts")).alias("expectations"),
    )


def training_examples(
    eval_table: DataFrame, order: list[str], limit: int | None = TRAINING_EXAMPLES
) -> DataFrame:
    """(order columns, request, expected_facts): first message and facts of each row."""
    rows = eval_table
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    return rows.select(
        *order,
        F.get(F.col("inputs.messages"), F.lit(0))["content"].alias("request"),
        F.col("expectations.expected_facts").alias("expected_facts"),
    )


def evaluation_slice(
    examples: DataFrame, order: list[str], limit: int = EVALUATION_EXAMPLES
) -> DataFrame:
    """The first training rows, which double as the evaluation slice."""
    return examples.orderBy(*order).limit(limit)


def held_out_split(examples: DataFrame, key: str, tenths: int = 2) -> DataFrame:
    """Add ``held_out``, true for about ``tenths`` tenths of the keys, stable per key."""
    return examples.withColumn("held_out", F.pmod(F.xxhash64(key), F.lit(10)) < tenths)
