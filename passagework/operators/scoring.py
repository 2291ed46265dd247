"""Scoring job: every metric for a table of answers in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import metrics
from passagework.operators.steps import settle


def with_fact_f1(
    df: DataFrame,
    predicted: Column,
    expected: Column,
    name: str = "f1",
    fuzzy: bool = True,
    cap: bool = False,
) -> DataFrame:
    """Add the F1 of predicted against expected facts (arrays of normalised text).

    Fuzzy: a predicted fact matches when it shares at least half of the smaller
    word set with some expected fact, and the same match count serves precision
    and recall, so the value can pass 1; ``cap`` clamps it. Exact: on sets. A null
    array, for a missing answer or expectation, scores 0.
    """
    shape = metrics.fact_words if fuzzy else F.array_distinct
    ready = settle(
        df,
        "_facts",
        F.struct(shape(predicted).alias("predicted"), shape(expected).alias("expected")),
    )
    given, wanted = F.col("_facts.predicted"), F.col("_facts.expected")
    if fuzzy:
        hits = metrics.matched_facts(given, wanted)
    else:
        hits = F.size(F.array_intersect(given, wanted))
    counted = settle(
        ready,
        "_counts",
        F.struct(
            hits.alias("hits"), F.size(given).alias("predicted"), F.size(wanted).alias("expected")
        ),
    )
    score = metrics.f1_of_counts(
        F.col("_counts.hits"), F.col("_counts.predicted"), F.col("_counts.expected"), cap
    )
    missing = given.isNull() | wanted.isNull()
    return counted.withColumn(name, F.when(missing, F.lit(0.0)).otherwise(score)).drop(
        "_facts", "_counts"
    )


def score_answers(
    answers: DataFrame,
    expected: Column,
    question: str = "question",
    response: str = "response",
    context: str | None = "context",
    require_citations: bool = True,
    fuzzy: bool = True,
    cap: bool = False,
) -> DataFrame:
    """Add citation, relevance, f1, completeness, total and the pass flags.

    ``expected`` is an array of expected facts, as ``facts_of_text`` or
    ``facts_of_list`` give it. Without a context column relevance is false.
    """
    answer = F.col(response)
    relevance = (
        metrics.context_used(answer, F.col(context)) if context else F.lit(False)
    )
    graded = (
        with_fact_f1(answers, metrics.facts_of_text(answer), expected, "f1", fuzzy, cap)
        .withColumn("citation", metrics.citation_ok(answer, require_citations))
        .withColumn("relevance", relevance)
    )
    graded = with_completeness(graded, question, response)
    total = metrics.weighted_total(
        F.col("citation"), F.col("relevance"), F.col("f1"), F.col("completeness")
    )
    return (
        graded.withColumn("total", total)
        .withColumn("f1_pass", F.col("f1") >= metrics.FACT_PASS)
        .withColumn("total_pass", F.col("total") >= metrics.TOTAL_PASS)
    )


def with_completeness(
    df: DataFrame, question: str = "question", response: str = "response", name: str = "completeness"
) -> DataFrame:
    """Add whether the answer mentions enough of the question's keywords."""
    ready = settle(
        df,
        "_asked",
        F.struct(
            metrics.keywords(F.col(question)).alias("terms"), F.lower(response).alias("answer")
        ),
    )
    named = metrics.share_named(F.col("_asked.terms"), F.col("_asked.answer"))
    missing = F.col(question).isNull() | F.col(response).isNull()
    passed = F.when(missing, F.lit(False)).otherwise(named >= metrics.COMPLETENESS_PASS)
    return ready.withColumn(name, passed).drop("_asked")
