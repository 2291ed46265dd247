"""Registered queries of the scoring job, over the answered turns of conversations."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import metrics
from passagework.operators.chat import answered_turns
from passagework.operators.generation import keyword_query, parse_judge
from passagework.operators.scoring import score_answers, with_completeness, with_fact_f1
from passagework.plans import twins
from passagework.plans.registry import query
from passagework.sources.tables import read_parquet

LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase

# The tables hold no citations, contexts or rewritten questions, so these are derived
# from each turn: the answer cites passage "length modulo 4" unless the question is
# short, its context is its own first lines, and its rewrite is its content words.
_TURNS = f"""
  turns AS (
    SELECT conv_id, turn, conv_id || '/' || turn AS k, question,
           CASE WHEN length(question) < 60 THEN answer
                ELSE answer || ' [' || length(question) % 4 || '] [' || turn // 2 + 1 || ']' END AS response,
           CASE WHEN turn = 0 THEN '' WHEN length(answer) < 400 THEN translate(answer, '{LOWER}', '{UPPER}')
                ELSE replace(question, chr(10), chr(10) || chr(10)) END AS context,
           array_to_string({twins.keywords('question')}, ' ') AS rewritten
    FROM ({twins.ANSWERED_TURNS}))"""


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    pairs = answered_turns(read_parquet(spark, folder, "conversations"))
    cited = F.concat(
        "answer", F.lit(" ["), F.length("question") % 4, F.lit("] ["),
        F.floor(F.col("turn") / 2) + 1, F.lit("]"),
    )
    return pairs.select(
        "conv_id",
        "turn",
        "question",
        F.when(F.length("question") < 60, F.col("answer")).otherwise(cited).alias("response"),
        F.when(F.col("turn") == 0, "")
        .when(F.length("answer") < 400, F.translate("answer", LOWER, UPPER))
        .otherwise(F.replace("question", F.lit("\n"), F.lit("\n\n")))
        .alias("context"),
        keyword_query(F.col("question")).alias("rewritten"),
    )


@query(
    f"WITH {_TURNS} SELECT conv_id, turn, {twins.citation('response')} AS citation, "
    f"{twins.citation('response', False)} AS citation_optional, "
    r"coalesce(list_max(list_transform(regexp_extract_all(response, '\[([0-9]+)\]', 1), lambda c: c::BIGINT)) "
    r"= len(list_distinct(regexp_extract_all(response, '\[([0-9]+)\]', 1))) AND "
    + twins.citation("response")
    + ", false) AS citation_strict FROM turns"
)
def metric_citation(spark: SparkSession, folder: str) -> DataFrame:
    response = F.col("response")
    return _turns(spark, folder).select(
        "conv_id",
        "turn",
        metrics.citation_ok(response).alias("citation"),
        metrics.citation_ok(response, require_citations=False).alias("citation_optional"),
        metrics.citation_ok(response, strict=True).alias("citation_strict"),
    )


@query(
    f"WITH {_TURNS} SELECT conv_id, turn, {twins.context_used('response', 'context')} AS relevance FROM turns"
)
def metric_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).select(
        "conv_id", "turn", metrics.context_used(F.col("response"), F.col("context")).alias("relevance")
    )


@query(
    f"WITH {_TURNS}, w AS (SELECT conv_id, turn, list_distinct({twins.words('lower(question)')}) AS a, "
    f"list_distinct({twins.words('lower(rewritten)')}) AS b FROM turns), "
    "j AS (SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / "
    "len(list_distinct(list_concat(a, b))) END AS jaccard FROM w) "
    "SELECT conv_id, turn, round(jaccard, 9) AS jaccard, jaccard BETWEEN 0.3 AND 0.8 AS diverse FROM j"
)
def metric_diversity(spark: SparkSession, folder: str) -> DataFrame:
    question, rewritten = F.col("question"), F.col("rewritten")
    return _turns(spark, folder).select(
        "conv_id",
        "turn",
        F.round(metrics.word_jaccard(question, rewritten), 9).alias("jaccard"),
        metrics.query_diverse(question, rewritten).alias("diverse"),
    )


_FACTS = f"""{_TURNS},
  facts AS (SELECT k, conv_id, turn, {twins.facts('response')} AS p, {twins.facts('question')} AS e FROM turns),
  {twins.fact_f1_tables('facts', 'k', 'p', 'e')}"""


@query(
    f"WITH {_FACTS} SELECT conv_id, turn, round(f1, 9) AS f1, round(least(f1, 1.0), 9) AS f1_capped, "
    "round(CASE WHEN len(e) = 0 THEN (len(p) = 0)::INT::DOUBLE WHEN len(p) = 0 THEN 0.0 ELSE "
    "2.0 * len(list_intersect(list_distinct(p), list_distinct(e))) / "
    "(len(list_distinct(p)) + len(list_distinct(e))) END, 9) AS f1_exact, f1 >= 0.7 AS f1_pass "
    "FROM facts JOIN f1_scores USING (k)"
)
def metric_fact_f1(spark: SparkSession, folder: str) -> DataFrame:
    given = metrics.facts_of_text(F.col("response"))
    wanted = metrics.facts_of_text(F.col("question"))
    scored = with_fact_f1(_turns(spark, folder), given, wanted)
    scored = with_fact_f1(scored, given, wanted, "f1_exact", fuzzy=False)
    return scored.select(
        "conv_id",
        "turn",
        F.round("f1", 9).alias("f1"),
        F.round(F.least("f1", F.lit(1.0)), 9).alias("f1_capped"),
        F.round("f1_exact", 9).alias("f1_exact"),
        (F.col("f1") >= metrics.FACT_PASS).alias("f1_pass"),
    )


@query(
    f"WITH {_TURNS} SELECT conv_id, turn, {twins.complete('question', 'response')} AS completeness FROM turns"
)
def metric_completeness(spark: SparkSession, folder: str) -> DataFrame:
    return with_completeness(_turns(spark, folder)).select("conv_id", "turn", "completeness")


_SCORED = f"""{_FACTS},
  graded AS (SELECT t.*, f1, {twins.citation('response')} AS citation,
             {twins.context_used('response', 'context')} AS relevance,
             {twins.complete('question', 'response')} AS completeness
             FROM turns t JOIN f1_scores USING (k)),
  scored AS (SELECT *, citation::INT * 0.2::DOUBLE + relevance::INT * 0.3::DOUBLE + f1 * 0.4::DOUBLE
             + completeness::INT * 0.1::DOUBLE AS total FROM graded)"""


@query(
    f"WITH {_SCORED} SELECT conv_id, turn, citation, relevance, round(f1, 9) AS f1, completeness, "
    "round(total, 9) AS total, f1 >= 0.7 AS f1_pass, total >= 0.6 AS total_pass FROM scored"
)
def metric_total(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_answers(_turns(spark, folder), metrics.facts_of_text(F.col("question")))
    return scored.select(
        "conv_id", "turn", "citation", "relevance", F.round("f1", 9).alias("f1"), "completeness",
        F.round("total", 9).alias("total"), "f1_pass", "total_pass",
    )


# Judge replies derived from the labels: good, out of range, malformed and missing scores.
_NUMBER_SQL = (
    r"(?i)^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf|infinity|nan)$"
)


def _number_sql(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({twins.strip(x)}, '{_NUMBER_SQL}') "
        f"THEN replace({twins.strip(x)}, '_', '')::DOUBLE END"
    )


@query(
    f"""WITH r AS (
      SELECT doc_id, quality, toxic,
             CASE WHEN toxic = 1 AND quality = 0 THEN 'nan' WHEN toxic = 1 THEN '1.4'
                  WHEN quality = 0 THEN '-0.2' ELSE ' 0.' || n_chars || ' ' END AS overall_score,
             CASE WHEN n_chars > 10000 THEN '0.7x' WHEN n_chars > 5000 THEN NULL ELSE '1e-1' END AS factual_accuracy,
             CASE WHEN lang = 'de' THEN '0.7d' WHEN lang = 'es' THEN '1_0.5' ELSE '.5' END AS completeness,
             CASE WHEN source <> 'src7' THEN source END AS reasoning
      FROM labels JOIN documents USING (doc_id)),
    v AS (SELECT *, {_number_sql('overall_score')} AS o, {_number_sql('factual_accuracy')} AS a,
          {_number_sql('completeness')} AS c FROM r)
    SELECT doc_id, round(CASE WHEN o IS NULL OR (factual_accuracy IS NOT NULL AND a IS NULL)
      OR (completeness IS NOT NULL AND c IS NULL) OR reasoning IS NULL THEN 0.0
      WHEN isnan(o) THEN 1.0 ELSE greatest(0.0, least(1.0, o)) END, 9) AS judge_score FROM v"""
)
def judge_parse(spark: SparkSession, folder: str) -> DataFrame:
    labelled = read_parquet(spark, folder, "labels").join(
        read_parquet(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id"
    )
    toxic, poor, chars = F.col("toxic") == 1, F.col("quality") == 0, F.col("n_chars")
    replies = labelled.select(
        "doc_id",
        F.when(toxic & poor, "nan")
        .when(toxic, "1.4")
        .when(poor, "-0.2")
        .otherwise(F.concat(F.lit(" 0."), chars, F.lit(" ")))
        .alias("overall_score"),
        F.when(chars > 10000, "0.7x").when(chars <= 5000, "1e-1").alias("factual_accuracy"),
        F.when(F.col("lang") == "de", "0.7d")
        .when(F.col("lang") == "es", "1_0.5")
        .otherwise(".5")
        .alias("completeness"),
        F.when(F.col("source") != "src7", F.col("source")).alias("reasoning"),
    )
    return parse_judge(replies).select("doc_id", F.round("judge_score", 9).alias("judge_score"))
