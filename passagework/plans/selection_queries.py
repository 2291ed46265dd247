"""Registered queries of the selection job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import metrics
from passagework.operators import selection
from passagework.operators.chat import answered_turns
from passagework.operators.scoring import score_answers
from passagework.plans import twins
from passagework.plans.registry import query
from passagework.sources import run_records
from passagework.sources.tables import (
    append_runs,
    read_parquet,
    read_program_files,
    work_dir,
)

# Three programs answer every answered turn: with the assistant's text, with its
# first sentence and a citation, and with the question repeated and cited. The
# expected facts are the assistant's sentences.
ANSWERS_SQL = f"""
  turns AS ({twins.ANSWERED_TURNS}),
  answers AS (
    SELECT conv_id, turn, 'full' AS program, question, answer, answer AS response FROM turns
    UNION ALL SELECT conv_id, turn, 'first', question, answer, string_split(answer, '.')[1] || ' [1]' FROM turns
    UNION ALL SELECT conv_id, turn, 'echo', question, answer, question || ' [2]' FROM turns),
  facts AS (SELECT *, conv_id || '/' || turn || '/' || program AS k, {twins.facts('response')} AS p,
            {twins.facts('answer')} AS e FROM answers),
  {twins.fact_f1_tables('facts', 'k', 'p', 'e')},
  graded AS (SELECT t.*, f1, {twins.citation('response')} AS citation,
             {twins.complete('question', 'response')} AS completeness
             FROM facts t JOIN f1_scores USING (k)),
  scores AS (SELECT *, citation::INT * 0.2::DOUBLE + 0 * 0.3::DOUBLE + f1 * 0.4::DOUBLE
             + completeness::INT * 0.1::DOUBLE AS total FROM graded)"""


def program_scores(spark: SparkSession, folder: str) -> DataFrame:
    turns = answered_turns(read_parquet(spark, folder, "conversations"))

    def variant(name: str, response) -> F.Column:
        return F.struct(F.lit(name).alias("program"), response.alias("response"))

    answers = turns.select(
        "*",
        F.inline(F.array(
            variant("full", F.col("answer")),
            variant("first", F.concat(F.split("answer", r"\.")[0], F.lit(" [1]"))),
            variant("echo", F.concat("question", F.lit(" [2]"))),
        )),
    )
    return score_answers(answers, metrics.facts_of_text(F.col("answer")), context=None)


@query(
    f"WITH {ANSWERS_SQL} SELECT program, round(avg(total), 6) AS mean_score, count(*) AS examples "
    "FROM scores GROUP BY program"
)
def program_compare(spark: SparkSession, folder: str) -> DataFrame:
    compared = selection.compare_programs(program_scores(spark, folder), "program", "total")
    return compared.withColumn("mean_score", F.round("mean_score", 6))


@query(
    f"WITH {ANSWERS_SQL} SELECT program, example::INT AS example, citation, f1 >= 0.7 AS semantic, "
    "total >= 0.6 AS end_to_end, round(total, 9) AS comprehensive FROM (SELECT *, row_number() OVER "
    "(PARTITION BY program ORDER BY conv_id, turn) AS example FROM scores) WHERE example <= 3"
)
def program_details(spark: SparkSession, folder: str) -> DataFrame:
    detailed = selection.detailed_examples(program_scores(spark, folder), "program", ["conv_id", "turn"])
    return detailed.select(
        "program", "example", "citation", F.col("f1_pass").alias("semantic"),
        F.col("total_pass").alias("end_to_end"), F.round("total", 9).alias("comprehensive"),
    )


@query(
    f"""WITH {ANSWERS_SQL}, s AS (SELECT *, conv_id || '/' || turn AS example FROM scores),
    g AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY conv_id, turn) AS position
          FROM s WHERE total >= 0.55),
    b AS (SELECT * FROM g WHERE position <= 4),
    l AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY conv_id, turn) AS position FROM s
          WHERE k NOT IN (SELECT k FROM b))
    SELECT program, true AS augmented, position::INT AS position, example FROM b
    UNION ALL SELECT program, false, position::INT, example FROM l WHERE position <= 2"""
)
def demo_select(spark: SparkSession, folder: str) -> DataFrame:
    scored = program_scores(spark, folder).withColumn("example", F.concat_ws("/", "conv_id", "turn"))
    return selection.choose_demos(
        scored, "program", "example", "total", order=["conv_id", "turn"],
        threshold=0.55, max_bootstrapped=4, max_labeled=2,
    )


_CANDIDATES = ["Answer briefly.", "Answer with the whole passage [1].", "Say what the text is about [0]."]


@query(
    f"""WITH c AS (SELECT i AS candidate_id, t AS instruction FROM (VALUES
      (0, '{_CANDIDATES[0]}'), (1, '{_CANDIDATES[1]}'), (2, '{_CANDIDATES[2]}')) v(i, t)),
    answers AS (SELECT item_id, candidate_id, text, instruction || ' ' || text AS response
                FROM benchmark, c),
    facts AS (SELECT *, item_id || '/' || candidate_id AS k, {twins.facts('response')} AS p,
              {twins.facts('text')} AS e FROM answers),
    {twins.fact_f1_tables('facts', 'k', 'p', 'e')},
    graded AS (SELECT t.*, f1, {twins.citation('response')} AS citation,
               {twins.complete('text', 'response')} AS completeness FROM facts t JOIN f1_scores USING (k)),
    scores AS (SELECT *, citation::INT * 0.2::DOUBLE + f1 * 0.4::DOUBLE + completeness::INT * 0.1::DOUBLE
               AS total FROM graded)
    SELECT candidate_id, round(avg(total), 6) AS mean_score, count(*) AS examples FROM scores
    GROUP BY candidate_id ORDER BY avg(total) DESC, candidate_id LIMIT 1"""
)
def instruction_search(spark: SparkSession, folder: str) -> DataFrame:
    examples = read_parquet(spark, folder, "benchmark")
    tried = selection.try_candidates(examples, _CANDIDATES).withColumn(
        "response", F.concat_ws(" ", "instruction", "text")
    )
    scores = score_answers(
        tried, metrics.facts_of_text(F.col("text")), question="text", context=None
    )
    best = selection.best_candidate(scores, "candidate_id", "total")
    return best.withColumn("mean_score", F.round("mean_score", 6))


# A run per conversation and a stage per message: its score grows with the text, and
# a message of the system stands for a stage that failed.
_STAGES = """
  r AS (SELECT conv_id AS run_id, turn AS stage_no, role AS stage, length(text) / 2000 AS score,
        role <> 'system' AS ok FROM conversations),
  s AS (SELECT *, CASE WHEN ok THEN score ELSE 0.0 END AS stage_score FROM r),
  b AS (SELECT *, max(stage_score) OVER (PARTITION BY run_id ORDER BY stage_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM s),
  stages AS (SELECT *, coalesce(ok AND stage_score > best_before, false) AS accepted FROM b)"""
_RESULTS = f"""{_STAGES},
  t AS (SELECT run_id, arg_min(stage_score, stage_no) AS baseline_score, max(stage_score) AS final_score,
        sum(accepted::INT)::BIGINT AS accepted_stages FROM stages GROUP BY run_id),
  results AS (SELECT *, final_score - baseline_score AS improvement, CASE WHEN baseline_score > 0
        THEN (final_score - baseline_score) / baseline_score * 100 ELSE 0.0 END AS improvement_percent FROM t)"""


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    runs = read_parquet(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("stage_no"),
        F.col("role").alias("stage"),
        (F.length("text") / 2000).alias("score"),
    )
    return selection.accept_stages(runs, ok=F.col("stage") != "system")


@query(
    f"WITH {_STAGES} SELECT run_id, stage_no, stage, round(stage_score, 9) AS stage_score, "
    "round(best_before, 9) AS best_before, accepted FROM stages"
)
def stage_accept(spark: SparkSession, folder: str) -> DataFrame:
    return _stages(spark, folder).select(
        "run_id", "stage_no", "stage", F.round("stage_score", 9).alias("stage_score"),
        F.round("best_before", 9).alias("best_before"), "accepted",
    )


@query(
    f"WITH {_RESULTS} SELECT run_id, round(baseline_score, 9) AS baseline_score, "
    "round(final_score, 9) AS final_score, accepted_stages, round(improvement, 9) AS improvement, "
    "round(improvement_percent, 6) AS improvement_percent FROM results"
)
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    results = selection.run_results(_stages(spark, folder))
    digits = {"baseline_score": 9, "final_score": 9, "improvement": 9, "improvement_percent": 6}
    return results.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    f"WITH {_STAGES} SELECT run_id, stage_no, stage, round(stage_score, 9) AS stage_score, "
    "row_number() OVER (PARTITION BY run_id ORDER BY stage_no) - 1 AS entry FROM stages WHERE accepted"
)
def run_history(spark: SparkSession, folder: str) -> DataFrame:
    history = selection.accepted_history(_stages(spark, folder))
    return history.select(
        "run_id", "stage_no", "stage", F.round("stage_score", 9).alias("stage_score"), "entry"
    )


@query(
    f"WITH {_RESULTS} SELECT run_id, CASE WHEN accepted_stages > 1 THEN 'multi_stage' ELSE 'bootstrap_only' END "
    "AS strategy, round(final_score, 9) AS optimized_score, round(improvement, 9) AS improvement FROM results"
)
def run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Run records appended to the ledger and read back."""
    results = selection.run_results(_stages(spark, folder))
    strategy = F.when(F.col("accepted_stages") > 1, "multi_stage").otherwise("bootstrap_only")
    path = work_dir(spark, "ledger")
    append_runs(
        results.select(
            "run_id", strategy.alias("strategy"), F.round("final_score", 9).alias("optimized_score"),
            F.round("improvement", 9).alias("improvement"),
        ),
        path,
    )
    return spark.read.parquet(path).drop("logged_at")


_RECORDED = f"""{_RESULTS},
  accepted AS (SELECT run_id, stage, round(stage_score, 9) AS score,
               (row_number() OVER (PARTITION BY run_id ORDER BY stage_no) - 1)::INT AS position FROM stages WHERE accepted)"""


def _saved_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs saved as JSON and read back; every other run has pairs as history entries."""
    stages = _stages(spark, folder)
    results = selection.run_results(stages)
    results = results.withColumns({c: F.round(c, 9) for c in ("baseline_score", "final_score", "improvement")})
    history = selection.accepted_history(stages).withColumn("stage_score", F.round("stage_score", 9))
    example = lambda score: F.expr(
        f"inline(array(struct('end_to_end' AS metric, cast({score} >= 0.5 AS string) AS value), "
        f"struct('comprehensive' AS metric, cast({score} AS string) AS value)))"
    )
    sides = {"baseline": "baseline_score", "optimized": "final_score"}
    details = None
    for side, score in sides.items():
        part = results.select("run_id", F.lit(side).alias("side"), F.lit("example_1").alias("example"), example(score))
        details = part if details is None else details.unionByName(part)
    config = {
        "strategy": F.when(F.col("accepted_stages") > 1, "multi_stage").otherwise("bootstrap_only"),
        "training_examples": F.col("accepted_stages") * 10,
        "bootstrap_config": F.struct(F.lit(0.6).alias("metric_threshold"), F.struct(F.col("run_id").alias("seed")).alias("sampling")),
        "stages": F.array(F.lit("Bootstrap"), F.lit("Search")),
    }
    path = work_dir(spark, "runs")
    run_records.write_records(results, history, path, config, details, pairs=F.col("run_id") % 2 == 1)
    return run_records.read_records(spark, path)


@query(
    f"WITH {_RECORDED} SELECT r.run_id::VARCHAR AS run_id, CASE WHEN accepted_stages > 1 THEN 'multi_stage' ELSE 'bootstrap_only' END "
    "AS strategy, round(baseline_score, 9) AS base_score, round(final_score, 9) AS optimized_score, "
    "round(improvement, 9) AS improvement, position, stage, score FROM results r LEFT JOIN accepted USING (run_id)"
)
def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """Run records written as JSON files and read back, one row per accepted stage."""
    saved = _saved_runs(spark, folder)
    scores = run_records.run_scores(saved).drop("ran_at")
    return scores.join(run_records.run_history(saved).drop("ran_at"), "run_id")


@query(
    f"WITH {_RESULTS}, sides AS (SELECT run_id, 'baseline' AS side, round(baseline_score, 9) AS s FROM results UNION ALL "
    "SELECT run_id, 'optimized', round(final_score, 9) FROM results) SELECT run_id::VARCHAR AS run_id, side, 'example_1' AS example, "
    "'end_to_end' AS metric, s >= 0.5 AS passed, NULL::DOUBLE AS score FROM sides UNION ALL "
    "SELECT run_id::VARCHAR, side, 'example_1', 'comprehensive', NULL, s FROM sides"
)
def run_file_details(spark: SparkSession, folder: str) -> DataFrame:
    """Detailed scores of single examples out of the saved runs."""
    return run_records.run_details(_saved_runs(spark, folder))


@query(
    f"WITH {_RESULTS}, c AS (SELECT run_id, accepted_stages AS n FROM results) "
    "SELECT run_id::VARCHAR AS run_id, 'strategy' AS setting, CASE WHEN n > 1 THEN 'multi_stage' ELSE 'bootstrap_only' END AS value FROM c "
    "UNION ALL SELECT run_id::VARCHAR, 'training_examples', (n * 10)::VARCHAR FROM c "
    "UNION ALL SELECT run_id::VARCHAR, 'bootstrap_config.metric_threshold', '0.6' FROM c "
    "UNION ALL SELECT run_id::VARCHAR, 'bootstrap_config.sampling.seed', run_id::VARCHAR FROM c "
    "UNION ALL SELECT run_id::VARCHAR, 'stages', '[\"Bootstrap\",\"Search\"]' FROM c"
)
def run_file_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Every setting of the saved runs under its path."""
    return run_records.run_settings(_saved_runs(spark, folder))


_INSTRUCTIONS = "Answer from the passages."


@query(
    "SELECT conv_id || '/' || turn AS program, 'response_generator.predict' AS stage, "
    f"'{_INSTRUCTIONS}' AS instructions, 0 AS position, true AS augmented, question, answer "
    f"FROM ({twins.ANSWERED_TURNS})"
)
def program_files(spark: SparkSession, folder: str) -> DataFrame:
    """Few-shot programs with one demo each, written as JSON and read back as demo rows."""
    stage = "response_generator.predict"
    turns = answered_turns(read_parquet(spark, folder, "conversations"))
    demo = F.struct(
        F.lit(True).alias("augmented"), "question", "answer",
        F.concat_ws("/", "conv_id", "turn").alias("reasoning"),
    )
    program = F.struct(
        F.array(demo).alias("demos"),
        F.struct(F.lit(_INSTRUCTIONS).alias("instructions")).alias("signature"),
    )
    path = work_dir(spark, "programs")
    turns.select(program.alias(stage)).write.json(path)
    demos = read_program_files(spark, path, [stage])
    return demos.select(
        F.col("reasoning").alias("program"), "stage", "instructions", "position", "augmented",
        "question", "answer",
    )
