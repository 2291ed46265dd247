"""Selection job: compare programs, choose demos, accept stages, keep a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from passagework.operators.positions import best_before, position_in_key

# Few-shot limits and threshold, and the size of the detailed report.
MAX_BOOTSTRAPPED_DEMOS = 2
MAX_LABELED_DEMOS = 1
DEMO_THRESHOLD = 0.3
DETAILED_EXAMPLES = 3


def compare_programs(scores: DataFrame, program: str, score: str) -> DataFrame:
    """Mean score and example count per program."""
    return scores.groupBy(program).agg(
        F.avg(score).alias("mean_score"), F.count("*").alias("examples")
    )


def detailed_examples(
    scores: DataFrame, program: str, order: list[str], limit: int = DETAILED_EXAMPLES
) -> DataFrame:
    """The first examples of each program with their position from 1.

    Written as a ranked top-n, so each task keeps only ``limit`` rows per program
    before the shuffle.
    """
    first = Window.partitionBy(program).orderBy(*order)
    return scores.withColumn("example", F.row_number().over(first)).filter(
        F.col("example") <= limit
    )


def choose_demos(
    scored: DataFrame,
    stage: str,
    key: str,
    score: str,
    order: list[str] | None = None,
    threshold: float = DEMO_THRESHOLD,
    max_bootstrapped: int = MAX_BOOTSTRAPPED_DEMOS,
    max_labeled: int = MAX_LABELED_DEMOS,
) -> DataFrame:
    """Few-shot demos per stage: (stage, position, key, augmented).

    The first rows that reach the threshold become generated demos; the first of
    the remaining rows fill up as labelled demos.
    """
    order = order or [key]
    rows = scored.select(stage, key, score, *[c for c in order if c not in (stage, key, score)])
    good = F.coalesce(F.col(score) >= threshold, F.lit(False))
    # The first max_bootstrapped + max_labeled rows on each side of the threshold hold
    # every demo, so the ranking below cuts a large stage before the shuffle.
    by_side = Window.partitionBy(stage, "_good").orderBy(*order)
    early = (
        rows.withColumn("_good", good)
        .withColumn("_place", F.row_number().over(by_side))
        .filter(F.col("_place") <= max_bootstrapped + max_labeled)
        .withColumn("augmented", F.col("_good") & (F.col("_place") <= max_bootstrapped))
    )
    by_kind = Window.partitionBy(stage, "augmented").orderBy(*order)
    placed = early.withColumn("position", F.row_number().over(by_kind))
    return placed.filter(F.col("augmented") | (F.col("position") <= max_labeled)).select(
        stage, "augmented", "position", key
    )


def try_candidates(examples: DataFrame, candidates: list[str], name: str = "instruction") -> DataFrame:
    """Every example once per candidate instruction: adds candidate_id and the text."""
    options = F.array(*[
        F.struct(F.lit(i).alias("candidate_id"), F.lit(text).alias(name))
        for i, text in enumerate(candidates)
    ])
    return examples.withColumn("_option", F.explode(options)).select(
        *examples.columns, "_option.*"
    )


def best_candidate(scores: DataFrame, candidate: str, score: str) -> DataFrame:
    """The candidate with the highest mean score, the smaller id on a tie."""
    means = compare_programs(scores, candidate, score)
    return means.orderBy(F.desc("mean_score"), candidate).limit(1)


def accept_stages(
    runs: DataFrame,
    run: str = "run_id",
    stage_no: str = "stage_no",
    score: str = "score",
    ok: Column | None = None,
) -> DataFrame:
    """Add the usable score, the best score before each stage, and whether it was accepted.

    A failed stage scores 0, and a score that is not a number counts as failure. A stage
    is accepted when it succeeded and beats every earlier stage strictly; the first stage
    of a run is its baseline. A stage without run or number has no place in an order: it
    is returned with nothing before it and is never accepted.
    """
    succeeded = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    number = ~F.coalesce(F.isnan(F.col(score).cast("double")), F.lit(False))
    scored = runs.withColumn("ok", succeeded & number).withColumn(
        "stage_score", F.when(F.col("ok"), F.coalesce(F.col(score), F.lit(0.0))).otherwise(0.0)
    )
    placed = F.col(run).isNotNull() & F.col(stage_no).isNotNull()
    ranked = best_before(scored.filter(placed), run, stage_no, "stage_score", "best_before").unionByName(
        scored.filter(~placed).withColumn("best_before", F.lit(None).cast("double"))
    )
    return ranked.withColumn(
        "accepted",
        F.coalesce(F.col("ok") & (F.col("stage_score") > F.col("best_before")), F.lit(False)),
    )


def run_results(stages: DataFrame, run: str = "run_id", stage_no: str = "stage_no") -> DataFrame:
    """One row per run: baseline, final score, improvement and percent (0 for a zero baseline)."""
    totals = stages.groupBy(run).agg(
        F.min_by("stage_score", stage_no).alias("baseline_score"),
        F.max("stage_score").alias("final_score"),
        F.count_if("accepted").alias("accepted_stages"),
    )
    gain = F.col("final_score") - F.col("baseline_score")
    return totals.withColumn("improvement", gain).withColumn(
        "improvement_percent",
        F.when(F.col("baseline_score") > 0, gain / F.col("baseline_score") * 100).otherwise(0.0),
    )


def accepted_history(stages: DataFrame, run: str = "run_id", stage_no: str = "stage_no") -> DataFrame:
    """Accepted stages of every run, numbered from 0 in the order they were accepted."""
    return position_in_key(stages.filter("accepted"), run, stage_no, "entry")
