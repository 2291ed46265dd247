"""Search for the best of many candidates, on growing slices of the examples."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key's place in the order of slices: the first 32 bits of its digest.
PLACES = 1 << 32


def place(key: Column) -> Column:
    """A number below ``PLACES`` for a key, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def race(
    examples: DataFrame, candidates: DataFrame, score: Callable[[DataFrame], DataFrame], key: str,
    candidate: str = "candidate_id", value: str = "total", keep: int = 2,
) -> DataFrame:
    """The best candidate: (candidate, mean_score, examples, evaluations).

    Successive halving: a round scores the candidates that are left on the examples which
    the slice grows by, adds that to what it knows and keeps the better one of ``keep``; the
    last round has seen every example. ``candidates`` is a small table with a unique
    ``candidate`` column; ``score`` adds ``value`` to examples that carry the columns of a
    candidate. A missing score counts as 0. Ties go to the smaller candidate, in every round,
    and a round whose slice is empty drops nobody. Without examples there is no result row.
    """
    if keep < 2:
        raise ValueError("a round has to keep a part of its candidates")
    spark = examples.sparkSession
    left = sorted(row[0] for row in candidates.select(candidate).collect())
    rounds = max(1, math.ceil(math.log(max(1, len(left)), keep) - 1e-9))
    sums = {c: 0.0 for c in left}
    seen = evaluations = below = 0
    for turn in range(rounds):
        above = PLACES // keep ** (rounds - 1 - turn)
        inside = (place(F.col(key)) >= below) & (place(F.col(key)) < above)
        if turn == rounds - 1:
            inside = inside | F.col(key).isNull()  # an example without a key has no place
        below = above
        tried = (
            examples.where(inside)
            .withColumn(candidate, F.explode(F.from_json(F.lit(str(left)), "array<long>").cast(f"array<{candidates.schema[candidate].dataType.simpleString()}>")))
            .join(F.broadcast(candidates), candidate)
        )
        # One row per candidate that is left.
        found = score(tried).groupBy(candidate).agg(
            F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("sum"), F.count("*").alias("n")
        ).collect()
        for row in found:
            sums[row[candidate]] += row["sum"]
            evaluations += row["n"]
        seen += max((row["n"] for row in found), default=0)
        if found and turn < rounds - 1:
            # Sums depend on the order of addition in their last digits; ties have to be ties.
            best = sorted(left, key=lambda c: (-round(sums[c] / seen, 9), c))
            left = sorted(best[:max(1, math.ceil(len(left) / keep))])
    kind = candidates.schema[candidate].dataType.simpleString()
    schema = f"{candidate} {kind}, mean_score double, examples long, evaluations long"
    if not seen or not left:
        return spark.createDataFrame([], schema)
    winner = min(left, key=lambda c: (-round(sums[c] / seen, 9), c))
    return spark.createDataFrame([(winner, sums[winner] / seen, seen, evaluations)], schema)
