"""Control over where an expensive expression is evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, before anything that uses it.

    The optimiser copies a projected expression into the filters and lambdas that
    use it, so a long text expression would run again in each. It does not move
    the output of a generator, and a one-element array keeps the rows as they are.
    """
    settled = df.select(*df.columns, F.explode(F.array(value)).alias("_settled"))
    if name not in df.columns:
        return settled.withColumnRenamed("_settled", name)
    return settled.select(*[F.col("_settled").alias(c) if c == name else c for c in df.columns])
