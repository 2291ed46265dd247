"""How filters interact: what each removes in every order, and its fair share.

The states of an audit are the sets of filters applied so far. An edge adds one filter and
removes the documents that fail it and none applied before. Orders are paths from the empty
set to the full one: the number that reach an edge's start, times the number that leave its
end, is the number of orders that take the edge. Weighted with it, an edge's removals add up
to the Shapley sum of its filter; a single order reads its steps from its own edges.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.llm.common import save

MOST_FILTERS = 8


def lattice(filters: int) -> list[tuple[int, int, int]]:
    """(state, filter bit, orders that take this edge) of every edge."""
    full = (1 << filters) - 1
    bits = [1 << i for i in range(filters)]
    reach, leave = {0: 1}, {full: 1}
    for state in range(1, full + 1):  # a state's subsets have smaller numbers
        reach[state] = sum(reach[state ^ bit] for bit in bits if state & bit)
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | bit] for bit in bits if not state & bit)
    return [(s, bit, reach[s] * leave[s | bit]) for s in range(full + 1) for bit in bits if not s & bit]


def _steps(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, state, bit): the edges of every order."""
    rows = []
    for order in permutations(range(len(letters))):
        name, state = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            rows.append((name, step, state, 1 << i))
            state |= 1 << i
    return _table(spark, rows, "filter_order string, step int, state int, bit int")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table inside the plan, without tasks in Python."""
    names = [field.split()[0] for field in schema.split(", ")]
    content = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(content), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def failures(
    docs: DataFrame, conditions: dict[str, Column], copies: str | None, part: str, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(part, _id, mask, n): documents by the set of filters that they fail, a bit for each in order.

    ``conditions`` says when a document fails; the filter named ``copies`` has the last bit and
    fails documents whose text some document of a smaller id has. Rows equal in these columns
    are counted together, so that a text or an id that many rows share travels as one.
    """
    mask = F.lit(0)
    for i, failed in enumerate(conditions.values()):
        mask = mask + F.coalesce(failed, F.lit(False)).cast("int") * (1 << i)
    own = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(id).alias("_id"), mask.alias("mask"),
        F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)).alias("digest"),
    )
    rows = save(own.groupBy("digest", "_id", "part", "mask").agg(F.count("*").alias("n")), "failures")
    if copies is None:
        return rows
    first = rows.where(F.col("_id").isNotNull()).groupBy("digest").agg(F.min("_id").alias("_id")).withColumn("first", F.lit(True))
    # Joined by text and id: copies of one text lie apart.
    copy = (F.col("_id").isNotNull() & F.col("first").isNull()).cast("int")
    return rows.join(first, ["digest", "_id"], "left").select(
        "part", "_id", "digest", (F.col("mask") + copy * (1 << len(conditions))).alias("mask"), "n"
    )


def audit(
    docs: DataFrame, conditions: dict[str, Column], losses: dict[str, tuple[DataFrame, Column]], copies: str | None = "E",
    part: str = "source", id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does there.

    ``conditions`` maps filters' one-letter names to when a document fails; ``copies`` names the
    filter on texts that a document of a smaller id has, or is None. ``losses`` maps a name to
    a table with the id column and a condition on it: removed documents that it marks are
    counted as ``<name>_lost``.

    Columns: part, filter_order, step, kept (after this step), removed (here), redundant (fail
    this filter but were removed before), unique_fails (fail this filter only), the losses, and
    shapley (removed by this filter, summed over all orders). Null and empty texts are equal
    texts; an undecided condition (null) doesn't fail; a null part counts as the empty string.
    A null id is smaller or larger than none, so such a document is nobody's copy, and it has
    no mark; of an id marked twice one mark is enough. Repeated rows count each, and rows that
    share id and text are not copies of each other. Parts are those of the documents; an empty
    table gives no row. Other columns are not looked at.
    """
    letters = "".join(conditions) + (copies or "")
    if len(set(letters)) != len(conditions) + (copies is not None) or len(letters) > MOST_FILTERS:
        raise ValueError(f"filters have different one-letter names, {MOST_FILTERS} at most")
    rows = failures(docs, conditions, copies, part, id, text)
    lost = [f"{name}_lost" for name in losses]
    for name, (table, marked) in zip(lost, losses.values()):
        flags = table.where(marked & F.col(id).isNotNull()).select(
            F.col(id).alias("_id"), F.lit(0).cast("long").alias("_spread"), F.lit(True).alias(name)
        ).distinct()
        # Null ids, which match nothing, are spread over the tasks.
        spread = F.when(F.col("_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
        rows = rows.withColumn("_spread", spread).join(flags, ["_id", "_spread"], "left").drop("_spread")
    counts = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in lost]
    )
    edges = F.broadcast(_table(docs.sparkSession, lattice(len(letters)), "state int, bit int, orders long"))
    steps = F.broadcast(_steps(docs.sparkSession, letters))  # both as large as the number of filters makes them
    # Every edge gets a row, also where nothing is removed.
    of = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))).alias("state")).join(edges, "state")
    fails, before = F.expr("mask & bit") != 0, F.expr("mask & state") != 0
    total = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0))
    taken = of.groupBy("part", "state", "bit", "orders").agg(
        total(~before & ~fails).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        *[total(fails & ~before, c).alias(c) for c in lost],
    )
    shared = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "bit"))
    return taken.withColumn("shapley", shared).join(steps, ["state", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"
    )
