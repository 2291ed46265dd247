"""Saved optimisation runs, semi-structured as they are, in JSON files.

A record has scores, a history of accepted stages whose entries are objects or [name, score]
pairs, maps of detailed scores per example, and settings nested as deep as their makers liked.
It is read as one variant per record, so no shape has to be declared and nothing is dropped;
the functions below make tables of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETAILS = {"baseline": "detailed_baseline_scores", "optimized": "detailed_optimized_scores"}


def read_records(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """(run_id, file, record): one row per saved run, a line each or with ``one_per_file`` a file.

    A record without a ``run_id`` is named by the digest of its content.
    """
    read = spark.read.option("singleVariantColumn", "record").option("multiLine", one_per_file).json(path)
    own = F.try_variant_get("record", "$.run_id", "string")
    return read.select(
        F.coalesce(own, F.sha2(F.to_json("record"), 256)).alias("run_id"), F.col("_metadata.file_path").alias("file"), "record"
    )


def run_scores(records: DataFrame) -> DataFrame:
    """One row per run: its scores, strategy and time, null where the record lacks them."""
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind)
    return records.select(
        "run_id",
        F.coalesce(get("strategy", "string"), get("config.strategy", "string")).alias("strategy"),
        F.coalesce(get("base_score", "double"), get("baseline_score", "double")).alias("base_score"),
        F.coalesce(get("optimized_score", "double"), get("final_score", "double")).alias("optimized_score"),
        get("improvement", "double").alias("improvement"),
        get("timestamp", "timestamp").alias("ran_at"),
    )


def run_history(records: DataFrame) -> DataFrame:
    """(run_id, position, stage, score, ran_at): the accepted stages in order.

    A run without an accepted stage keeps one row with a null position.
    """
    entries = F.try_variant_get("record", "$.optimization_history", "array<variant>")
    listed = records.select("run_id", F.posexplode_outer(entries).alias("position", "entry"))
    get = lambda path, kind: F.try_variant_get("entry", path, kind)
    return listed.select(
        "run_id", "position",
        F.coalesce(get("$.stage", "string"), get("$[0]", "string")).alias("stage"),
        F.coalesce(get("$.score", "double"), get("$[1]", "double")).alias("score"),
        get("$.timestamp", "timestamp").alias("ran_at"),
    )


def run_details(records: DataFrame) -> DataFrame:
    """(run_id, side, example, metric, passed, score): detailed scores of single examples.

    ``passed`` is set for yes-or-no metrics, ``score`` for numbers; runs without details have no row.
    """
    sides = [
        F.struct(F.lit(side).alias("side"), F.try_variant_get("record", f"$.{name}", "map<string,variant>").alias("examples"))
        for side, name in DETAILS.items()
    ]
    per_example = records.select("run_id", F.inline(F.array(*sides))).select("run_id", "side", F.explode("examples").alias("example", "metrics"))
    per_metric = per_example.select(
        "run_id", "side", "example", F.explode(F.try_variant_get("metrics", "$", "map<string,variant>")).alias("metric", "value")
    )
    truth = F.schema_of_variant("value") == "BOOLEAN"
    return per_metric.select(
        "run_id", "side", "example", "metric",
        F.when(truth, F.try_variant_get("value", "$", "boolean")).alias("passed"),
        F.when(~truth, F.try_variant_get("value", "$", "double")).alias("score"),
    )


def run_settings(records: DataFrame, depth: int = 6) -> DataFrame:
    """(run_id, setting, value): every setting as text under its dotted path.

    Objects are opened up to ``depth`` levels; what lies deeper, and arrays, stay JSON text.
    """
    open_here = records.select("run_id", F.lit("").alias("setting"), F.try_variant_get("record", "$.config", "variant").alias("value"))
    done = None
    for level in range(depth):
        inner = F.try_variant_get("value", "$", "map<string,variant>")
        opened = open_here.select(
            "run_id", F.col("setting").alias("above"), F.explode(inner).alias("name", "value")
        ).select("run_id", F.concat_ws(".", F.expr("nullif(above, '')"), "name").alias("setting"), "value")
        nested = F.schema_of_variant("value").startswith("OBJECT")
        leaves = opened.where(~nested if level < depth - 1 else F.lit(True)).select("run_id", "setting", as_text(F.col("value")).alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        open_here = opened.where(nested)
    return done


def as_text(value: Column) -> Column:
    """A variant as text: strings bare, everything else as JSON."""
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string")), F.to_json(value))


def write_records(
    results: DataFrame, history: DataFrame, path: str, config: dict[str, Column], details: DataFrame | None = None,
    run: str = "run_id", pairs: Column | None = None,
) -> None:
    """Save runs as JSON lines that ``read_records`` reads.

    ``results`` has a row per run with ``baseline_score``, ``final_score`` and
    ``improvement``; ``history`` has ``entry``, ``stage`` and ``stage_score`` of accepted
    stages; ``details`` has side, example, metric and value (text of a JSON value).
    ``config`` gives the settings as columns of ``results``. Where ``pairs`` is true, history
    entries are [name, score] pairs instead of objects.
    """
    as_pair = F.lit(False) if pairs is None else pairs
    # A JSON string is cut out of an object with this one field.
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("stage").alias("s"))), r'^\{"s":(.*)\}$', 1)
    entry = F.when(as_pair, F.concat(F.lit("["), quoted, F.lit(","), F.col("stage_score").cast("string"), F.lit("]"))).otherwise(
        F.to_json(F.struct("stage", F.col("stage_score").alias("score")))
    )
    entries = history.select(run, "entry", entry.alias("json")).groupBy(run).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("entry", "json"))), lambda e: e["json"]).alias("entries")
    )
    fields = ["strategy", "base_score", "optimized_score", "improvement"]
    rows = results.join(entries, run, "left").select(
        F.col(run).cast("string").alias("run_id"), config["strategy"].alias("strategy"), F.col("baseline_score").alias("base_score"),
        F.col("final_score").alias("optimized_score"), "improvement",
        F.concat(F.lit("["), F.array_join(F.coalesce("entries", F.array().cast("array<string>")), ","), F.lit("]")).alias("history"),
        F.to_json(F.struct(*[c.alias(name) for name, c in config.items()])).alias("config"),
    )
    scores = {name: F.lit("{}") for name in DETAILS.values()}
    if details is not None:
        per = details.groupBy(F.col(run).cast("string").alias("run_id"), "side", "example").agg(
            F.map_from_entries(F.collect_list(F.struct("metric", F.parse_json("value").alias("value")))).alias("metrics")
        ).groupBy("run_id").pivot("side", list(DETAILS)).agg(
            F.to_json(F.map_from_entries(F.collect_list(F.struct("example", "metrics"))))
        )
        rows = rows.join(per, "run_id", "left")
        scores = {name: F.coalesce(side, F.lit("{}")) for side, name in DETAILS.items()}
    parsed = {"optimization_history": F.col("history"), "config": F.col("config"), **scores}
    record = F.struct("run_id", *fields, *[F.parse_json(text).alias(name) for name, text in parsed.items()])
    rows.select(F.to_json(record).alias("value")).write.mode("overwrite").text(path)
