"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import (
    bpe,
    decontaminate,
    interaction,
    neardup,
    periodic,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    substrings,
    urls,
    warc,
    windows,
)
from passagework.llm.sql import TWINS
from passagework.operators.steps import settle
from passagework.sources.tables import read_parquet

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def multilingual() -> tuple[list[bytes], str]:
    """Tokens and pattern of the multilingual byte-level vocabulary."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = read_parquet(spark, folder, "documents"), read_parquet(spark, folder, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, items))


@query
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.with_secrets(read_parquet(spark, folder, "documents").select("doc_id", "text")))


@query
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(read_parquet(spark, folder, "documents"), *multilingual())


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_parquet(spark, folder, "documents"), read_parquet(spark, folder, "labels")
    return quality_rules.digest(quality_rules.judged(docs, labels))


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_parquet(spark, folder, "documents"), read_parquet(spark, folder, "labels")
    return quality_classifier.digest(quality_classifier.scored(docs, labels))


@query
def op6_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """The second replica has a changed last byte in every page whose length divides by 97."""
    body = F.col("body")
    damage = F.when(
        body.endswith(">") & (F.length(body) % 97 == 0),
        F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit("?")),
    ).otherwise(body)
    found = warc.audited(read_parquet(spark, folder, "pages"), damage)
    return found.withColumnRenamed("_id", "page_id")


@query
def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.digest(neardup.near_duplicates(read_parquet(spark, folder, "documents")))


@query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.digest(urls.judged(read_parquet(spark, folder, "pages")))


@query
def url_filter_linked(spark: SparkSession, folder: str) -> DataFrame:
    """The same with links in the pages, which hold none themselves; the id decides kind and target."""
    id = F.col("page_id")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    ninth = F.floor(id / 9)
    link = (
        F.when(id % 6 == 0, text('<link href="http://shop.example.com/fr/../de/', id % 3, '" rel=canonical>'))
        .when(id % 6 == 1, text('<meta http-equiv="refresh" content="0; url=../es/./', id % 40, '">'))
        .when(id % 6 == 2, text('<link rel="canonical" href="?ref=', id % 5, '#top">'))
        .when(id % 6 == 3, text('<meta http-equiv=refresh content="3;url=//mirror.example.net/', ninth, '">'))
        .when(id % 6 == 4, text(
            '<link rel=canonical href="mailto:a@b.c"><link rel=canonical href="http://mirror.example.net:80/', ninth, '">'
        ))
        .otherwise("")
    )
    pages = read_parquet(spark, folder, "pages")
    return urls.digest(urls.judged(pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), link))))


@query
def op9_substring_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.digest(windows.without_repeats(read_parquet(spark, folder, "documents")))


@query
def op10_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(substrings.without_repeats(read_parquet(spark, folder, "documents")))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(periodic.with_runs(periodic.looped(read_parquet(spark, folder, "documents"))))


@query
def op12_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(read_parquet(spark, folder, "documents"), shards=16)


@query
def op13_filter_interaction(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_parquet(spark, folder, "documents"), read_parquet(spark, folder, "labels")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = settle(docs.select("doc_id", "source", "text"), "words", words)
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    conditions = {
        "A": F.size("words") < 50,
        "B": 100 * F.size(F.array_distinct("words")) < 65 * F.size("words"),
        "C": 100 * capitals > 5 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    losses = {"good": (labels, F.col("quality") == 1), "toxic": (labels, F.col("toxic") == 1)}
    return interaction.audit(docs, conditions, losses, copies="E")


ORACLES = {name: TWINS[name] for name in QUERIES if name in TWINS}
