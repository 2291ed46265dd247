"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item (a shorter item is one window).
The fingerprint of a window is the smallest hash of the word k-grams inside it. With
``k + w - 1 = span`` a window holds exactly ``w`` k-grams, so equal windows have equal
fingerprints on both sides: every shared span of ``span`` words is found. Neighbouring
windows mostly share their fingerprint, so a text keeps about ``2 / (w + 1)`` of them.
Fingerprints are joined, and every hit is extended to the windows behind it, which are
compared as text; the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import LOWER, SENT_ROWS, UPPER, same, save, sha, small, text_key, without
from passagework.operators.steps import settle

SPAN = 13
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters a-z, digits and characters beyond ASCII, with A-Z lower-cased."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, _APART), "")


def _grams(length: int) -> tuple[int, int]:
    """Words per k-gram and k-grams per window, for windows of this many words."""
    window = max(1, length // 2)
    return length - window + 1, window


def _with_fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``runs``: for every window length the runs [s, e) of window starts with one fingerprint f."""
    df = settle(df, "_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    runs = []
    for t in lengths:
        k, w = _grams(t)
        grams, lows, heads = f"_g{t}", f"_m{t}", f"_h{t}"
        at = lambda name, i: F.get(F.col(name), i)
        n = F.size("_hashes")
        upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        df = settle(df, grams, F.transform(
            upto(n - k), lambda i: F.xxhash64(F.lit(t), *[at("_hashes", i + j) for j in range(k)])
        ))
        df = settle(df, lows, F.transform(
            upto(n - t), lambda i: F.least(*[at(grams, i + j) for j in range(w)]) if w > 1 else at(grams, i)
        ))
        df = settle(df, heads, F.filter(
            upto(n - t), lambda i: (i == 0) | (at(lows, i) != at(lows, i - 1))
        ))
        runs.append(F.transform(upto(F.size(heads) - 1), lambda j: F.struct(
            F.lit(t).alias("t"),
            at(heads, j).alias("s"),
            F.coalesce(at(heads, j + 1), n - t + 1).alias("e"),
            at(lows, at(heads, j)).alias("f"),
        )))
    none = F.struct(F.lit(0).alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit(None).cast("long").alias("f"))
    # One run without fingerprint stands for the text itself.
    return settle(df, "_runs", F.concat(F.array(none), *runs))


def _window(at: Column, length: Column) -> Column:
    return F.array_join(F.slice("_words", at + 1, length), " ")


def item_windows(benchmark: DataFrame, item: str, text: str, span: int) -> DataFrame:
    """(item, t, window, f): every window of every item, its words joined, and its fingerprint."""
    items = settle(
        benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("_text")),
        "_words", words_of(F.col("_text")),
    ).select("item", "_words", F.least(F.size("_words"), F.lit(span)).alias("t")).where("t > 0")
    items = save(items, "items")
    lengths = [r["t"] for r in items.select("t").distinct().orderBy("t").collect()]  # at most ``span`` of them
    found = None
    for t in lengths:
        part = _with_fingerprints(items.where(F.col("t") == t).drop("t"), [t]).select(
            "item", "_words", F.explode("_runs").alias("r")
        ).where("r.t > 0").select(
            "item", "_words", "r.t", "r.f", F.explode(F.sequence(F.col("r.s"), F.col("r.e") - 1)).alias("at")
        ).select("item", "t", _window(F.col("at"), F.col("t")).alias("window"), "f")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.select("item", "t", F.lit("").alias("window"), F.lit(0).cast("long").alias("f"))
    return save(found.distinct(), "windows"), lengths


def contamination(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", span: int = SPAN, sent_rows: int = SENT_ROWS,
) -> DataFrame:
    """One row per document: (_id, _key, n_words, n_hit, n_items, items, contaminated).

    ``items`` is the sorted array of the ids, as strings, of the items with a window in
    the document. A document is contaminated when at least one in twenty words is hit.

    Null or empty texts have no words and no hits. Rows that repeat id and text are judged
    alike, one row each; rows that share only the id are judged apart; a null id is an id
    like others. Items without words match nothing, a null item id reads as the empty
    string, repeated items count once. Empty tables give empty or clean results. Other
    columns, whatever their names, are not looked at.
    """
    windows, lengths = item_windows(benchmark, item, item_text, span)
    prints = windows.select("f").distinct()
    own = docs.select(F.col(id).alias("_id"), text_key(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    spread = _with_fingerprints(settle(own, "_words", words_of(F.col("_text"))).drop("_text"), lengths)
    spread = spread.withColumn("n", F.size("_words").cast("long"))
    known = prints.withColumn("known", F.lit(True))
    if small(windows, sent_rows):
        # The words of a text stay beside its runs until a run is hit; nothing is shuffled.
        runs = spread.select("_id", "_key", "n", "_words", F.explode("_runs").alias("r"))
        runs = runs.select("_id", "_key", "n", "_words", "r.*")
        hit = runs.join(F.broadcast(known), "f", "left").where("known or t = 0")
    else:
        runs = spread.select("_id", "_key", "n", F.explode("_runs").alias("r")).select("_id", "_key", "n", "r.*")
        found = runs.join(known, "f", "left").where("known or t = 0")
        # A text's runs are at most as many as its words.
        by_text = found.groupBy("_id", "_key").agg(F.collect_list(F.struct("n", "t", "s", "e")).alias("found"))
        tokens = settle(own.dropDuplicates(["_id", "_key"]), "_words", words_of(F.col("_text")))
        hit = tokens.join(by_text, same(tokens, by_text, "_id", "_key")).select(
            tokens["_id"], tokens["_key"], "_words", F.explode("found").alias("r")
        ).select("_id", "_key", "_words", "r.*")
    hit = hit.select(
        "_id", "_key", "n", "t", "_words", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("at")
    ).select("_id", "_key", "n", "t", "at", F.when(F.col("t") > 0, _window(F.col("at"), F.col("t"))).alias("window"))
    texts = windows.select("window").distinct().withColumn("real", F.lit(True))
    if small(windows, sent_rows):
        texts = F.broadcast(texts)
    hits = save(hit.join(texts, "window", "left").where("real or t = 0").drop("real"), "hits")

    covered = F.aggregate(
        F.array_sort("at"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["e"]).alias("end"),
            (a["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("sum"),
        ),
        lambda a: a["sum"].cast("long"),
    )
    per_text = hits.groupBy("_id", "_key").agg(
        F.max("n").alias("n_words"),
        F.count_if(F.col("t") == 0).alias("copies"),
        F.collect_set(F.when(F.col("t") > 0, F.struct(F.col("at").alias("s"), (F.col("at") + F.col("t")).alias("e")))).alias("at"),
    ).withColumn("n_hit", covered)
    pairs = hits.where("t > 0").select("_id", "_key", "window").distinct().join(
        windows.select("item", "window").distinct(), "window"
    ).select("_id", "_key", "item").distinct()
    items = pairs.groupBy("_id", "_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    return per_text.join(items, same(per_text, items, "_id", "_key"), "left").select(
        per_text["_id"], per_text["_key"], "n_words", "n_hit", "copies", F.coalesce("items", none).alias("items"),
    ).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "_id", "_key", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    found = contamination(docs, benchmark, id, text, **options)
    return without(docs, found.where("contaminated"), id, text)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``."""
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit", "n_items",
        sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated",
    )
