"""Periodic runs, byte shards and the filter audit against plain versions."""

import hashlib
import itertools
import math
import os
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.llm import interaction, periodic, sharding
from passagework.llm.queries import QUERIES

GAPS = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(os.path.join(folder, "documents.parquet"))


# --- periodic runs -------------------------------------------------------------


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if words[p:] == words[:len(words) - p])


def plain_runs(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            long = j - i + q
            if j > i and long >= max(least, times * q) and smallest_period(words[i:i + long]) == q:
                out.append((i, long, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(id, text):
    words = re.findall(GAPS, text or "")
    h = zlib.crc32(str(id).encode()) if id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, long, q in runs for i in range(s + q, s + long)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{long},{q}\n" for s, long, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def numbered(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


# Stretches repeated a few times, cut anywhere, one behind the other.
pieces = st.lists(
    st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8)).map(
        lambda x: (x[0] * x[1])[:max(1, len(x[0]) * x[1] - x[2])]
    ), max_size=6,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces, st.integers(1, 12), st.integers(3, 5))
def test_runs_of_any_words(words, least, times):
    assert periodic.runs_of(numbered(words), len(words), least, times) == plain_runs(words, least, times)


@settings(max_examples=100, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4))
def test_documents_in_one_block_stay_apart(texts):
    spaced = [" ".join(t) for t in texts]
    found = periodic._described(spaced, 6, 4)
    assert [f[1] for f in found] == [plain_runs(t) for t in texts]


def test_long_periods_and_long_runs():
    period = [f"w{i}" for i in range(700)]
    words = ["x"] * 3 + period * 5 + ["y"] + ["z"] * 20000 + period[:50] * 30
    assert periodic.runs_of(numbered(words), len(words)) == [(3, 3500, 700), (3504, 20000, 1), (23504, 1500, 50)]
    assert periodic.runs_of(np.zeros(0, np.int64), 0) == []
    with pytest.raises(ValueError):
        periodic.lag_classes(100, times=2)


def test_seeds_of_one_repeated_word_are_few():
    """A gram with n occurrences gives one seed, not a number that grows with pairs."""
    grams = periodic.Grams(np.zeros(5000, np.int64))
    grams.grow(5)
    assert len(grams.seeds(1, 5)[0]) == 1


def test_run_digests(spark, odd, empty, monkeypatch):
    made = spark.createDataFrame(
        [(i, " ".join(["pre", *("a b c".split() * (i % 7)), "mid", *["d"] * (i % 9)]) + "\t\x0b é é é é é é  ") for i in range(120)],
        "doc_id long, text string",
    )
    for table in (odd, made):
        wanted = sorted((plain_digest(r["doc_id"], r["text"]) for r in table.collect()), key=repr)
        assert rows(periodic.digest(periodic.with_runs(periodic.looped(table)))) == wanted
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", 8)
    assert rows(periodic.digest(periodic.with_runs(periodic.looped(odd)))) == sorted(
        (plain_digest(r["doc_id"], r["text"]) for r in odd.collect()), key=repr
    )
    found = periodic.with_runs(odd)
    assert found.columns == ["doc_id", "_id", "_key", "n", "words", "starts", "n_words", "runs", "collapsed"]
    assert periodic.with_runs(empty).count() == 0
    clash = odd.select("doc_id", "text", F.lit(1).alias("runs"), F.lit("x").alias("_text"))
    assert rows(periodic.with_runs(clash).select("doc_id", "n_words", "runs")) == rows(found.select("doc_id", "n_words", "runs"))


def test_run_query(spark, folder, docs):
    found = rows(QUERIES["op11_periodic_runs"](spark, folder))
    assert found == sorted((plain_digest(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert sum(r[1] > 0 for r in found) > 10


# --- shards ----------------------------------------------------------------------


def plain_shards(sizes, shards):
    """Shard and slot of sizes in order."""
    out, done, total, slots = [], 0, sum(sizes), {}
    for size in sizes:
        middle = Fraction(2 * done + size, 2)
        shard = min(shards - 1, math.floor(shards * middle / total)) if total else 0
        out.append((shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        done += size
    return out


@pytest.mark.parametrize("ranges", [1_000_000, 20])
def test_shards(docs, odd, ranges):
    for table in (docs, odd):
        measured = sharding.measured(table)
        found = sharding.sharded(measured, F.col("size"), ["doc_id", "text_crc32", "size"], 7, ranges)
        given_rows = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in table.collect()]
        order = sorted(given_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
        wanted = [(*r, *place) for r, place in zip(order, plain_shards([r[1] for r in order], 7))]
        assert rows(found) == sorted(wanted, key=repr)


def test_a_hot_id_is_cut(spark, tmp_path):
    """A third of the rows are one row; shards stay balanced and cut it."""
    many = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"),
        *[F.lit(1).alias(c) for c in ("given", "key", "range", "nth", "first", "shard", "slot", "size")],
    )
    found = sharding.sharded(many, F.octet_length("text"), ["doc_id"], 10, 100)
    assert sorted(found.columns) == sorted(many.columns)
    per = {r["shard"]: (r["n"], r["low"], r["high"]) for r in found.groupBy("shard").agg(
        F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()}
    assert per == {i: (300, 0, 299) for i in range(10)}
    path = str(tmp_path / "shards")
    sharding.write_shards(found, path)
    assert {r["shard"]: r["count"] for r in spark.read.parquet(path).groupBy("shard").count().collect()} == {i: 300 for i in range(10)}


def test_shards_of_little(empty, spark):
    assert sharding.digest(empty, 16).count() == 0
    made = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert rows(sharding.sharded(made, F.lit(None).cast("int"), ["doc_id"], 4).select("shard", "slot")) == [(0, 0), (0, 1), (0, 2)]
    big = spark.createDataFrame([(1, "x"), (2, "y" * 1000), (3, "z")], "doc_id long, text string")
    assert rows(sharding.sharded(big, F.length("text"), ["doc_id"], 4).select("doc_id", "shard", "slot")) == [(1, 0, 0), (2, 2, 0), (3, 3, 0)]
    with pytest.raises(ValueError):
        sharding.sharded(made, F.lit(1), ["doc_id"], 0)


# --- filter audit ------------------------------------------------------------------


def plain_audit(table, marks, fails, copies="E"):
    """``table`` rows (id, text, part); ``marks`` sets of ids; ``fails`` letter -> test of a text."""
    first = {}
    for id, text, _ in table:
        if id is not None:
            first[text or ""] = min(id, first.get(text or "", id))
    letters = [*fails, copies]
    parts = {}
    for id, text, part in table:
        bad = {f for f, test in fails.items() if test(text or "")}
        if id is not None and first[text or ""] < id:
            bad.add(copies)
        parts.setdefault(part or "", []).append((id, bad))
    out = []
    for part, members in parts.items():
        mine = []
        for order in itertools.permutations(letters):
            left = members
            for step, f in enumerate(order, 1):
                gone, kept = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                failing = sum(f in m[1] for m in members)
                mine.append([part, "".join(order), step, len(kept), len(gone), failing - len(gone),
                             sum(m[1] == {f} for m in members), *[sum(m[0] in ids for m in gone) for ids in marks]])
                left = kept
        for row in mine:
            f = row[1][row[2] - 1]
            out.append((*row, sum(r[4] for r in mine if r[1][r[2] - 1] == f)))
    return sorted(out, key=repr)


FAILS = {
    "A": lambda t: len(re.findall(GAPS, t)) < 50,
    "B": lambda t: 100 * len(set(re.findall(GAPS, t))) < 65 * len(re.findall(GAPS, t)),
    "C": lambda t: 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
    "D": lambda t: re.search("[#$%&*|]", t) is not None,
}


def test_audit_query(spark, tmp_path, docs, folder):
    """Nulls, repeated rows, rows that share an id and copies over parts, through the query itself."""
    given_docs = [(r["doc_id"], r["text"], r["source"]) for r in docs.limit(60).collect()]
    long = " ".join(f"word{i}" for i in range(60))
    given_docs += [
        (9001, long, "x"), (9002, long, "y"), (9002, long, "y"), (9002, long + " #", "y"), (9003, long, None), (9003, long, ""),
        (None, long, "x"), (None, long, "x"), (None, None, None), (9004, None, "x"), (9005, "", "y"), (-1, "A B", "x"), (9006, "A B", "x"),
        (9001, long, "y"), (9001, long, "x"),
    ]
    labels = [(9001, 1, 0), (9002, 0, 1), (9002, 1, None), (9006, 1, 1), (None, 1, 1), (9004, None, 1), (123456789, 1, 1)]
    known = spark.read.parquet(os.path.join(folder, "labels.parquet")).select("doc_id", "quality", "toxic")
    labels += [tuple(r) for r in known.collect()]
    spark.createDataFrame(given_docs, "doc_id long, text string, source string").withColumn("words", F.lit(1)).withColumn(
        "mask", F.lit("m")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = QUERIES["op13_filter_interaction"](spark, str(tmp_path))
    marks = [{i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}]
    assert rows(found) == plain_audit(given_docs, marks, FAILS)


def test_audit_of_other_filters(odd, empty):
    conditions = {"x": F.length("text") > 100, "y": F.col("n") == "o"}
    found = interaction.audit(odd, conditions, {}, copies=None, part="starts")
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley"]
    assert found.count() == 2 * 2 * odd.select(F.coalesce("starts", F.lit(""))).distinct().count()
    # In every order the removals add up, and the fair shares do over all orders.
    per = found.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone"), F.min("kept").alias("kept"))
    size = odd.groupBy(F.coalesce("starts", F.lit("")).alias("part")).agg(F.count("*").alias("size"))
    assert per.join(size, "part").where("gone + kept != size").count() == 0
    assert interaction.audit(empty, conditions, {}, copies="E", part="starts").count() == 0
    with pytest.raises(ValueError):
        interaction.audit(odd, {"E": F.lit(True)}, {}, copies="E", part="n")


def test_lattice_counts_orders():
    edges = interaction.lattice(5)
    assert len(edges) == 80
    for bit in (1, 2, 4, 8, 16):
        assert sum(orders for _, b, orders in edges if b == bit) == math.factorial(5)
    taken = {}
    for order in itertools.permutations(range(5)):
        state = 0
        for i in order:
            taken[state, 1 << i] = taken.get((state, 1 << i), 0) + 1
            state |= 1 << i
    assert taken == {(s, b): orders for s, b, orders in edges}
