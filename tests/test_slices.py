"""Python functions see a bounded slice of a batch at a time."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions import slices
from passagework.operators.vectors import embed

import numpy as np


def test_slices_keep_every_text_in_order(monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 3)
    monkeypatch.setattr(slices, "SLICE_BYTES", 10)
    texts = ["abcd", None, "abcd", "x", "y" * 30, "", None, "ä" * 4, "abc", "z"]
    parts = [part.to_pylist() for part in slices.text_slices(pa.array(texts, pa.string()))]
    assert [t for part in parts for t in part] == texts
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10) for p in parts)
    assert list(slices.text_slices(pa.array([], pa.string()))) == []


def test_a_function_gets_slices_and_nulls_stay_null(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("t")).coalesce(1)
    seen = slices.sliced(lambda texts: pa.array([len(texts)] * len(texts), pa.int32()), T.IntegerType())
    assert rows.select(F.max(seen("t"))).first()[0] <= slices.SLICE_ROWS
    doubled = slices.per_text(lambda t: t + t, T.StringType())
    wrong = rows.withColumn("d", doubled("t")).filter(~F.col("d").eqNullSafe(F.concat("t", "t")))
    assert wrong.count() == 0


def test_a_model_gets_slices(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("t")).coalesce(1)
    vectors = embed(rows, F.col("t"), lambda texts: np.array([[len(texts), float(t)] for t in texts]))
    found = vectors.selectExpr("max(vector[0]) AS n", "sum(int(vector[1] != float(t))) AS wrong").first()
    assert found["n"] <= slices.SLICE_ROWS and found["wrong"] == 0


def test_slots_of_words_are_kept_between_slices(monkeypatch):
    from passagework.functions import embedding

    calls, number = [], embedding._word_number
    monkeypatch.setattr(embedding, "_word_number", lambda word: calls.append(word) or number(word))
    model = embedding.hashed_words(16)
    first = model(["a b", "b c"])
    assert (model(["a b", "b c"]) == first).all() and sorted(calls) == ["a", "b", "c"]
    monkeypatch.setattr(embedding, "MOST_WORDS", 1)
    assert (model(["a b", "b c"]) == first).all() and len(calls) == 6
