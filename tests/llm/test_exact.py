"""The operators with exact results against brute force, on odd rows and on a small table."""

import os

import brute
import pytest
from pyspark.sql import functions as F

from passagework.llm import decontaminate, neardup, substrings, windows


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(os.path.join(folder, "documents.parquet"))


@pytest.fixture(scope="module")
def items(spark, folder):
    table = spark.read.parquet(os.path.join(folder, "benchmark.parquet")).select("item_id", "text")
    extra = [(901, "quick brown fox"), (902, "one"), (903, "one two"), (904, ""), (905, None), (None, "lazy dog and"), (901, "Quick, brown FOX")]
    return table.unionByName(spark.createDataFrame(extra, "item_id long, text string"))


@pytest.mark.parametrize("sent", [10**6, 0])
def test_contamination(docs, odd, items, sent):
    for table in (docs, odd):
        found = decontaminate.digest(decontaminate.contamination(table, items, sent_rows=sent))
        assert rows(found) == sorted(brute.contamination(plain(table), [tuple(r) for r in items.collect()]), key=repr)


def test_clean_documents_stay(odd, items, empty):
    found = decontaminate.contamination(odd, items)
    dirty = found.where("contaminated").count()
    left = decontaminate.decontaminate(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - dirty > 0
    assert decontaminate.contamination(empty, items).count() == 0
    none = decontaminate.contamination(odd, items.where(F.lit(False)))
    assert none.count() == odd.count() and none.where("n_hit > 0 or contaminated").count() == 0


@pytest.mark.parametrize("few", [12, 2])
def test_near_duplicates(docs, odd, few, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", few)
    for table in (docs, odd):
        found = neardup.near_duplicates(table)
        assert rows(found.select("_id", "n_shingles", "component_id")) == sorted(brute.near(plain(table)), key=repr)
        assert found.where("kept != (_id <=> component_id)").count() == 0


def test_a_repeated_id_joins_its_texts(spark):
    a, b = [" ".join(f"{c}{i}" for i in range(80)) for c in "ab"]
    made = [(1, a + " x"), (5, a), (5, b), (7, b + " y"), (9, "alone"), (9, ""), (9, None), (None, "p q r s"), (None, "t u v w")]
    found = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"))
    assert rows(found.select("_id", "n_shingles", "component_id")) == sorted(brute.near(made), key=repr)
    assert {(r["component_id"], r["kept"]) for r in found.where("_id in (5, 7)").collect()} == {(1, False)}


def test_a_large_group_between_thresholds(spark, monkeypatch):
    """Copies of a text with changes, around the similarity of a link, in buckets that have leaders only."""
    import random

    monkeypatch.setattr(neardup, "FEW", 3)
    random.seed(3)
    base = [f"w{i}" for i in range(150)]
    made = []
    for i in range(120):
        words = list(base)
        for at in random.sample(range(150), random.choice([1, 2, 3, 4, 5, 6, 8])):
            words[at] = f"x{random.randrange(40)}"
        made.append((i * 3, " ".join(words)))
    found = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"))
    wanted = sorted(brute.near(made), key=repr)
    assert len({w[2] for w in wanted}) > 3
    assert rows(found.select("_id", "n_shingles", "component_id")) == wanted


def test_windows(docs, odd, empty):
    for table, sizes in ((docs, {}), (odd, {}), (docs, {"chunk": 500, "bucket_bytes": 20000}), (odd, {"chunk": 50, "bucket_bytes": 9000})):
        found = windows.digest(windows.without_repeats(table, **sizes))
        assert rows(found) == sorted(brute.windows(plain(table)), key=repr)
    assert windows.without_repeats(empty).count() == 0


def test_substrings(docs, odd, empty):
    for table, sizes in ((docs, {}), (odd, {}), (docs, {"most_contexts": 0}), (odd, {"most_contexts": 1})):
        found = substrings.digest(substrings.without_repeats(table, **sizes))
        assert rows(found) == sorted(brute.substrings(plain(table)), key=repr)
    assert substrings.without_repeats(empty).count() == 0


def test_substrings_with_many_partial_matches(spark):
    """Matches whose left and right extensions come from different partners."""
    import random

    random.seed(5)
    letters = "abcdefgh "
    core = "".join(random.choice(letters) for _ in range(120))
    lefts = ["".join(random.choice(letters) for _ in range(120)) for _ in range(4)]
    rights = ["".join(random.choice(letters) for _ in range(120)) for _ in range(4)]
    made = []
    for i in range(60):
        a, b = random.randrange(10, 110), random.randrange(10, 110)
        noise = "".join(random.choice(letters) for _ in range(60))
        made.append((i, noise + random.choice(lefts)[-a:] + core + random.choice(rights)[:b] + noise[::-1]))
    table = spark.createDataFrame(made, "doc_id long, text string")
    for most in (10**6, 3):
        found = substrings.digest(substrings.without_repeats(table, most_contexts=most))
        assert rows(found) == sorted(brute.substrings(made), key=repr)
