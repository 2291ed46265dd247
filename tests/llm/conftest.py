import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with clashing column names, nulls, empty, very long, equal and repeated rows."""
    base = "the quick brown fox jumps over the lazy dog and then it runs away from all of the hounds "
    long = " ".join(f"w{i % 700}x{i * 7919 % 1009}" for i in range(9000))
    rows = [
        (1, base * 3 + long[:400], "a"), (2, base * 3 + long[:400], "b"), (2, base * 3 + long[:400], "b"),
        (3, None, None), (4, "", "x"), (None, base * 4, "n"), (None, None, None), (5, "one", "o"), (6, "one two", "o"),
        (7, long, "l"), (8, long[100:20000] + " " + base, "l"), (9, "a " * 3000, "t"), (10, "aaaa" * 800, "t"),
        (11, "É x \U0001F600 " * 120, "u"), (12, "PASSWORD = abcdefgh12 \U0001F600 token: short", "s"),
        (-3, base * 4, "m"),
    ]
    return spark.createDataFrame(
        [(i, t, s, s, s, s, s) for i, t, s in rows],
        "doc_id long, text string, _id string, _key string, n string, words string, starts string",
    )


@pytest.fixture
def empty(odd):
    return odd.where(F.lit(False))
