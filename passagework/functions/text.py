"""Text expressions shared by the operators.

Everything here is a native column expression. Whitespace means Unicode
whitespace, spelled as an explicit class because the JVM's ``\\s`` is ASCII only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
PUNCTUATION = string.punctuation


def strip(text: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty or whitespace-only text."""
    return text.isNull() | ~text.rlike(r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]")


def non_empty(text: Column) -> Column:
    """The text, or null when it is empty."""
    return F.when(text != "", text)


def words(text: Column) -> Column:
    """Whitespace-separated words, in order, with repeats."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    """Distinct words of the lower-cased text."""
    return F.array_distinct(words(F.lower(text)))


def normalise(text: Column) -> Column:
    """Lower-case, delete ASCII punctuation, squeeze whitespace to single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    # Matches only the whitespace that is not already a single space, and tests a character once.
    return F.trim(F.regexp_replace(bare, f"{SPACE_CLASS}(?:{SPACE_CLASS}+|(?<! ))", " "))
