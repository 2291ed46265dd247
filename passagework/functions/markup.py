"""Cleaning rules of marked-up encyclopedia text as column expressions.

The rules are native except for entity decoding, for which neither Spark nor SQL
has the HTML5 table; only texts that contain an ampersand cross to Python.
"""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.slices import per_text
from passagework.functions.text import SPACE_CLASS

# The markup rules, in the order they apply.
TAG = r"<[^>]+>"
TEMPLATE = r"\{\{[^}]*\}\}"
LINK_WITH_LABEL = r"\[\[([^|\]]+)\|([^\]]+)\]\]"
LINK = r"\[\[([^\]]+)\]\]"
URL_WITH_LABEL = (
    r"\[https?://[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}\]]+" + SPACE_CLASS + r"+([^\]]+)\]"
)
URL = r"\[https?://[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}\]]+\]"
REFERENCE = r"(?is)<ref[^>]*>.*?</ref>"
REFERENCE_TAG = r"(?i)<ref[^>]*/?>"
FILE_LINK = r"(?i)\[\[File:[^\]]+\]\]"
IMAGE_LINK = r"(?i)\[\[Image:[^\]]+\]\]"
CATEGORY_LINK = r"(?i)\[\[Category:[^\]]+\]\]"
TABLE = r"(?s)\{\|.*?\|\}"
HEADING = rf"={{2,}}{SPACE_CLASS}*([^=]+){SPACE_CLASS}*={{2,}}"
EMPHASIS = r"'{2,5}([^']+)'{2,5}"
EMPTY_BRACKETS = rf"\[{SPACE_CLASS}*\]"
EMPTY_PARENTHESES = rf"\({SPACE_CLASS}*\)"
BLANK_RUN = r"[ \t](?:[ \t]+|(?<=\t))"  # every run of blanks that is not already one space
NON_PRINTABLE = r"[\p{C}\p{Z}&&[^\n\t ]]"
MIN_LINE_CHARS = 3
MIN_TEXT_CHARS = 100

# Every rule up to EMPTY_PARENTHESES matches one of these, and none writes one.
MARKS = r"[\[{<('=]"

_MARK_RULES = [
    (TEMPLATE, ""),
    (LINK_WITH_LABEL, "$2"),
    (LINK, "$1"),
    (URL_WITH_LABEL, "$1"),
    (URL, ""),
    (REFERENCE, ""),
    (REFERENCE_TAG, ""),
    (FILE_LINK, ""),
    (IMAGE_LINK, ""),
    (CATEGORY_LINK, ""),
    (TABLE, ""),
    (HEADING, "$1"),
    (EMPHASIS, "$1"),
    (EMPTY_BRACKETS, ""),
    (EMPTY_PARENTHESES, ""),
]
_BLANK_RULES = [(BLANK_RUN, " "), (NON_PRINTABLE, "")]


def drop_tags(text: Column) -> Column:
    """Remove everything between angle brackets."""
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, TAG, "")).otherwise(text)


def decode_entities(text: Column) -> Column:
    """HTML entities decoded in one pass; null for text without ``&``, which stays in the JVM."""
    return per_text(html.unescape, T.StringType())(F.when(F.contains(text, F.lit("&")), text))


def keep_long_lines(text: Column, min_chars: int = MIN_LINE_CHARS) -> Column:
    """Trim every line and keep those longer than ``min_chars`` characters."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(line))
    return F.array_join(F.filter(lines, lambda line: F.length(line) > min_chars), "\n")


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def drop_markup(text: Column) -> Column:
    """Remove the markup left after tags and entities, then short lines; null gives "".

    Blank-line collapsing is left out: the line filter removes every blank line,
    so it cannot change the result.
    """
    bare = _replaced(text, _MARK_RULES)
    # Most texts of a cleaned corpus hold no mark and are read once instead of by every rule.
    text = _replaced(F.when(F.rlike(text, F.lit(MARKS)), bare).otherwise(text), _BLANK_RULES)
    return F.coalesce(keep_long_lines(text), F.lit(""))
