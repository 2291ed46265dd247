"""Answer-quality metrics as column expressions, one value per answer row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.text import (
    PUNCTUATION,
    is_blank,
    normalise,
    strip,
    word_set,
    words,
)

# Question words, weights and thresholds of the metrics.
QUESTION_WORDS = [
    "what", "when", "where", "who", "why", "how", "is", "are", "was", "were",
    "do", "does", "did",
]
CITATION_WEIGHT = 0.2
RELEVANCE_WEIGHT = 0.3
FACT_WEIGHT = 0.4
COMPLETENESS_WEIGHT = 0.1
FACT_PASS = 0.7
TOTAL_PASS = 0.6
COMPLETENESS_PASS = 0.6
DIVERSITY_RANGE = (0.3, 0.8)
CONTEXT_BLOCKS = 3
FUZZY_SHARE = 0.5


def citations(response: Column) -> Column:
    """The numbers written as ``[n]``, as text, in order."""
    return F.regexp_extract_all(response, F.lit(r"\[([0-9]+)\]"), F.lit(1))


def citation_ok(
    response: Column,
    require_citations: bool = True,
    strict: bool = False,
    passages: Column | None = None,
) -> Column:
    """Whether the citations are valid.

    By default only a citation of passage 0 is wrong. ``strict`` also asks for
    numbers without gaps and, when ``passages`` is given, none above it.
    """
    found = citations(response)
    ok = ~F.exists(found, lambda c: c.rlike("^0+$"))
    if strict:
        numbers = F.array_distinct(F.transform(found, lambda c: c.cast("decimal(38,0)")))
        ok = ok & (F.array_max(numbers) == F.size(numbers))
        if passages is not None:
            ok = ok & (F.array_max(numbers) <= passages)
    none_cited = F.size(found) == 0
    return F.coalesce(
        F.when(none_cited, F.lit(not require_citations)).otherwise(ok), F.lit(False)
    )


def context_used(response: Column, context: Column) -> Column:
    """Whether the answer repeats one of the first three context blocks."""
    blocks = F.slice(F.split(F.lower(context), "\n\n"), 1, CONTEXT_BLOCKS)
    used = F.exists(blocks, lambda block: F.contains(F.lower(response), block))
    return F.coalesce((context != "") & used, F.lit(False))


def word_jaccard(left: Column, right: Column) -> Column:
    """Shared words over all words of two texts; 0 when neither has any."""
    a, b = word_set(left), word_set(right)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(
        F.when(union == 0, F.lit(0.0))
    )


def query_diverse(question: Column, rewritten: Column) -> Column:
    """Whether a rewritten question differs enough, but not too much."""
    low, high = DIVERSITY_RANGE
    similarity = word_jaccard(question, rewritten)
    return F.coalesce(similarity.between(low, high), F.lit(True))


def facts_of_text(text: Column) -> Column:
    """Normalised sentences of a text."""
    sentences = F.filter(F.split(text, r"\."), lambda s: ~is_blank(s))
    return F.transform(sentences, normalise)


def facts_of_list(facts: Column) -> Column:
    """Normalised facts of a list, blank ones dropped."""
    return F.transform(F.filter(facts, lambda s: ~is_blank(s)), normalise)


def fact_words(facts: Column) -> Column:
    """The distinct words of each fact."""
    return F.transform(facts, lambda f: F.array_distinct(words(f)))


def matched_facts(predicted: Column, expected: Column) -> Column:
    """How many predicted word sets share half of the smaller set with an expected one."""
    return F.size(
        F.filter(
            predicted,
            lambda p: F.exists(
                expected,
                lambda e: F.size(F.array_intersect(p, e))
                >= F.least(F.size(p), F.size(e)) * FUZZY_SHARE,
            ),
        )
    )


def f1_of_counts(hits: Column, predicted: Column, expected: Column, cap: bool = False) -> Column:
    """F1 of matched, predicted and expected counts; 1 when nothing was expected or given."""
    precision, recall = hits / predicted, hits / expected
    score = 2 * (precision * recall) / (precision + recall)
    if cap:
        score = F.least(score, F.lit(1.0))
    return (
        F.when(expected == 0, (predicted == 0).cast("double"))
        .when((predicted == 0) | (hits == 0), F.lit(0.0))
        .otherwise(score)
    )


def keywords(question: Column) -> Column:
    """Content words of a question, edge punctuation removed after the tests."""
    stop = F.array(*[F.lit(w) for w in QUESTION_WORDS])
    kept = F.filter(
        words(F.lower(question)),
        lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2),
    )
    return F.transform(kept, lambda w: F.btrim(w, F.lit(PUNCTUATION)))


def share_named(terms: Column, answer: Column) -> Column:
    """Share of the keywords that occur in the lower-cased answer; 1 without keywords."""
    named = F.size(F.filter(terms, lambda t: F.contains(answer, t)))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(named / F.size(terms))


def weighted_total(citation: Column, relevance: Column, f1: Column, completeness: Column) -> Column:
    """Weighted sum; booleans count as 0 or 1."""
    return (
        citation.cast("double") * CITATION_WEIGHT
        + relevance.cast("double") * RELEVANCE_WEIGHT
        + f1 * FACT_WEIGHT
        + completeness.cast("double") * COMPLETENESS_WEIGHT
    )


_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = (
    rf"(?i)\A[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)\z"
)


def lenient_double(text: Column) -> Column:
    """A number written as text, or null when it is not one."""
    trimmed = strip(text)
    return F.when(
        trimmed.rlike(_NUMBER), F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double")
    )


def judge_overall(overall: Column, accuracy: Column, completeness: Column, reasoning: Column) -> Column:
    """Overall judge score in 0..1; 0 when any given score or the reasoning is unusable.

    A missing (null) accuracy or completeness counts as given and valid.
    """
    bad = (
        lenient_double(overall).isNull()
        | (accuracy.isNotNull() & lenient_double(accuracy).isNull())
        | (completeness.isNotNull() & lenient_double(completeness).isNull())
        | reasoning.isNull()
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lenient_double(overall)))
    return F.when(bad, F.lit(0.0)).otherwise(clamped)
