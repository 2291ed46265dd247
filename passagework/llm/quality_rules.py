"""Quality rules: a decision list learned by sequential covering.

Each round grows a conjunction of thresholds on two thirds of the labelled documents that
are still uncovered, adding the condition with the best information gain, and prunes it on
the last third, dropping final conditions while that makes it no worse. A rule that
rejects documents of the good class too often ends the list. The list becomes one ordered
conditional expression, so judging runs in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import save, without
from passagework.llm.textstats import labelled, measures, sampled, with_counts

MOST_LABELLED = 50_000
CUTS = 64
MOST_RULES = 24
MOST_CONDITIONS = 4
LEAST_PRECISION = 0.9
LEAST_CASES = 4


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = measures()[self.measure]
        return value >= self.cut if self.above else value < self.cut

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.cut if self.above else values < self.cut


Rule = tuple[Condition, ...]


def _covers(rule: Rule, data: dict[str, np.ndarray]) -> np.ndarray:
    mask = np.ones(len(next(iter(data.values()))), bool)
    for c in rule:
        mask &= c.holds(data[c.measure])
    return mask


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Add the condition of the greatest gain until no good document is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for name in sorted(data):
            values = data[name][inside]
            order = np.sort(values[bad[inside]]), np.sort(values[~bad[inside]])
            for above in (True, False):
                at = [np.searchsorted(o, cuts[name], "left") for o in order]
                p1, n1 = ((p - at[0], n - at[1]) if above else at)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - before), -1)
                top = int(np.argmax(gain))
                if gain[top] > best[0]:
                    best = (gain[top], Condition(name, above, float(cuts[name][top])))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(data[best[1].measure])
    return rule


def _worth(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray) -> float:
    inside = _covers(rule, data)
    p, n = bad[inside].sum(), (~bad[inside]).sum()
    return float((p - n) / (p + n)) if p + n else -1.0


def learn(sample, label: str = "_label") -> list[Rule]:
    """Ordered rules, each a conjunction that marks documents of label 0.

    ``sample`` is a pandas table of the measures and the label. Without documents of both
    labels there are no rules.
    """
    data = {name: sample[name].to_numpy(float) for name in measures()}
    bad = sample[label].to_numpy() == 0
    if not len(bad) or bad.all() or not bad.any():
        return []
    cuts = {
        name: np.unique(np.concatenate([
            np.quantile(v, np.linspace(0, 1, CUTS)), np.quantile(v[bad], np.linspace(0, 1, CUTS)),
        ]))
        for name, v in data.items()
    }
    third = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    part = lambda mask: ({k: v[mask] for k, v in data.items()}, bad[mask])
    while len(rules) < MOST_RULES and (bad & left).any():
        rule = _grow(*part(left & ~third), cuts)
        if not rule:
            break
        held = part(left & third)
        while len(rule) > 1 and _worth(rule[:-1], *held) >= _worth(rule, *held):
            rule = rule[:-1]
        covered = _covers(rule, data) & left
        p, n = int((bad & covered).sum()), int((~bad & covered).sum())
        if p < LEAST_CASES or p / (p + n) < LEAST_PRECISION or _worth(rule, *held) < 2 * LEAST_PRECISION - 1:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that marks a document, counted from 1; null if none does."""
    found = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        condition = F.lit(True)
        for c in rule:
            condition = condition & c.column()
        found = F.when(condition, F.lit(number)).otherwise(found)
    return found


def judged(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """One row per document: (_id, _key, the counts, base_failed, rule, kept).

    The base rule rejects texts of under 50 words or of which over half the words repeat
    in three-word windows; ``rule`` is the learned rule that marks the document, if any.
    The list is learned from at most ``most_labelled`` labelled documents; everything else
    looks at all rows.

    Null and empty texts have no words and are rejected by the base rule. Rows are judged
    one by one, so repeated rows are judged alike and null ids are judged too; labels
    without id or label are ignored; without labels, or with an empty table, only the base
    rule holds. Other columns are not looked at.
    """
    counts = save(with_counts(docs, id, text), "counts")
    rules = learn(sampled(labelled(counts, labels, label, id), most_labelled))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that the rules keep, with their columns as they are."""
    return without(docs, judged(docs, labels, id, text, **options).where("not kept"), id, text)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``judged``."""
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )
