"""Quality classifier: Bradley-Terry scores from preference pairs.

A document of label 1 is preferred to one of label 0. The probability of a preference is
the logistic function of the difference of two scores; a score is the sum of one weight
per measure, chosen by the interval that the measure falls in. The weights minimise the
logistic loss over pairs. The threshold is a quantile of the scores of all documents that
may be learned from: the share of label 0 among them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import save
from passagework.llm.textstats import labelled, measures, sampled, with_counts

MOST_LABELLED = 50_000
PAIRS = 60_000
# Of the percentile sketch: exact up to this number of rows.
ACCURACY = 100_000
INTERVALS = 16
STEPS = 300
PENALTY = 1e-4
THRESHOLD = 0.3


@dataclass(frozen=True)
class Ranking:
    """Cuts and weights by measure; scores at ``middle`` become ``THRESHOLD``."""

    cuts: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]
    middle: float = 0.0
    scale: float = 1.0

    def total(self, values: dict[str, Column]) -> Column:
        """The sum of the weights of a document's measures."""
        total = F.lit(0.0)
        for name, value in values.items():
            if name not in self.cuts:
                continue
            weight = F.lit(float(self.weights[name][-1]))
            for cut, w in reversed(list(zip(self.cuts[name], self.weights[name]))):
                weight = F.when(value < float(cut), F.lit(float(w))).otherwise(weight)
            total = total + weight
        return total

    def placed(self, rows: DataFrame) -> Ranking:
        """With middle and scale by the scores of all rows of ``labelled``.

        The middle lies between the quantile and the next higher score, as an interpolated
        quantile does, so that a gap between the two labels is split and not cut at its end.
        """
        if not self.cuts:
            return self
        totals = save(rows.select("_label", self.total({name: F.col(name) for name in measures()}).alias("total")), "totals")
        n, bad, spread = totals.agg(F.count("*"), F.count_if(F.col("_label") == 0), F.stddev_pop("total")).first()
        # Half a row less, so that rounding never takes the next one.
        low = totals.agg(F.percentile_approx("total", (bad - 0.5) / n, ACCURACY)).first()[0]
        below, high = totals.agg(
            F.count_if(F.col("total") <= low), F.min(F.when(F.col("total") > low, F.col("total")))
        ).first()
        middle = low if high is None or below > bad else low + (1 - bad / n) * (high - low)
        return replace(self, middle=middle, scale=2.0 / max(spread, 1e-9))

    def score(self) -> Column:
        """The score between 0 and 1, an expression over the counts."""
        shift = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return 1 / (1 + F.exp(-((self.total(measures()) - self.middle) * self.scale + shift)))


def fit(sample, label: str = "_label", pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Cuts and weights from a pandas table of measures and labels; none without both labels.

    Pairs are drawn at random, at least ``pairs`` of them and so many that each row of the table
    is in one.
    """
    good = np.flatnonzero(sample[label].to_numpy() == 1)
    bad = np.flatnonzero(sample[label].to_numpy() == 0)
    if not len(good) or not len(bad):
        return Ranking({}, {})
    cuts, columns, names = {}, [], []
    for name in measures():
        values = sample[name].to_numpy(float)
        ends = np.concatenate([np.quantile(values[x], np.linspace(0, 1, INTERVALS + 1)[1:-1]) for x in (good, bad)])
        # Halfway between neighbouring values, so a cut doesn't sit on a common value.
        known = np.unique(values)
        at = np.clip(np.searchsorted(known, np.unique(ends)), 1, max(1, len(known) - 1))
        cuts[name] = np.unique((known[at - 1] + known[np.minimum(at, len(known) - 1)]) / 2)
        inside = np.searchsorted(cuts[name], values, "right")
        columns.append(np.eye(len(cuts[name]) + 1)[inside])
        names.append(name)
    table = np.hstack(columns)
    random = np.random.default_rng(seed)
    pairs = max(pairs, len(good), len(bad))
    left, right = (random.permutation(np.resize(random.permutation(rows), pairs)) for rows in (good, bad))
    weights, moment, rate = np.zeros(table.shape[1]), np.zeros(table.shape[1]), 0.5
    speed = np.zeros(table.shape[1])
    count = lambda rows, p: np.bincount(rows, p, len(table))
    for step in range(1, STEPS + 1):
        scores = table @ weights
        wrong = 1 / (1 + np.exp(scores[left] - scores[right]))
        slope = -table.T @ (count(left, wrong) - count(right, wrong)) / pairs + PENALTY * weights
        moment = 0.9 * moment + 0.1 * slope
        speed = 0.99 * speed + 0.01 * slope**2
        weights -= rate * 0.2 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
    ends = np.cumsum([c.shape[1] for c in columns])[:-1]
    return Ranking(cuts, dict(zip(names, np.split(weights, ends))))


def held_out(id: Column) -> Column:
    """Documents whose labels are never learned from; a null id has no label and counts as not held out."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def scored(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    most_labelled: int = MOST_LABELLED, pairs: int = PAIRS,
) -> DataFrame:
    """One row per document: (_id, held_out, score, predicted).

    Weights are learned from at most ``most_labelled`` labelled documents that are not held
    out, in ``pairs`` or more preference pairs that leave none of them out; the threshold is a
    quantile of the scores of all of these documents. Only the text is an input of the score. Null and empty texts are scored like texts without
    words; repeated rows score alike; labels without id or label are ignored; without
    labels of both kinds every score equals the threshold. Other columns are not looked at.
    """
    counts = save(with_counts(docs, id, text), "counts")
    rows = labelled(counts, labels.where(~held_out(F.col(id))), label, id)
    ranking = fit(sampled(rows, most_labelled), pairs=pairs).placed(rows)
    return counts.select("_id", held_out(F.col("_id")).alias("held_out"), ranking.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``scored``."""
    return found.select(F.col("_id").alias("doc_id"), "held_out", "score", "predicted")
