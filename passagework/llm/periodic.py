"""Periodic runs of words: seeds on diagonals, extended once each.

A run of smallest period q matches itself at lag q over its length less q. Lags are taken in
classes [low, k], where k is the overlap that every run of a lag of at least low is bound to
have. So a run has a k-gram at its start and again q words on, and, as k is no smaller than
q, not in between: the next occurrence of a k-gram in the same document is the only partner
that has to be looked at, however often the gram occurs. A pair of them is a seed on the
diagonal of its lag. A table of the furthest word covered for each lag suppresses seeds
within a stretch that was extended before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import sha
from passagework.llm.marks import merged
from passagework.operators.steps import settle

LEAST, TIMES = 6, 4
WORDS_AT_ONCE = 1 << 18
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def lag_classes(longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(low, k) of each class of lags that a text of ``longest`` words can have runs of."""
    if times < 3:
        raise ValueError("runs have to be repeated three times or more")
    out, low = [], 1
    while max(least, times * low) <= longest:
        k = min(max(least, times * q) - q for q in range(low, low + least + 1))
        out.append((low, k))
        low = k + 1
    return out


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that occur twice or more, by key and place, and a number for each such key."""
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=keys[order[:1]]) != 0
    group = np.cumsum(new)
    often = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    return order[often], group[often]


class Grams:
    """Numbers of the k-grams that occur twice or more in one document, exact, for growing k."""

    def __init__(self, words: np.ndarray):
        # Words are numbered per document, so no gram occurs in two documents.
        self.k, self.size = 1, len(words)
        self._keep(*_numbered(words))

    def _keep(self, at: np.ndarray, number: np.ndarray) -> None:
        self.at, self.number = at, number
        self.dense = np.full(self.size, -1, np.int64)
        self.dense[at] = number

    def grow(self, k: int) -> None:
        """Two overlapping grams make a longer one."""
        while self.k < k and len(self.at):
            step = min(self.k, k - self.k)
            left = np.sort(self.at)
            left = left[left < self.size - step]
            left = left[self.dense[left + step] >= 0]
            pairs = self.dense[left] * (self.size + 1) + self.dense[left + step]
            which, number = _numbered(pairs)
            self.k += step
            self._keep(left[which], number)

    def seeds(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(lags, places) of a gram and its next occurrence at such a lag, by lag and place.

        Of places in a row only the first is needed: the others lie on its stretch.
        """
        lag = np.diff(self.at)
        near = (np.diff(self.number) == 0) & (lag >= low) & (lag <= high)
        lag, at = lag[near], self.at[:-1][near]
        order = np.lexsort((at, lag))
        lag, at = lag[order], at[order]
        head = (np.diff(lag, prepend=0) != 0) | (np.diff(at, prepend=-2) != 1)
        return lag[head], at[head]


def _agree(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from places a < b on, forwards or backwards."""
    done, width, most = 0, 16, len(words) - b if step > 0 else a + 1
    while done < most:
        n = min(width, most - done)
        if step > 0:
            differ = words[a + done:a + done + n] != words[b + done:b + done + n]
        else:
            differ = (words[a - done - n + 1:a - done + 1] != words[b - done - n + 1:b - done + 1])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, width = done + n, width * 2
    return done


def runs_of(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    ``words`` numbers the words of one or more documents, equal only within a document.
    """
    found, grams = [], Grams(words)
    for low, k in lag_classes(longest, least, times):
        grams.grow(k)
        if not len(grams.at):
            break
        covered: dict[int, int] = {}
        for lag, at in zip(*(column.tolist() for column in grams.seeds(low, k))):
            if at < covered.get(lag, 0):
                continue
            end = at + k + _agree(words, at + k, at + k + lag, 1)
            start = at - _agree(words, at - 1, at - 1 + lag, -1)
            covered[lag] = end
            if end - start + lag >= max(least, times * lag):
                found.append((start, end - start + lag, lag))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _described(texts: list[str], least: int, times: int) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """(words, runs, text without the repetitions) of each text."""
    split = [text.encode("utf-8", "surrogatepass").split() for text in texts]
    numbers, base = [], 0
    for words in split:
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(word, base + len(own)) for word in words]
        base += len(own)
    sizes = [len(words) for words in split]
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found: list[list] = [[] for _ in texts]
    for start, length, period in runs_of(np.array(numbers, np.int64), max(sizes), least, times):
        doc = int(np.searchsorted(begins, start, "right")) - 1
        found[doc].append((start - int(begins[doc]), length, period))
    out = []
    for words, runs in zip(split, found):
        kept = words
        if runs:
            table = np.array(runs, np.int64)
            kept, done = [], 0
            for s, e in zip(*(side.tolist() for side in merged(table[:, 0] + table[:, 2], table[:, 0] + table[:, 1]))):
                kept += words[done:s]
                done = e
            kept += words[done:]
        out.append((len(words), runs, b" ".join(kept).decode("utf-8", "surrogatepass")))
    return out


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in blocks of bounded size; a text beyond it is a block of its own."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > 8 * WORDS_AT_ONCE:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Add ``n_words``, ``runs`` and ``collapsed`` in place of the text; one row per document.

    ``runs`` holds (start, length, period) of every stretch of words that has this smallest
    period, is at least ``least`` words and ``times`` periods long and can't be extended, by
    start and period; words are counted from 0. ``collapsed`` holds the words that no run has
    after its first period, joined by one space. Null and empty texts have no words and no
    runs. Rows are independent, so repeated rows and ties each keep their own result, a text
    of any length is judged whole, and an empty table gives an empty one. Other columns are
    kept as they are, whatever their names; those called like an added one are replaced.
    """
    added = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())
    ])
    kept = [f for f in docs.schema.fields if f.name not in (text, *added.fieldNames())]
    triple = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
    runs_kind = pa.list_(pa.field("element", triple, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in _blocks([value.as_py() or "" for value in batch.column(len(kept))]):
                rows += _described(block, least, times)
            offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int32)
            flat = np.array([one for r in rows for one in r[1]], np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(
                pa.array(offsets),
                pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], fields=list(triple)),
                type=runs_kind,
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array([r[0] for r in rows], pa.int64()), runs,
                 pa.array([r[2] for r in rows], pa.string())],
                names=[*(f.name for f in kept), *added.fieldNames()],
            )

    free = "_" * max(len(name) for name in docs.columns) + "text"
    sent = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias(free))
    return sent.mapInArrow(run, T.StructType([*kept, *added.fields]))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``with_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("minus")
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), F.array_join(lines, "").alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.minus")).alias("period"),
        F.expr("1000 * best.length div -best.minus").alias("exponent_milli"),
        sha(F.col("lines")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) where one document in ten, by its id's checksum, repeats a stretch to its end.

    A null id has no checksum and stays as it is.
    """
    checksum = F.crc32(F.col(id).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    own = docs.select(id, text, F.floor(checksum / 10).alias("g"), F.when(checksum % 10 == 0, words).alias("w"))
    own = settle(own, "w", F.col("w")).select("*", F.size("w").alias("n"))
    own = own.select("*", F.expr("cast(g % n as int)").alias("a"))
    own = own.select("*", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)").alias("p"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return own.select(id, F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col(text)).alias(text))
