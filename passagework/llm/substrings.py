"""Substring dedup over bytes with a sparse, enhanced suffix array.

Sorting the suffix of every byte would move hundreds of times the text. A sparse array is
enough: of the ``GRAM``-byte grams inside every stretch of ``LENGTH`` bytes the one with
the smallest hash is an anchor, so a stretch that occurs twice has its anchor at the same
place in both, and only suffixes that start at anchors with a repeated gram are sorted.

Anchors are counted by gram and by context (everything that a stretch around them can
hold). Equal contexts are settled by counting. The different contexts of a gram, one of
each, are sorted by what follows the anchor; a scan over the longest common prefixes of
neighbours with a stack runs through the tree of prefix intervals from the leaves up, and
within every interval keeps the members in the order of what stands before the anchor.
There the longest common left extension of a member is that with a neighbour, so each
interval gives every member's longest match with any other member, not just with its
neighbours in the array. A match of ``LENGTH`` bytes or more is a repeat.

A gram with more different contexts than one task should hold is not scanned: its members'
stretches are hashed and counted instead, which gives the same result in more rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import save
from passagework.llm.marks import apply_marks, beside, merged, own_columns, per_document
from passagework.llm.rolling import Rolling, lowest, mixed

LENGTH = 200
GRAM = 48
# Different contexts of one gram that a task sorts (about 35 MB of bytes).
MOST_CONTEXTS = 100_000
OUT_ROWS = 20_000


class _Bytes:
    """Hashes of one text's bytes."""

    def __init__(self):
        random = np.random.default_rng(11)
        self.letters = random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.grams, self.whole, self.other = Rolling(0), Rolling(1), Rolling(0)

    def anchors(self, data: bytes, length: int, gram: int):
        """(at, gram hash, context hash) of the anchors of a text."""
        values = self.letters[np.frombuffer(data, np.uint8)]
        hashes = self.grams.windows(values, gram)
        width = length - gram + 1
        at = lowest(hashes, width)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        start, end = np.maximum(0, at - (width - 1)), np.minimum(len(data), at + length)
        context = self.whole.between(self.whole.sums(mixed(values)), start, end)
        place = (at - start).astype(np.uint64) << np.uint64(32) | (end - at).astype(np.uint64)
        return at, hashes[at].view(np.int64), mixed(context ^ mixed(place)).view(np.int64)


def common_prefix(a: bytes, b: bytes) -> int:
    """How many bytes two strings share at the start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8 if differ else n


def scan(after: list[bytes], before: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Longest matches of every member of a gram, as (bytes before, bytes after the anchor).

    ``after`` are suffixes in sorted order, ``before`` what precedes them, backwards. Every
    pair of members that shares ``length`` bytes around the anchor is covered: for each of
    its two members some match reported spans at least what the pair shares.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in after]
    best = [-1] * len(after)
    order = sorted(range(len(before)), key=before.__getitem__)
    rank = [0] * len(order)
    for r, i in enumerate(order):
        rank[i] = r

    def extend(i: int, j: int, prefix: int) -> None:
        shared = common_prefix(before[i], before[j])
        for x in (i, j):
            if shared > best[x]:
                best[x] = shared
                if shared + prefix >= length:
                    found[x].append((shared, prefix))

    def joined(one: list[int], other: list[int], prefix: int) -> list[int]:
        if len(one) < len(other):
            one, other = other, one
        for r in other:
            place = bisect_left(one, r)
            if place:
                extend(order[one[place - 1]], order[r], prefix)
            if place < len(one):
                extend(order[r], order[one[place]], prefix)
            insort(one, r)
        return one

    # Intervals of the array, members by rank, and the common prefix between each and the next.
    stack: list[list[int]] = []
    borders: list[int] = []
    for i in range(len(after)):
        if i:
            prefix = common_prefix(after[i - 1], after[i])
            while borders and borders[-1] > prefix:
                top = stack.pop()
                stack[-1] = joined(stack[-1], top, borders.pop())
            borders.append(prefix)
        stack.append([rank[i]])
    while borders:
        top = stack.pop()
        stack[-1] = joined(stack[-1], top, borders.pop())
    return found


def _anchors(own: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Bytes()
        for batch in batches:
            row, at, grams, contexts = [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                data = text.as_py().encode("utf-8", "surrogatepass")
                if len(data) >= length:
                    a, g, c = table.anchors(data, length, gram)
                    row.append(np.full(len(a), i))
                    at.append(a)
                    grams.append(g)
                    contexts.append(c)
            if not row:
                continue
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(take), batch.column("_key").take(take), pa.array(np.concatenate(at).astype(np.int32)),
                 pa.array(np.concatenate(grams)), pa.array(np.concatenate(contexts))],
                names=["_id", "_key", "at", "gram", "context"],
            )

    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(run, f"_id {kind}, _key long, at int, gram long, context long")


def _contexts(own: DataFrame, members: DataFrame, length: int, width: int) -> DataFrame:
    """The bytes around each member (_id, _key, at, gram): (gram, after, before, _id, _key, at)."""
    by_text = save(members.groupBy("_id", "_key").agg(F.collect_list(F.struct("gram", "at")).alias("places")), "places")
    texts = beside(own, by_text, None, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            row, *columns = (list(c) for c in zip(*rows))
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int32())
            gram, after, before, at = (pa.array(c, t) for c, t in zip(columns, types))
            take = pa.array(row, pa.int32())
            return pa.RecordBatch.from_arrays(
                [gram, after, before, batch.column("_id").take(take), batch.column("_key").take(take), at],
                names=["gram", "after", "before", "_id", "_key", "at"],
            )

        for batch in batches:
            rows = []
            for i, (text, places) in enumerate(zip(batch.column("_text"), batch.column("places"))):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for place in places.as_py():
                    p = place["at"]
                    rows.append((i, place["gram"], data[p:p + length], data[max(0, p - (width - 1)):p][::-1], p))
                if len(rows) >= OUT_ROWS:
                    yield packed(batch, rows)
                    rows = []
            if rows:
                yield packed(batch, rows)

    kind = own.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"gram long, after binary, before binary, _id {kind}, _key long, at int")


def _scanned(contexts: DataFrame, length: int) -> DataFrame:
    """(_id, _key, starts, ends) of the repeats that the scan of every gram's members finds."""
    kind = contexts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rows = None, []

        def settled() -> list[tuple]:
            out = []
            matches = scan([r[1] for r in rows], [r[2] for r in rows], length)
            for (_, _, _, id, key, at), spans in zip(rows, matches):
                if spans:
                    out.append((id, key, [at - a for a, _ in spans], [at + b for _, b in spans]))
            return out

        def batch_of(found: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 4
            types = [like.schema.field("_id").type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=["_id", "_key", "starts", "ends"]
            )

        last = None
        for batch in batches:
            found, last = [], batch
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "after", "before", "_id", "_key", "at"))):
                if row[0] != gram:
                    found += settled()
                    gram, rows = row[0], []
                rows.append(row)
            yield batch_of(found, batch)
        if last is not None:
            yield batch_of(settled(), last)

    array = contexts.repartition("gram").sortWithinPartitions("gram", "after")
    return array.mapInArrow(run, f"_id {kind}, _key long, starts array<int>, ends array<int>")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same as ``_scanned`` by hashing and counting every stretch around the members."""
    kind = contexts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Bytes()
        for batch in batches:
            row, start, one, two = [], [], [], []
            for i, (after, before, at) in enumerate(zip(*(batch.column(c) for c in ("after", "before", "at")))):
                left = before.as_py()[::-1]
                values = table.letters[np.frombuffer(left + after.as_py(), np.uint8)]
                hashes = table.grams.windows(values, length)
                row.append(np.full(len(hashes), i))
                start.append(np.arange(len(hashes)) + at.as_py() - len(left))
                one.append(hashes.view(np.int64))
                two.append(table.whole.windows(mixed(values), length).view(np.int64))
            take = pa.array(np.concatenate([*row, np.zeros(0, np.int64)]).astype(np.int64))
            flat = lambda parts, t: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(take), batch.column("_key").take(take), batch.column("gram").take(take),
                 flat(start, np.int32), flat(one, np.int64), flat(two, np.int64)],
                names=["_id", "_key", "gram", "start", "one", "two"],
            )

    stretches = save(contexts.mapInArrow(run, f"_id {kind}, _key long, gram long, start int, one long, two long"), "stretches")
    # A stretch that lies around two members of one text counts once.
    place = F.struct("_id", "_key", "start")
    often = stretches.groupBy("gram", "one", "two").agg(F.min(place).alias("low"), F.max(place).alias("high")).where(
        "not (low <=> high)"
    ).drop("low", "high")
    return stretches.join(often, ["gram", "one", "two"]).select(
        "_id", "_key", F.array("start").alias("starts"), F.array(F.col("start") + length).alias("ends")
    )


def repeats(
    own: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS
) -> DataFrame:
    """(_id, _key, starts, ends): the bytes that repeated stretches cover, in any number of rows per document."""
    width = length - gram + 1
    anchors = save(_anchors(own, length, gram), "anchors")
    grams = anchors.groupBy("gram").agg(
        F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")
    ).where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed"))
    live = save(anchors.join(grams, "gram"), "live")

    by_context = live.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("_id", "_key", "at")).alias("one"), F.first("mixed").alias("mixed")
    )
    by_context = save(by_context, "contexts")
    copies = by_context.where("n > 1").select("gram", "context")
    settled = live.join(copies, ["gram", "context"]).select(
        "_id", "_key",
        F.array(F.greatest(F.lit(0), F.col("at") - (width - 1))).alias("starts"),
        F.array(F.col("at") + length).alias("ends"),
    )
    members = by_context.where("mixed").select("gram", "one.*")
    crowded = save(
        members.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > most_contexts).select("gram"), "crowded"
    )
    contexts = save(_contexts(own, members, length, width), "context_bytes")
    few = contexts.join(crowded, "gram", "left_anti")
    many = contexts.join(crowded, "gram", "left_semi")
    return settled.unionByName(_scanned(few, length)).unionByName(_counted(many, length))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """One row per document: (_id, n_bytes, n_removed, n_spans, kept).

    ``kept`` are the bytes that no string of ``length`` bytes covers which also starts
    anywhere else, in another document or in the same one; occurrences may overlap, and
    all of them are removed. Texts are UTF-8 bytes; matches never cross documents. Null
    and empty texts have no bytes; texts shorter than ``length`` lose nothing. Rows that
    repeat a document are copies of each other and lose their common strings, whatever
    their ids; a null id is an id like others. An empty table gives an empty result;
    other columns are not looked at.
    """
    own = own_columns(docs, id, text)

    def cut(value: str, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
        data = value.encode("utf-8", "surrogatepass")
        starts, ends = merged(starts, np.minimum(ends, len(data)))
        kept, done = [], 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            kept.append(data[done:s])
            done = e
        kept.append(data[done:])
        rest = b"".join(kept)
        return len(data), len(data) - len(rest), len(starts), rest

    fields = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")]
    return apply_marks(own, per_document(repeats(own, length, **options)), cut, fields, own.schema["_id"].dataType)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``without_repeats``."""
    return found.select(
        F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
