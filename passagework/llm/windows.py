"""Substring dedup over fixed-length word windows.

Every window of ``length`` words gets a Rabin-Karp hash. Hashes are dealt into buckets by
a second hash and counted there: a window that also starts in a document with a smaller id
is a repeat. Tasks first settle the repeats among their own documents, so a window that a
third of all documents hold leaves each task once, then send what is left packed by
bucket. What a bucket finds goes back packed by block of documents, where repeated windows
merge into maximal removal intervals.

The 64-bit hash and the bucket of the second hash must both agree. The number of buckets
grows with the text, and so does the width of the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import sha
from passagework.llm.marks import apply_marks, ints, merged, own_columns
from passagework.llm.rolling import Rolling, WordHashes

LENGTH = 50
BUCKET_BYTES = 8 << 20
CHUNK_WINDOWS = 1 << 19
_PACKED = "ids array<{0}>, keys array<long>, counts array<int>, hashes binary, at binary"


def _ranks(ids: list) -> np.ndarray:
    """Positions of ids in their order, equal for equal ids; null comes last."""
    order = {v: i for i, v in enumerate(sorted({v for v in ids if v is not None}))}
    return np.array([len(order) if v is None else order[v] for v in ids], np.int64)


def _place(id, key: int, places: int) -> int:
    """Where a document's repeats are gathered; copies of a text go to different places."""
    return xxhash.xxh3_64_intdigest(f"{id!r} {key}") % places


def _later(hashes: np.ndarray, doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows also start in a document of a smaller rank."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    grouped = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]]))
    low = np.minimum.reduceat(rank[doc[order]], first)
    later = np.zeros(len(hashes), bool)
    later[order] = rank[doc[order]] > np.repeat(low, np.diff(np.append(first, len(grouped))))
    return later


def _runs(doc: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(document, starts, ends): runs of window starts by document; sorted by both."""
    out = []
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        out.append((int(doc[a]), *merged(at[a:b], at[a:b] + 1)))
    return out


def _rows(kind: pa.Schema, bucket: list[int], found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"bucket": b, **row} for b, row in zip(bucket, found)], schema=kind)


def repeated(own: DataFrame, length: int = LENGTH, chunk: int = CHUNK_WINDOWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(_id, _key, starts, ends): runs of starts of repeated windows, one row per document that has any."""
    # The one figure that sizes the buckets; it reads the texts' lengths.
    size = own.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    buckets = max(1, -(-int(size) // bucket_bytes))
    id_kind = own.schema["_id"].dataType.simpleString()
    id_arrow = _arrow(own)
    packed = pa.schema([
        ("bucket", pa.int64()), ("ids", pa.list_(id_arrow)), ("keys", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())), ("hashes", pa.binary()), ("at", pa.binary()),
    ])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, roll, deal = WordHashes(), Rolling(0), Rolling(1)
        ids, keys, hashes, dealt, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(h) for h in hashes], np.int64)
            doc = np.repeat(np.arange(len(ids)), counts)
            at = np.concatenate([np.arange(c) for c in counts])
            every, to = np.concatenate(hashes), np.concatenate(dealt) % np.uint64(buckets)
            later = _later(every ^ (to * np.uint64(0x9E3779B97F4A7C15)), doc, _ranks(ids))
            rows, where = [], []
            for d, starts, ends in _runs(doc[later], at[later]):
                # Settled here: passed through the exchange under the document's own number.
                where.append(-1 - _place(ids[d], keys[d], buckets))
                rows.append({"ids": [ids[d]], "keys": [keys[d]], "counts": [len(starts)], "hashes": starts.astype("<i4").tobytes(), "at": ends.astype("<i4").tobytes()})
            rest = np.flatnonzero(~later)
            rest = rest[np.argsort(to[rest], kind="stable")]
            ends = np.flatnonzero(np.concatenate([to[rest][1:] != to[rest][:-1], [True]])) + 1 if len(rest) else []
            begin = 0
            for end in ends:
                part = rest[begin:end]
                begin = end
                docs, n = np.unique(doc[part], return_counts=True)
                where.append(int(to[part[0]]))
                long = at[part].max() >= 1 << 16
                rows.append({
                    "ids": [ids[d] for d in docs], "keys": [keys[d] for d in docs], "counts": n.tolist(),
                    "hashes": every[part].tobytes(), "at": at[part].astype("<u4" if long else "<u2").tobytes(),
                })
            for store in (ids, keys, hashes, dealt):
                store.clear()
            return _rows(packed, where, rows)

        for batch in batches:
            for id, key, text in zip(*(batch.column(c) for c in ("_id", "_key", "_text"))):
                tokens = text.as_py().encode("utf-8", "surrogatepass").split()
                if len(tokens) < length:
                    continue
                values = words.of(tokens)
                ids.append(id.as_py())
                keys.append(key.as_py())
                hashes.append(roll.windows(values, length))
                dealt.append(deal.windows(values, length))
                held += len(hashes[-1])
                if held >= chunk:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    runs = pa.schema([
        ("block", pa.int64()), ("ids", pa.list_(id_arrow)), ("keys", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
    ])
    flat = lambda table, name: [v for row in table.column(name).to_pylist() for v in row]

    def count(table: pa.Table) -> pa.Table:
        """The repeats of a bucket, packed by block of documents."""
        ids, keys = flat(table, "ids"), flat(table, "keys")
        if table.column("bucket")[0].as_py() < 0:
            read = lambda name: [np.frombuffer(v.as_py(), "<i4") for v in table.column(name)]
            found = [(d, s, e) for d, (s, e) in enumerate(zip(read("hashes"), read("at")))]
        else:
            counts = np.array(flat(table, "counts"), np.int64)
            hashes = np.concatenate([np.frombuffer(v.as_py(), np.uint64) for v in table.column("hashes")])
            at = np.concatenate([
                np.frombuffer(a.as_py(), "<u2" if 4 * len(a.as_py()) == len(h.as_py()) else "<u4").astype(np.int64)
                for h, a in zip(table.column("hashes"), table.column("at"))
            ])
            doc = np.repeat(np.arange(len(ids)), counts)
            later = np.flatnonzero(_later(hashes, doc, _ranks(ids)))
            found = _runs(doc[later], at[later])
        blocks: dict[int, list] = {}
        for run in found:
            blocks.setdefault(_place(ids[run[0]], keys[run[0]], buckets), []).append(run)
        rows = [
            {"block": block, "ids": [ids[d] for d, _, _ in part], "keys": [keys[d] for d, _, _ in part],
             "counts": [len(s) for _, s, _ in part], "starts": np.concatenate([s for _, s, _ in part]),
             "ends": np.concatenate([e for _, _, e in part])}
            for block, part in blocks.items()
        ]
        return pa.Table.from_pylist(rows, schema=runs)

    answer = pa.schema([("_id", id_arrow), ("_key", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def gather(table: pa.Table) -> pa.Table:
        """All runs of each document of a block."""
        starts = np.concatenate([v.values.to_numpy() for v in table.column("starts")])
        ends = np.concatenate([v.values.to_numpy() for v in table.column("ends")])
        found, done = {}, 0
        for id, key, n in zip(flat(table, "ids"), flat(table, "keys"), flat(table, "counts")):
            found.setdefault((id, key), []).append(slice(done, done + n))
            done += n
        both = [merged(*(np.concatenate([v[x] for x in parts]) for v in (starts, ends))) for parts in found.values()]
        return pa.Table.from_arrays(
            [pa.array([k[0] for k in found], id_arrow), pa.array([k[1] for k in found], pa.int64()),
             ints([s for s, _ in both]), ints([e for _, e in both])], schema=answer
        )

    sent = own.mapInArrow(send, "bucket long, " + _PACKED.format(id_kind))
    dealt = sent.groupBy("bucket").applyInArrow(
        count, f"block long, ids array<{id_kind}>, keys array<long>, counts array<int>, starts array<int>, ends array<int>"
    )
    return dealt.groupBy("block").applyInArrow(gather, f"_id {id_kind}, _key long, starts array<int>, ends array<int>")


def _arrow(own: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(own.schema["_id"].dataType)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, **sizes) -> DataFrame:
    """One row per document: (_id, n_words, n_removed, kept).

    ``kept`` holds the words that no repeated window covers, joined by one space. Windows
    are judged on the input. Null and empty texts have no words; texts shorter than a
    window lose nothing; of documents with the same id none is smaller, so repeated rows
    lose nothing to each other; a null id counts as larger than all. An empty table gives
    an empty result; other columns are not looked at.
    """
    own = own_columns(docs, id, text)

    def cut(value: str, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
        words = value.encode("utf-8", "surrogatepass").split()
        # A run of starts [s, e) covers the words up to the end of its last window.
        starts, ends = merged(starts, ends + length - 1)
        kept, done = [], 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            kept += words[done:s]
            done = e
        kept += words[done:]
        return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")

    fields = [("n_words", "long"), ("n_removed", "long"), ("kept", "string")]
    return apply_marks(own, repeated(own, length, **sizes), cut, fields, own.schema["_id"].dataType)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``without_repeats``."""
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", sha(F.col("kept")).alias("kept_sha256"))
