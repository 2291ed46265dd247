"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation shuffles the shingles, a second one, shifted round by one place for every
coordinate, gives all minima of a signature. Bands of the signature are buckets. Documents
with equal shingle sets are one class, and only classes are compared. Links are confirmed
on full sets.

A bucket of few classes is compared pair by pair. In a larger one every class is compared
with two leaders. Where that leaves a large bucket in several components, the classes of
these buckets are compared by a prefix filter that loses no link: two sets that overlap
enough share one of their rarest shingles. Shingles of a single component come first in
that order, so a class that its component can't reach by its common shingles makes no
candidates, however many classes hold those.

Pairs of similarity ``s`` share no bucket with probability ``(1 - s**ROWS)**BANDS``: under
one in two million at the threshold of 0.85, and less above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from passagework.llm.common import save, sent_if_small, without
from passagework.llm.graph import components
from passagework.llm.marks import beside, own_columns
from passagework.llm.rolling import WordHashes, mixed

SHINGLE = 3
SIMILARITY = (85, 100)
BANDS, ROWS = 25, 5
# Rows whose sets a task holds at a time.
SETS_AT_ONCE = 500
FEW = 6
# Ratio of neighbouring sizes that the prefix filter takes together.
SIZE_STEP = 1.02
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of every ``size`` consecutive words; of all words if they are fewer."""
    n = len(words)
    if not n:
        return words
    span = min(size, n)
    total = np.full(n - span + 1, np.uint64(span))
    for i in range(span):
        total = total * np.uint64(0x100000001B3) + mixed(words[i:n - span + 1 + i] ^ _FACTORS[i % 5])
    return np.unique(mixed(total))


def signature(tokens: np.ndarray, size: int) -> np.ndarray:
    """Minima of a circulant MinHash: coordinate k permutes the universe of 2**32 shifted by k."""
    first = (tokens >> np.uint64(32)).astype(np.uint32)  # ``tokens`` are permuted already
    shifts = np.arange(size, dtype=np.uint32)
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(first), 256):
        x = first[i:i + 256, None] - shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def buckets(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per band of a signature."""
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        total = mixed(total * np.uint64(0x100000001B3) ^ column.astype(np.uint64))
    return total.view(np.int64)


def _tokens(words: WordHashes, text: str, size: int) -> np.ndarray:
    # Bytes fold A-Z only, and split at ASCII white space only.
    return shingles(words.of(text.encode("utf-8", "surrogatepass").lower().split()), size)


def _signed(own: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(_id, _key, n, class, short, bands); texts without words have n = 0 and null elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, names, parts = [], [], []
            for text in batch.column("_text"):
                tokens = _tokens(words, text.as_py(), size)
                sizes.append(len(tokens))
                if len(tokens):
                    names.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    parts.append(buckets(signature(tokens, bands * rows), bands, rows))
                else:
                    names.append(None)
                    parts.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array([n and int.from_bytes(n[:8], "little", signed=True) for n in names], pa.int64()),
                 pa.array(parts, pa.list_(pa.int64()))],
                names=["_id", "_key", "n", "class", "short", "bands"],
            )

    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(run, f"_id {kind}, _key long, n long, class binary, short long, bands array<long>")


def _sets(own: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(short, class, n, tokens): the shingle sets of wanted (_id, _key, class, short)."""
    texts = beside(own, wanted, "4", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for begin in range(0, whole.num_rows, SETS_AT_ONCE):
                batch = whole.slice(begin, SETS_AT_ONCE)
                found = [_tokens(words, text.as_py(), size) for text in batch.column("_text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("short"), batch.column("class"), pa.array([len(t) for t in found], pa.int64()),
                     pa.array([t.tobytes() for t in found], pa.binary())],
                    names=["short", "class", "n", "tokens"],
                )

    return texts.mapInArrow(run, "short long, class binary, n long, tokens binary").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int], sized: bool = False) -> DataFrame:
    """(a, b) classes of the pairs (a, b) of short names whose full sets are similar enough."""
    above, below = similarity
    size = sets.select("short", "n")
    one = sets.select(F.col("short").alias("a"), F.col("class").alias("ca"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("short").alias("b"), F.col("class").alias("cb"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    # Sizes alone rule out many pairs before any set moves, unless they were looked at already.
    near = pairs if sized else pairs.join(size.withColumnsRenamed({"short": "a", "n": "na"}), "a").join(
        size.withColumnsRenamed({"short": "b", "n": "nb"}), "b"
    ).where(
        (F.least("na", "nb") * below >= F.greatest("na", "nb") * above)
    ).select("a", "b").distinct()
    both = near.join(one, "a").join(two, "b").select("ca", "cb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, None
            for a, b in zip(batch.column("ta"), batch.column("tb")):
                a, b = a.as_py(), b.as_py()
                if a != last:
                    last, left = a, np.frombuffer(a, np.uint64)
                right = np.frombuffer(b, np.uint64)
                place = np.searchsorted(left, right)
                place[place == len(left)] = 0
                shared = int((left[place] == right).sum())
                keep.append(below * shared >= above * (len(left) + len(right) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("ca").filter(mask), batch.column("cb").filter(mask)], names=["a", "b"]
            )

    return both.mapInArrow(run, "a binary, b binary")


def _residual(members: DataFrame, sets: DataFrame, groups: DataFrame, similarity: tuple[int, int], step: float) -> DataFrame:
    """Candidate pairs (a, b) of short names between components that share a large bucket."""
    above, below = similarity
    both = above + below
    placed = save(
        sets.select("short", "class").join(groups.withColumnRenamed("node", "class"), "class", "left").select(
            "short", "class", F.coalesce("component", "class").alias("component")
        ),
        "placed",
    )
    held = members.where(F.col("count") > FEW).select("bucket", "short").join(placed, "short")
    spread = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    opened = save(held.join(spread, "bucket").select("short", "class", "component").distinct(), "opened")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t.as_py(), np.int64) for t in batch.column("tokens")]
            for i, values in enumerate(tokens):
                one = batch.slice(i, 1)
                take = pa.array(np.zeros(len(values), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(c).take(take) for c in ("short", "class", "component", "n")), pa.array(values)],
                    names=["short", "class", "component", "n", "token"],
                )

    wide = sets.select("class", "n", "tokens").join(opened, "class").select("short", "class", "component", "n", "tokens")
    flat = save(wide.mapInArrow(run, "short long, class binary, component binary, n long, token long"), "tokens")
    known = flat.groupBy("token").agg(
        F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")
    ).select("token", "df", (F.col("low") != F.col("high")).alias("shared"))
    order = Window.partitionBy("class").orderBy("shared", "df", "token")
    ranked = flat.join(known, "token").withColumn("rank", F.row_number().over(order)).where("shared")
    least = lambda m: F.expr(f"({above} * (n + {m}) + {both} - 1) div {both}")  # noqa: E731  overlap of two similar sets
    level = lambda m: F.floor(F.log(m.cast("double")) / float(np.log(step))).cast("int")
    # A set looks for partners of every size that could be similar, with the prefix that this size needs.
    sized = ranked.where(F.col("rank") <= F.col("n") - F.expr(f"({above} * n + {below} - 1) div {below}") + 1).withColumn(
        "own", level(F.col("n"))
    ).withColumn("other", F.explode(F.sequence(
        level(F.expr(f"greatest(1, ({above} * n) div {below})")), level(F.expr(f"({below} * n) div {above} + 1"))
    ))).withColumn("m", F.greatest(F.lit(1), F.floor(F.pow(F.lit(step), F.col("other"))).cast("long") - 1))
    ready = save(
        sized.where(F.col("rank") <= F.col("n") - least("m") + 1).select(
            "token", "own", "other", "short", "component", "n", "rank"
        ), "prefixes"
    )
    left, right = ready.alias("x"), ready.alias("y")
    overlap = f"(({above} * (x.n + y.n) + {both} - 1) div {both})"
    return left.join(
        right,
        # With both sizes known, the prefixes are as short as they can be.
        F.expr(
            "x.token = y.token and x.own = y.other and x.other = y.own and x.short < y.short and x.component != y.component "
            f"and {below} * least(x.n, y.n) >= {above} * greatest(x.n, y.n) and {overlap} <= least(x.n - x.rank, y.n - y.rank) + 1"
        ),
    ).select(F.col("x.short").alias("a"), F.col("y.short").alias("b")).distinct()


def _same_id(signed: DataFrame) -> DataFrame:
    """(a, b): of each id with several classes, its smallest class with each of the others."""
    held = signed.where("n > 0 and _id is not null").select("_id", F.col("class").alias("b")).distinct()
    least = sent_if_small(save(
        held.groupBy("_id").agg(F.min("b").alias("a"), F.max("b").alias("last")).where("a != last").select("_id", "a"), "repeated_ids"
    ))
    return held.join(least, "_id").where("a != b").select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document: (_id, _key, n_shingles, component_id, kept).

    Documents are linked when ``similarity[1] * intersection >= similarity[0] * union`` of
    their sets of ``size``-word shingles; a text of fewer words is one shingle. A component
    is named by the smallest id in it, and the document of that id is kept.

    Null and empty texts have no shingles, are linked with nothing and form components of
    their own. Rows that repeat an id are the same document; all of them are kept or none,
    also if their texts differ and are linked through others. A null id is larger than all:
    a component of null ids only has a null name and is kept. An empty table gives an empty
    result; other columns are not looked at.
    """
    own = own_columns(docs, id, text)
    signed = save(_signed(own, size, bands, rows), "signed")
    # Copies of a set are one class, whatever their number; the first of them stands for it.
    classes = save(
        signed.where("n > 0").groupBy("class").agg(
            F.min("_id").alias("low"), F.min(F.struct("_id", "_key")).alias("one"),
            F.first("short").alias("short"), F.first("bands").alias("bands"),
        ),
        "classes",
    )
    placed = classes.select("short", F.explode("bands").alias("bucket"))
    led = placed.groupBy("bucket").agg(F.count("*").alias("count"), F.min("short").alias("leader")).where("count > 1")
    members = save(placed.join(led, "bucket"), "members")
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    small = members.where(F.col("count") <= FEW).groupBy("bucket").agg(F.collect_list("short").alias("all"))
    every = small.select(F.explode(F.flatten(F.transform(
        "all", lambda x: F.transform("all", lambda y: pair(x, y))
    ))).alias("p"))
    # Two leaders, by orders that hold in every bucket, so a class meets the same few leaders in
    # most of its buckets. One has the smallest id: copies are mostly made of what was there before.
    first = placed.join(classes.select("short", "low"), "short").groupBy("bucket").agg(
        F.min_by("short", "low").alias("first"), F.count("*").alias("count")
    ).where(F.col("count") > FEW).select("bucket", "first")
    large = members.where(F.col("count") > FEW).join(first, "bucket").select(
        F.explode(F.array(pair(F.col("short"), F.col("leader")), pair(F.col("short"), F.col("first")))).alias("p")
    )
    pairs = save(every.unionByName(large).select("p.*").where("a != b").distinct(), "pairs")
    wanted = members.select("short").distinct().join(classes, "short").select("one.*", "class", "short")
    sets = save(_sets(own, save(wanted, "wanted"), size), "sets")
    links = save(_verified(pairs, sets, similarity).unionByName(_same_id(signed)), "links")
    groups = save(components(links), "groups")
    rest = _residual(members, sets, groups, similarity, SIZE_STEP)
    further = save(_verified(rest, sets, similarity, sized=True), "further")
    if further.limit(1).count():
        groups = save(components(links.unionByName(further)), "groups")
    named = classes.select("class", "low").join(groups.withColumnRenamed("node", "class"), "class")
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    names = named.join(low, "component").select("class", "component_id")
    single = classes.select("class", "low").join(names, "class", "left").select(
        "class", F.coalesce("component_id", "low").alias("component_id")
    )
    return signed.select("_id", "_key", "n", "class").join(single, "class", "left").select(
        "_id", "_key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
    ).withColumn("kept", F.col("_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are kept, with their columns as they are."""
    return without(docs, near_duplicates(docs, id, text, **options).where("not kept"), id, text)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``near_duplicates``."""
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")
