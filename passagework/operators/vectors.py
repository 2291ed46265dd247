"""Vectors, the vector index table, and nearest-neighbour lookups.

Similarity is the cosine. A vector of length zero, or with an element that is null or not
finite, has no direction: it is never retrieved, and a query without direction retrieves
nothing. Vectors of another length than the query's raise an error. Scores are compared
after rounding to nine digits and ties go to the smaller id, so the result does
not depend on how the work was divided.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from passagework.functions.slices import sliced
from passagework.operators.changes import duplicate_keys

TOP_K = 5
# A question table up to both limits is sent to every task; a larger one is shuffled.
BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 64 << 20
# Rows of queries and of index vectors that one task compares at a time.
BLOCK_ROWS = 8192
QUERY_STEP = 256
# Index rows of a block whose highest value for a query is taken first.
STRIP_ROWS = 128
# Columns of one product of packed rows, a power of two; bits of a dot product by the rows in a column.
PACKED_COLUMNS = 1024
PACKED_BITS = {3: 8, 2: 12, 1: 24}
# Index rows from which on packing them is worth it, and whose place still fits a pair's number.
LEAST_PACKED = 1 << 15
MOST_PACKED = 1 << 22
# Index rows, one after the other by length, whose highest value is taken first.
GROUP_ROWS = 16
# Index rows of which the first bound of a query's k-th value is taken, as a part of all.
SEED_PART = 64
# Candidates of a query in a block from which on their k-th value is looked for.
MANY_FOUND = 32
# Rows, and vector values, of queries and of index vectors that one task holds.
TILE_ROWS = 1 << 17
TILE_VALUES = 1 << 23
# Tasks per slot that a smaller comparison is divided into.
TILES_PER_SLOT = 4
# Shuffle partitions per pair of tiles, so that few pairs share a task, and the most of them.
PARTS_PER_PAIR = 4
MOST_PARTS = 1 << 13
# Vector values gathered at a time when single pairs are scored.
PAIR_VALUES = 1 << 22
SCORE_UNITS = 1_000_000_000
# Cosines that round to the same score may differ by one unit; distances carry rounding errors.
_COSINE_SLACK = 2 / SCORE_UNITS
_DISTANCE_SLACK = 1e-7


def embed(
    df: DataFrame, text: Column, model: Callable[[list[str]], np.ndarray], name: str = "vector"
) -> DataFrame:
    """Add a vector per row, computed in slices of Arrow batches by the caller's model function."""

    def vectors(texts: list[str | None]) -> pa.Array:
        rows = np.asarray(model([t or "" for t in texts]), dtype=np.float32)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

    # Not deterministic to the optimiser, so that no filter runs the model a second time.
    return df.withColumn(name, sliced(vectors, T.ArrayType(T.FloatType())).asNondeterministic()(text))


def require_unique(index: DataFrame, key: str) -> DataFrame:
    """The index itself; raises when a primary key occurs twice."""
    twice = duplicate_keys(index, key).limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][key]!r} occurs {twice[0]['copies']} times")
    return index


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vector columns, or null when one has no direction."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norms = F.sqrt(dot(left, left) * dot(right, right))
    return F.when(norms > 0, dot(left, right) / norms)


def nearest_to(
    index: DataFrame, query: list[float], k: int = TOP_K, key: str = "id", vector: str = "vector"
) -> DataFrame:
    """Index rows nearest to one query vector, with their other columns and a score."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = index.withColumn("score", F.round(cosine(F.col(vector), literal), 9)).drop(vector)
    usable = F.col("score").isNotNull() & ~F.isnan("score")
    return scored.filter(usable).orderBy(F.desc("score"), key).limit(k)


# --- the kernel: best k of a block of index vectors for a block of queries ----


def _matrix(values) -> np.ndarray:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        array = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        if len(array) == 0:
            return np.zeros((0, 0))
        flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.diff(array.offsets.to_numpy())
        if (lengths != lengths[0]).any():
            raise ValueError("vectors of different lengths")
        return flat.reshape(len(array), -1)
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _top(query: np.ndarray, tie: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k candidates of every query, ties to the smaller ``tie``."""
    order = np.lexsort((tie, -units, query))
    ranked = query[order]
    place = np.arange(len(order)) - np.searchsorted(ranked, ranked, side="left")
    return order[place < k]


@dataclass
class _Best:
    """Best candidates per query so far; the three arrays are parallel."""

    query: np.ndarray
    ids: np.ndarray
    units: np.ndarray

    def merge(self, other: "_Best", k: int) -> "_Best":
        query = np.concatenate([self.query, other.query])
        ids = np.concatenate([self.ids, other.ids])
        units = np.concatenate([self.units, other.units])
        keep = _top(query, np.unique(ids, return_inverse=True)[1], units, k)
        return _Best(query[keep], ids[keep], units[keep])


def _pair_dots(
    left: np.ndarray, right: np.ndarray, row: np.ndarray, column: np.ndarray
) -> np.ndarray:
    """Dot products of the given pairs; many copies of a vector make many pairs, so in slices."""
    step = max(1, PAIR_VALUES // max(1, left.shape[1]))
    parts = [
        np.einsum("ij,ij->i", left[row[i:i + step]], right[column[i:i + step]], dtype=np.float64)
        for i in range(0, len(row), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def _directions(vectors: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((vectors / np.sqrt(squares)[:, None]).astype(np.float32))


def _block_best(
    queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block_rows: int = BLOCK_ROWS
) -> _Best:
    """Best k index rows per query row, exact, with ties to the smaller id.

    A single-precision product finds every pair that can be among the best k: its
    error is bounded, so pairs below the k-th value minus twice that bound are out.
    Only the pairs that remain are scored in double precision. The index rows are
    taken ``block_rows`` at a time, and the k-th value so far holds for the next; the
    highest value of each strip of ``STRIP_ROWS`` rows says which strips are looked into.
    Counts, as word vectors are, go by ``_best_of_counts``.
    """
    query_squares = np.einsum("ij,ij->i", queries, queries, dtype=np.float64)
    squares = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    asked, usable = np.flatnonzero(query_squares > 0), np.flatnonzero(squares > 0)
    usable = usable[np.argsort(ids[usable], kind="stable")]
    none = np.zeros(0, dtype=np.int64)
    if len(asked) == 0 or len(usable) == 0:
        return _Best(none, ids[none], none)
    if LEAST_PACKED <= len(usable) <= MOST_PACKED and _are_counts(queries, query_squares, vectors, squares):
        query, position, units = _best_of_counts(queries, query_squares, asked, vectors, squares, usable, k)
        return _Best(query, ids[position], units)
    unit = _directions(vectors[usable], squares[usable])
    slack = _single_slack(vectors)
    found = []
    for start in range(0, len(asked), QUERY_STEP):
        rows = asked[start:start + QUERY_STEP]
        near_to = _directions(queries[rows], query_squares[rows])
        kth = np.full(len(rows), -np.inf, dtype=np.float32)
        best = None  # parallel arrays: place in rows, place in usable, score
        near = np.empty((len(rows), math.ceil(min(block_rows, len(usable)) / STRIP_ROWS), STRIP_ROWS), dtype=np.float32)
        for at in range(0, len(usable), block_rows):
            block = unit[at:at + block_rows]
            flat = near.reshape(len(rows), -1)
            flat[:, len(block):] = -np.inf
            np.matmul(near_to, block.T, out=flat[:, :len(block)])
            # Only strips with something near enough are looked at closely.
            tops = near.max(axis=2)
            some = np.flatnonzero(tops.max(axis=1) >= kth - slack)
            if len(some) == 0:
                continue
            if tops.shape[1] >= k:
                # The k best strips hold k rows at least as near as the last of them.
                own = np.partition(tops[some], tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
                kth[some] = np.maximum(kth[some], own)
            place, strip = np.nonzero(tops[some] >= (kth[some] - slack)[:, None])
            place = some[place]
            strips = near[place, strip]
            part, column = np.nonzero(strips >= (kth[place] - slack)[:, None])
            value, row, column = strips[part, column], place[part], strip[part] * STRIP_ROWS + column
            held = column < len(block)
            value, row, column = value[held], row[held], column[held]
            number = np.bincount(row, minlength=len(rows))
            many = np.flatnonzero(number > max(k, MANY_FOUND))
            if len(many):
                ranked = value[np.lexsort((-value, row))]
                kth[many] = np.maximum(kth[many], ranked[(np.cumsum(number) - number)[many] + k - 1])
                close = value >= kth[row] - slack
                row, column = row[close], column[close]
            query, position = rows[row], usable[at + column]
            dots = _pair_dots(queries, vectors, query, position)
            units = np.rint(dots / np.sqrt(query_squares[query] * squares[position]) * SCORE_UNITS)
            tie = at + column
            if best is not None:
                row, tie, units = (np.concatenate(pair) for pair in zip(best, (row, tie, units)))
            keep = _top(row, tie, units, k)
            best = row[keep], tie[keep], units[keep]
            # The k-th best so far, for queries that have k.
            have = np.bincount(best[0], minlength=len(rows))
            least = best[2][np.cumsum(have)[have >= k] - 1] / SCORE_UNITS
            kth[have >= k] = np.maximum(kth[have >= k], (least - 2 / SCORE_UNITS).astype(np.float32))
        found.append((rows[best[0]], ids[usable[best[1]]], best[2].astype(np.int64)))
    return _Best(*(np.concatenate(parts) for parts in zip(*found)))


def _single_slack(vectors: np.ndarray) -> np.float32:
    """Twice what a single-precision product of directions may be off."""
    return np.float32(2 * (vectors.shape[1] + 4) * float(np.finfo(np.float32).eps))


# --- the kernel for counts: several index rows in one column of a product -----


def _are_counts(
    queries: np.ndarray, query_squares: np.ndarray, vectors: np.ndarray, squares: np.ndarray
) -> bool:
    """Whether all values are whole and not negative, and single precision holds every dot product."""
    if math.sqrt(query_squares.max() * squares.max()) + 1 >= 1 << PACKED_BITS[1]:
        return False
    return all((m >= 0).all() and (m == np.floor(m)).all() for m in (queries, vectors))


def _rows_in_a_column(most: float) -> int:
    """Index rows in one column, when no dot product passes ``most``."""
    return next(rows for rows, bits in PACKED_BITS.items() if most + 1 < 1 << bits or rows == 1)


def _pack(block: np.ndarray, rows: int) -> np.ndarray:
    """The rows of a block, ``rows`` of them in each column of a product; zeros where they end.

    ``GROUP_ROWS`` rows that follow each other lie as far apart as they can within a lane, so
    that halving a product leaves the highest value of each such group.
    """
    columns, dims = 3 * PACKED_COLUMNS // rows, block.shape[1]
    lanes = np.zeros((rows * columns, dims), dtype=np.float32)
    lanes[:len(block)] = block
    lanes = lanes.reshape(rows, columns // GROUP_ROWS, GROUP_ROWS, dims).swapaxes(1, 2).reshape(rows, columns, dims)
    return sum(lanes[lane] * np.float32(1 << (PACKED_BITS[rows] * lane)) for lane in range(rows))


def _folded(values: np.ndarray, rows: int, room: np.ndarray | None = None) -> np.ndarray:
    """Highest of the rows that lie a multiple of ``rows`` apart, kept in ``room``."""
    while len(values) > rows:
        half = len(values) // 2
        values = np.maximum(values[:half], values[half:], out=None if room is None else room[:half])
    return values


class _Products:
    """Dot products of packed rows with some queries, in arrays that are used again."""

    def __init__(self) -> None:
        self.rooms = {}

    def _room(self, name: str, rows: int, columns: int, kind: type) -> np.ndarray:
        if (name, rows, columns) not in self.rooms:
            self.rooms[name, rows, columns] = np.empty((rows, columns), dtype=kind)
        return self.rooms[name, rows, columns]

    def of(self, packed: np.ndarray, queries: np.ndarray) -> np.ndarray:
        single = self._room("single", len(packed), len(queries), np.float32)
        whole = self._room("whole", len(packed), len(queries), np.int32)
        np.matmul(packed, queries.T, out=single)
        np.copyto(whole, single, casting="unsafe")
        return whole

    def highest(self, products: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """The highest dot product of each group of rows, and of each lane, by query and then lane.

        There is a fourth lane of zeros beside three.
        """
        columns, queries = products.shape
        groups = columns // GROUP_ROWS
        if lanes == 3:  # three bytes of four
            room = self._room("bytes", columns // 2, 4 * queries, np.uint8)
            best = _folded(products.view(np.uint8), groups, room)
        else:
            room = self._room("halves", columns // 2, queries, np.int32)
            best = _folded(products, groups, room)
        if lanes == 2:
            bits = PACKED_BITS[lanes]
            low = np.bitwise_and(products, (1 << bits) - 1, out=self._room("low", columns, queries, np.int32))
            best = np.stack([_folded(low, groups, low), best >> bits], axis=2).reshape(groups, -1)
        return best, best.max(axis=0).reshape(queries, -1)


def _places(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is chosen; faster than ``nonzero`` where that is little."""
    return np.divmod(np.flatnonzero(chosen), chosen.shape[1])


def _best_of_counts(
    queries: np.ndarray, query_squares: np.ndarray, asked: np.ndarray,
    vectors: np.ndarray, squares: np.ndarray, usable: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of the ``usable`` rows for the ``asked`` queries as (query, row, units), exact, ties to the first.

    Both name vectors with a direction. Dot products of counts are whole numbers,
    and a product in single precision is exact below 2^24: two or three index rows, scaled by
    powers of two, share a column of it, and the bits of a value are their dot products. Index
    rows are taken by length, so the least dot product that may matter is nearly one number
    for a block; most blocks are left after a look at the highest value of a query in them.
    """
    by_length = np.argsort(squares[usable], kind="stable")
    own_squares = squares[usable[by_length]]
    lengths = np.sqrt(own_squares)
    counts = vectors[usable[by_length]].astype(np.float32, copy=False)
    size, columns = 3 * PACKED_COLUMNS, len(counts)
    packed, work = {}, _Products()
    # A pair is one number: query, score from the highest down, place of the row.
    tie_bits = max(1, (columns - 1).bit_length())
    most, score_bits = 1 << 30, 31

    def units_of(keys: np.ndarray) -> np.ndarray:
        return most - ((keys >> tie_bits) & ((1 << score_bits) - 1))

    def first_k(best: np.ndarray, more: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        keys = np.sort(np.concatenate([best, *more]))
        begin = np.searchsorted(keys, first)
        return keys[np.arange(len(keys)) - begin[keys >> (score_bits + tie_bits)] < k]

    seeds = np.arange(0, columns, SEED_PART)
    strips = 4 * k
    seeds = seeds[:len(seeds) // strips * strips]
    seed_rows = _directions(counts[seeds], own_squares[seeds]) if len(seeds) else None
    slack = float(_single_slack(vectors))
    asked = asked[np.argsort(query_squares[asked], kind="stable")]
    found = []
    for start in range(0, len(asked), QUERY_STEP):
        rows = asked[start:start + QUERY_STEP]
        own_lengths = np.sqrt(query_squares[rows])
        own = np.ascontiguousarray(queries[rows], dtype=np.float32)
        first = np.arange(len(rows), dtype=np.int64) << (score_bits + tie_bits)
        # No more than k of a query's pairs come before this number.
        bound = first + (1 << (score_bits + tie_bits)) - 1
        if seed_rows is not None:
            # The k best strips hold k rows at least as near as the last of them.
            near = seed_rows @ _directions(queries[rows], query_squares[rows]).T
            tops = np.partition(near.reshape(strips, -1, len(rows)).max(axis=1), strips - k, axis=0)[strips - k]
            least = np.maximum(np.floor((tops.astype(np.float64) - slack) * SCORE_UNITS) - 1, 0).astype(np.int64)
            bound = first + ((most - least) << tie_bits) + (1 << tie_bits) - 1
        best, waiting = np.zeros(0, dtype=np.int64), []
        for at in range(0, columns, size):
            until = min(at + size, columns)
            together = _rows_in_a_column(own_lengths[-1] * lengths[until - 1])
            if (at, together) not in packed:
                packed[at, together] = _pack(counts[at:until], together)
            products = work.of(packed[at, together], own)
            wide, bits = len(products), PACKED_BITS[together]
            groups, tops = work.highest(products, together)
            # The least dot product that may matter, by length of the row.
            scale = (units_of(bound) - 1) / SCORE_UNITS * own_lengths * (1 - 1e-12)
            shortest = lengths[np.minimum(at + wide * np.arange(together), until - 1)]
            needed = np.maximum(np.ceil(scale[:, None] * shortest), 0)
            place, lane = _places(tops[:, :together] >= needed)
            if len(place) == 0:
                continue
            highest = groups.take(place * tops.shape[1] + lane, axis=1)
            group, part = _places(highest >= needed[place, lane].astype(groups.dtype))
            shortest = lengths[np.minimum(np.arange(at, at + size, GROUP_ROWS), until - 1)].reshape(together, -1)
            near = highest[group, part] >= scale[place[part]] * shortest[lane[part], group]
            group, place, lane = group[near], place[part[near]], lane[part[near]]
            column = group[:, None] + len(groups) * np.arange(GROUP_ROWS)
            dots = (products.ravel().take(column * len(rows) + place[:, None]) >> (bits * lane)[:, None]) & ((1 << bits) - 1)
            part, member = _places(dots >= (scale[place] * shortest[lane, group])[:, None])
            place, dots = place[part], dots[part, member]
            position = at + lane[part] * wide + group[part] * GROUP_ROWS + member
            held = position < until
            place, dots, position = place[held], dots[held], position[held]
            units = np.rint(dots / np.sqrt(query_squares[rows[place]] * own_squares[position]) * SCORE_UNITS).astype(np.int64)
            keys = first[place] + ((most - units) << tie_bits) + by_length[position]
            waiting.append(keys[keys <= bound[place]])
            if sum(map(len, waiting)) >= k * len(rows):
                best, waiting = first_k(best, waiting, first), []
                number = np.bincount(best >> (score_bits + tie_bits), minlength=len(rows))
                full = number >= k
                bound[full] = np.minimum(bound[full], best[np.cumsum(number)[full] - 1])
        best = first_k(best, waiting, first)
        found.append((
            rows[best >> (score_bits + tie_bits)], usable[best & ((1 << tie_bits) - 1)], units_of(best),
        ))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _ids(values, kind: T.DataType) -> np.ndarray:
    return np.asarray(list(values), dtype=object if isinstance(kind, T.StringType) else np.int64)


def _result_schema(query_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", query_type),
        T.StructField("id", id_type),
        T.StructField("score", T.DoubleType()),
    ])


# --- few queries: send them to the index ------------------------------------


def _scan_with_queries(
    head: pa.Table, index: DataFrame, k: int, schema: T.StructType
) -> DataFrame:
    """Score every index partition against a bounded set of queries, no shuffle of the index."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(
        (head.column("query_id").to_pylist(), _matrix(head.column("vector")))
    )
    query_type, id_type = schema["query_id"].dataType, schema["id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        if not query_ids:
            return
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = _ids(batch.column("id").to_pylist(), id_type)
            vectors = _matrix(batch.column("vector"))
            found = _block_best(queries, ids, vectors, k)
            best = found if best is None else best.merge(found, k)
        if best is None:
            return
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(
                [query_ids[q] for q in best.query],
                pa.string() if isinstance(query_type, T.StringType) else pa.int64(),
            ),
            "id": pa.array(
                best.ids.tolist(), pa.string() if isinstance(id_type, T.StringType) else pa.int64()
            ),
            "score": pa.array(best.units / SCORE_UNITS, pa.float64()),
        })

    return index.mapInArrow(score, schema)


# --- many queries: route them to cells of the index --------------------------


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass
class Cells:
    """Cells around pivot vectors; every array is indexed by cell."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray

    def broadcast(self, df: DataFrame) -> Broadcast:
        """The arrays, sent to every executor once; rebuild with ``Cells(*value)``."""
        return df.sparkSession.sparkContext.broadcast((self.pivots, self.rows, self.radius))

    def slices(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """The vectors in slices whose table of distances stays within ``PAIR_VALUES``."""
        step = max(1, PAIR_VALUES // max(1, len(self.pivots)))
        for start in range(0, len(vectors), step):
            yield vectors[start:start + step]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells, nearest = [np.zeros(0, np.int64)], [np.zeros(0)]
        for part in self.slices(vectors):
            distance = self.distances(part)
            cells.append(distance.argmin(axis=1))
            nearest.append(distance.min(axis=1))
        return np.concatenate(cells), np.concatenate(nearest)

    def visits(self, vectors: np.ndarray, k: int, probes: int | None) -> list[np.ndarray]:
        """The cells that each query visits."""
        out = []
        for part in self.slices(vectors):
            chosen = self.reachable(part, k) if probes is None else self.closest(part, probes)
            out += [np.flatnonzero(row).astype(np.int32) for row in chosen]
        return out

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_unit(vectors) @ self.pivots.T)))

    def reachable(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """Cells that can hold one of the k nearest rows, by the triangle inequality.

        Walking the cells by their farthest possible row, the first k rows give a
        bound on the k-th distance; a cell whose nearest possible row is beyond
        that bound is left out. Rows whose scores round alike count as equally near,
        so that ties go to the smaller id wherever it lies.
        """
        distance = self.distances(vectors)
        farthest = np.where(self.rows > 0, distance + self.radius, np.inf)
        order = farthest.argsort(axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= k
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(self.rows) - 1)
        bound = np.take_along_axis(farthest, order[np.arange(len(order)), last][:, None], axis=1)
        nearest = np.maximum(0.0, distance - self.radius - _DISTANCE_SLACK)
        kth = bound + _DISTANCE_SLACK
        # Squares of distances are twice the cosines' distance from one.
        return (nearest**2 / 2 <= kth**2 / 2 + _COSINE_SLACK) & (self.rows > 0)

    def closest(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest non-empty cells; approximate."""
        distance = np.where(self.rows > 0, self.distances(vectors), np.inf)
        near = distance.argsort(axis=1)[:, :probes]
        chosen = np.zeros(distance.shape, dtype=bool)
        np.put_along_axis(chosen, near, True, axis=1)
        return chosen & (self.rows > 0)


def _named(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    renamed = df.select(F.col(key).alias(name), F.col(vector).alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return renamed.filter(F.col("vector").isNotNull() & ~odd)


def _with_direction(df: DataFrame) -> DataFrame:
    return df.filter(F.exists("vector", lambda x: x != 0))


def train_cells(
    index: DataFrame,
    cells: int | None = None,
    key: str = "id",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> Cells:
    """Pick pivots (a sample in hash order) and measure each cell.

    By default there is a cell per block of rows, and in a large index about as many
    cells as rows in a cell. Keep the result to look up an unchanged index again.
    """
    index = _with_direction(_named(index, key, vector, "id"))
    if cells is None:
        rows = index.count()
        cells = max(1, min(math.ceil(rows / block_rows), math.isqrt(rows)))
    sample = index.orderBy(F.md5(F.col("id").cast("string")), "id").limit(cells)
    pivots = _unit(_matrix(sample.select("vector").toArrow().column("vector")))
    if len(pivots) == 0:
        return Cells(pivots, np.zeros(0, np.int64), np.zeros(0))
    empty = Cells(pivots, np.zeros(len(pivots), np.int64), np.zeros(len(pivots)))
    shared = empty.broadcast(index)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for batch in batches:
            if batch.num_rows:
                cell, distance = Cells(*shared.value).assign(_matrix(batch.column("vector")))
                np.add.at(rows, cell, 1)
                np.maximum.at(radius, cell, distance)
        yield pa.RecordBatch.from_pydict(
            {"cell": np.arange(len(rows), dtype=np.int32), "rows": rows, "radius": radius}
        )

    measured = (
        index.select("vector")
        .mapInArrow(measure, "cell int, rows long, radius double")
        .groupBy("cell")
        .agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))
        .orderBy("cell")
        .toArrow()
    )
    return Cells(
        pivots,
        measured.column("rows").to_numpy().astype(np.int64),
        measured.column("radius").to_numpy().astype(np.float64),
    )


def _by_number(values: list[int], number: Column) -> Column:
    # One literal, however many cells there are.
    return F.element_at(F.from_json(F.lit(str([int(v) for v in values])), "array<int>"), number + 1)


def _tile_rows(asked: int, held: int, dims: int, slots: int, block_rows: int) -> int:
    """Side of a tile: small enough to keep all slots busy, at most what a task should hold."""
    busy = math.isqrt(asked * held // max(1, TILES_PER_SLOT * slots))
    return max(block_rows, min(busy, TILE_ROWS, TILE_VALUES // max(1, dims)))


def _tiles(rows: np.ndarray, tile_rows: int, together: bool) -> tuple[np.ndarray, np.ndarray]:
    """First tile and number of tiles of every cell.

    A cell of more than ``tile_rows`` rows has several tiles to itself; ``together``
    puts neighbouring smaller cells into one.
    """
    first, number, tile, held = [], [], -1, tile_rows
    for n in rows:
        parts = max(1, math.ceil(n / tile_rows))
        if not together or parts > 1 or held + n > tile_rows:
            tile += 1
            held = 0
        first.append(tile)
        number.append(parts)
        tile += parts - 1
        held += n if parts == 1 else tile_rows
    return np.array(first), np.array(number)


def _packed(rows: DataFrame, name: str, values: int) -> DataFrame:
    """Rows of a tile as few rows of many: ``tile``, the ``name`` column as a list, ``vectors`` as bytes.

    Bytes are shuffled and read back as a matrix without an object per value. A packed
    row has at most ``values`` vector values.
    """
    kind = rows.schema[name].dataType
    schema = T.StructType([
        T.StructField("tile", T.IntegerType()), T.StructField("other", T.IntegerType()),
        T.StructField("dims", T.IntegerType()), T.StructField(name, T.ArrayType(kind)),
        T.StructField("vectors", T.BinaryType()),
    ])
    single = rows.schema["vector"].dataType.elementType == T.FloatType()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = _matrix(batch.column("vector")).astype(np.float32 if single else np.float64)
            step = max(1, values // max(1, matrix.shape[1]))
            tile, other = batch.column("tile").to_numpy(), batch.column("other").to_numpy()
            order = np.lexsort((other, tile))
            cuts = np.flatnonzero(np.diff(tile[order]) | np.diff(other[order])) + 1
            for group in np.split(order, cuts):
                for at in range(0, len(group), step):
                    part = group[at:at + step]
                    ids = batch.column(name).take(pa.array(part))
                    yield pa.RecordBatch.from_pydict({
                        "tile": pa.array([tile[part[0]]], pa.int32()),
                        "other": pa.array([other[part[0]]], pa.int32()),
                        "dims": pa.array([matrix.shape[1]], pa.int32()),
                        name: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids),
                        "vectors": pa.array([matrix[part].tobytes()], pa.binary()),
                    })

    return rows.mapInArrow(pack, schema)


def _join_by_cells(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    schema: T.StructType,
    trained: Cells,
    probes: int | None,
    block_rows: int,
) -> DataFrame:
    """Compare tiles of queries with tiles of the cells they are routed to.

    A tile is a cell, part of a large cell, or for exact lookups several small cells, of
    about ``_tile_rows`` index rows; the queries routed to it are cut likewise. A task holds
    one tile of each, compares ``block_rows`` index rows at a time and returns at most k
    rows per query. A vector is sent once for every tile on the other side that it meets.
    """
    index = _with_direction(index)
    shared = trained.broadcast(index)
    tile_rows = _tile_rows(
        queries.count(), int(trained.rows.sum()), trained.pivots.shape[1],
        index.sparkSession.sparkContext.defaultParallelism, block_rows,
    )
    first, number = _tiles(trained.rows, tile_rows, probes is None)
    tile_of, parts = first.astype(np.int32), int(number.max())
    count = int((first + number).max())

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(Cells(*shared.value).assign(_matrix(vectors))[0])

    @F.pandas_udf("array<int>")
    def tiles_for(vectors: pd.Series) -> pd.Series:
        visited = Cells(*shared.value).visits(_matrix(vectors), k, probes)
        return pd.Series([
            np.unique(np.concatenate([tile_of[cells], *(
                tile_of[cells[number[cells] > part]] + part for part in range(1, parts)
            )])).astype(np.int32) for cells in visited
        ])

    routed = _with_direction(queries).select(
        "query_id", "vector", F.explode(tiles_for("vector")).alias("tile")
    )
    routed_rows = np.zeros(count, np.int64)
    for row in routed.groupBy("tile").count().collect():  # at most one row per tile
        routed_rows[row["tile"]] = row["count"]
    query_blocks = [max(1, math.ceil(n / tile_rows)) for n in routed_rows]

    def part(key: str, parts: Column) -> Column:
        return F.pmod(F.xxhash64(key), parts).cast("int")

    left = routed.select(
        "query_id", "vector", "tile", part("query_id", _by_number(query_blocks, F.col("tile"))).alias("other")
    )
    placed = index.select("id", "vector", cell_of("vector").alias("cell")).select(
        "id", "vector",
        (_by_number(first.tolist(), F.col("cell")) + part("id", _by_number(number.tolist(), F.col("cell")))).alias("tile"),
    )
    # Packed before it is copied for every block of queries.
    right = _packed(placed.withColumn("other", F.lit(0)), "id", PAIR_VALUES).withColumn(
        "other", F.explode(F.sequence(F.lit(0), _by_number(query_blocks, F.col("tile")) - 1))
    )
    query_kind, id_kind = schema["query_id"].dataType, schema["id"].dataType
    wide = [df.schema["vector"].dataType.elementType != T.FloatType() for df in (queries, index)]

    def rows_of(table: pa.Table, name: str, double: bool) -> tuple[pa.Array, np.ndarray]:
        dims = table.column("dims").to_pylist()
        if len(set(dims)) > 1:
            raise ValueError("vectors of different lengths")
        blobs = [np.frombuffer(b.as_buffer(), np.float64 if double else np.float32) for b in table.column("vectors").combine_chunks()]
        return table.column(name).combine_chunks().flatten(), np.concatenate(blobs).reshape(-1, dims[0])

    def compare(q: pa.Table, x: pa.Table) -> pa.Table:
        if q.num_rows == 0 or x.num_rows == 0:
            return pa.table({"query_id": pa.array([], names[0]), "id": pa.array([], names[1]), "score": pa.array([], pa.float64())})
        asked, vectors = rows_of(q, "query_id", wide[0])
        ids, rows = rows_of(x, "id", wide[1])
        if vectors.shape[1] != rows.shape[1]:
            raise ValueError("vectors of different lengths")
        best = _block_best(vectors, _ids(ids.to_pylist(), id_kind), rows, k, block_rows)
        return pa.table({
            "query_id": asked.take(pa.array(best.query)).cast(names[0]),
            "id": pa.array(best.ids.tolist(), names[1]),
            "score": pa.array(best.units / SCORE_UNITS, pa.float64()),
        })

    names = [pa.string() if isinstance(kind, T.StringType) else pa.int64() for kind in (query_kind, id_kind)]
    blocks = ["tile", "other"]
    packed = _packed(left, "query_id", PAIR_VALUES)
    # A pair of tiles is few bytes and much work: sizes say nothing of how to share it out.
    tasks = max(1, min(MOST_PARTS, PARTS_PER_PAIR * sum(n for n, rows in zip(query_blocks, routed_rows) if rows)))
    packed, right = packed.repartition(tasks, *blocks), right.repartition(tasks, *blocks)
    return packed.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(compare, schema)


def _at_most(df: DataFrame, rows: int) -> bool:
    return rows > 0 and df.select("query_id").limit(rows + 1).count() <= rows


def knn_join(
    queries: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    *,
    query_id: str = "query_id",
    key: str = "id",
    vector: str = "vector",
    exclude_self: bool = False,
    probes: int | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    cells: int | Cells | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest index rows of every query: (query_id, rank, id, score).

    A question table of at most ``broadcast_queries`` rows and ``BROADCAST_BYTES``
    is sent to the index scan. A larger one is joined cell by cell. Both are
    exact; ``probes`` visits only that many cells per query and is approximate.
    ``exclude_self`` leaves out the index row with the query's own id. ``cells`` is
    the result of ``train_cells`` for this index, or a number of cells.
    """
    queries = _named(queries, query_id, vector, "query_id")
    index = _named(index, key, vector, "id")
    schema = _result_schema(queries.schema["query_id"].dataType, index.schema["id"].dataType)
    wanted = k + 1 if exclude_self else k

    candidates = None
    if probes is None and _at_most(queries, broadcast_queries):
        head = queries.limit(broadcast_queries + 1).toArrow()
        if head.num_rows <= broadcast_queries and 2 * head.nbytes <= BROADCAST_BYTES:
            candidates = _scan_with_queries(head, index, wanted, schema)
    if candidates is None:
        trained = cells
        if not isinstance(trained, Cells):
            trained = train_cells(index, cells, block_rows=block_rows)
        if len(trained.rows) == 0:
            return index.sparkSession.createDataFrame(
                [], T.StructType([schema[0], T.StructField("rank", T.IntegerType()), *schema[1:]])
            )
        candidates = _join_by_cells(queries, index, wanted, schema, trained, probes, block_rows)
    if exclude_self:
        candidates = candidates.filter(F.col("id") != F.col("query_id"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        candidates.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def write_index(
    index: DataFrame,
    folder: str,
    cells: int | None = None,
    key: str = "id",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> None:
    """Store an index by cell, with its cells, so that ``lookup`` reads only what it probes.

    Keys must be unique. Rows without direction are never found and are not stored.
    """
    require_unique(index, key)
    trained = train_cells(index, cells, key, vector, block_rows)
    spark, dims = index.sparkSession, trained.pivots.shape[1] if len(trained.rows) else 0
    shared = trained.broadcast(index)

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(Cells(*shared.value).assign(_matrix(vectors))[0])

    stored = _with_direction(_named(index, key, vector, "id"))
    if len(trained.rows):
        stored = stored.withColumn("cell", cell_of("vector"))
    else:
        stored = stored.withColumn("cell", F.lit(0))
    # A large cell is written by several tasks.
    stored.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
    table = [
        (i, trained.pivots[i].tolist(), int(trained.rows[i]), float(trained.radius[i]), dims)
        for i in range(len(trained.rows))
    ]
    spark.createDataFrame(table, "cell int, pivot array<double>, rows long, radius double, dims int").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{folder}/cells")


def lookup(
    queries: DataFrame,
    folder: str,
    k: int = TOP_K,
    probes: int | None = None,
    query_id: str = "query_id",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``knn_join`` with a stored index: only the cells that some query visits are read.

    Without ``probes`` the result is exact, and every cell that can matter is visited.
    """
    spark = queries.sparkSession
    known = spark.read.parquet(f"{folder}/cells").orderBy("cell").toPandas()
    index = spark.read.parquet(f"{folder}/rows")
    named = _with_direction(_named(queries, query_id, vector, "query_id"))
    if known.empty:
        return knn_join(named, index, k, probes=probes)
    trained = Cells(np.stack(known["pivot"].to_list()), known["rows"].to_numpy(), known["radius"].to_numpy())
    shared = trained.broadcast(queries)

    @F.pandas_udf("array<int>")
    def cells_for(vectors: pd.Series) -> pd.Series:
        return pd.Series(Cells(*shared.value).visits(_matrix(vectors), k, probes))

    visited = named.select(F.explode(cells_for("vector")).alias("cell")).distinct().collect()  # at most every cell
    read = index.filter(F.col("cell").isin([r["cell"] for r in visited])).drop("cell")
    return knn_join(named, read, k, cells=trained, probes=probes, block_rows=block_rows, broadcast_queries=0)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how many of the true neighbours an approximate lookup found."""
    marks = truth.select("query_id", "id", F.lit(1).alias("true"), F.lit(0).alias("found")).unionByName(
        found.select("query_id", "id", F.lit(0).alias("true"), F.lit(1).alias("found"))
    )
    pairs = marks.groupBy("query_id", "id").agg(
        F.max("true").alias("true"), F.max("found").alias("found")
    )
    return pairs.agg(
        F.sum("true").alias("neighbours"),
        F.count_if((F.col("true") == 1) & (F.col("found") == 1)).alias("hits"),
    ).withColumn("recall", F.col("hits") / F.col("neighbours"))
