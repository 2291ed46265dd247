"""A stored index of quantised vectors in cells, kept in step by change lists.

Cells are the leaves of a two-level tree of means: a row is compared with about twice the
square root of their number. Within its cell a row's direction is also kept as a short code,
a number per few dimensions of what its cell's mean leaves over. A lookup scans the codes of
the cells it probes and compares only a shortlist with full vectors; without ``probes`` it is
exact and visits every cell that the triangle inequality can't rule out.

A folder holds numbered generations. Each names, for every cell, the generation whose files
hold its rows, so a change list rewrites the cells it touches and leaves all other files as
they are; a generation counts once its single manifest file is in place, and a repeated
attempt replaces what a failed one left. Cells and codes are learned from a bounded sample
(``SAMPLE_PER_CELL`` rows a cell, ``CODE_SAMPLE`` rows for the codes); every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators.vectors import (
    BLOCK_ROWS,
    PAIR_VALUES,
    SCORE_UNITS,
    TOP_K,
    Cells,
    _block_best,
    _by_number,
    _ids,
    _matrix,
    _named,
    _unit,
    _with_direction,
    require_unique,
)
from passagework.sources.tables import save_parquet, work_dir

MOST_CELLS = 1 << 14
SAMPLE_PER_CELL = 64
CODE_SAMPLE = 20_000
ROUNDS = 5
CODES = 256
VALUES_PER_CODE = 2
# Of the nearest groups of cells, so many times the probed cells are compared with a query.
CONSIDERED = 4
# An index is learned anew when more than this share of its rows changed since, or when a
# cell holds this many times its even share.
RETRAIN_SHARE = 0.5
UNEVEN = 16
# Ids of changed rows, and rows of a shortlist, that may be sent to every task.
SENT_IDS = 200_000


@dataclass
class Tree:
    """Means of cells, sorted by group, and means of the groups; all of length one.

    The cells of group g are those numbered from ``first[g]`` up to ``first[g + 1]``.
    """

    groups: np.ndarray
    first: np.ndarray
    cells: np.ndarray

    @property
    def step(self) -> int:
        """Rows compared at a time, so that a table of distances stays within ``PAIR_VALUES``."""
        widest = max(len(self.groups), int(np.diff(self.first).max(initial=1)))
        return max(1, PAIR_VALUES // max(1, widest))

    def assign(self, units: np.ndarray) -> np.ndarray:
        """The cell of each row: the nearest of the nearest group."""
        cell = np.empty(len(units), np.int64)
        for start in range(0, len(units), self.step):
            part = units[start:start + self.step]
            group = (part @ self.groups.T).argmax(axis=1)
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                own = self.cells[self.first[g]:self.first[g + 1]]
                cell[start + rows] = self.first[g] + (part[rows] @ own.T).argmax(axis=1)
        return cell

    def nearest(self, units: np.ndarray, probes: int, rows: np.ndarray) -> list[np.ndarray]:
        """The ``probes`` nearest cells with rows, looked for in the nearest groups only."""
        filled = np.array([(rows[a:b] > 0).sum() for a, b in zip(self.first, self.first[1:])])
        out = []
        for start in range(0, len(units), self.step):
            part = units[start:start + self.step]
            order = (-(part @ self.groups.T)).argsort(axis=1, kind="stable")
            enough = np.cumsum(filled[order], axis=1) >= CONSIDERED * probes
            last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(self.groups) - 1)
            for unit, near, n in zip(part, order, last):
                some = np.concatenate([np.arange(self.first[g], self.first[g + 1]) for g in near[:n + 1]])
                some = some[rows[some] > 0]
                best = (-(self.cells[some] @ unit)).argsort(kind="stable")[:probes]
                out.append(some[best].astype(np.int32))
        return out


@dataclass
class Codes:
    """Code words for each few dimensions of what a cell's mean leaves of a unit vector."""

    words: np.ndarray  # (parts, CODES, VALUES_PER_CODE)

    def split(self, rest: np.ndarray) -> np.ndarray:
        parts, _, values = self.words.shape
        padded = np.zeros((len(rest), parts * values))
        padded[:, :rest.shape[1]] = rest
        return padded.reshape(len(rest), parts, values)

    def encode(self, rest: np.ndarray) -> np.ndarray:
        pieces, out = self.split(rest), np.empty((len(rest), len(self.words)), np.uint8)
        step = max(1, PAIR_VALUES // CODES)
        for start in range(0, len(rest), step):
            for part, words in enumerate(self.words):
                piece = pieces[start:start + step, part]
                near = 2 * piece @ words.T - np.einsum("ij,ij->i", words, words)
                out[start:start + step, part] = near.argmax(axis=1)
        return out

    def decode(self, codes: np.ndarray, dims: int) -> np.ndarray:
        parts = np.arange(len(self.words))
        return self.words[parts, codes].reshape(len(codes), -1)[:, :dims]


@dataclass
class Stored:
    """What a generation of the index knows without reading rows; arrays are indexed by cell."""

    generation: int
    learned: int  # the generation that the tree and the codes come from
    learned_rows: int
    changed: int  # rows changed since then
    tree: Tree
    codes: Codes
    of: np.ndarray  # the generation that holds the cell's rows
    rows: np.ndarray
    radius: np.ndarray


# --- learning -------------------------------------------------------------------


def _rounds(
    sample: DataFrame, means: np.ndarray, home: Callable[[np.ndarray, np.ndarray], np.ndarray], rounds: int
) -> np.ndarray:
    """Lloyd rounds: tasks add up their rows by cell, the sums become the next means.

    ``home(means, units)`` gives each row's cell. A mean without rows stays where it is.
    """
    for _ in range(rounds):
        shared = sample.sparkSession.sparkContext.broadcast(means)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sums = shared.value, {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                units = _unit(_matrix(batch.column("vector")))
                cell = home(now, units)
                for c in np.unique(cell):
                    total = units[cell == c].sum(axis=0)
                    sums[int(c)] = sums[int(c)] + total if int(c) in sums else total
            for c, total in sums.items():
                yield pa.RecordBatch.from_pydict({
                    "cell": np.full(len(total), c, np.int32), "dim": np.arange(len(total), dtype=np.int32), "total": total,
                })

        # As many rows as the means have values, whatever the sample.
        summed = (
            sample.select("vector").mapInArrow(add, "cell int, dim int, total double")
            .groupBy("cell", "dim").agg(F.sum("total").alias("total")).toPandas()
        )
        moved = np.zeros_like(means)
        moved[summed["cell"].to_numpy(), summed["dim"].to_numpy()] = summed["total"].to_numpy()
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        means = np.where(length > 1e-12, moved / np.maximum(length, 1e-12), means)
        shared.unpersist()
    return means


def _flat(means: np.ndarray, units: np.ndarray) -> np.ndarray:
    step = max(1, PAIR_VALUES // max(1, len(means)))
    parts = [(units[i:i + step] @ means.T).argmax(axis=1) for i in range(0, len(units), step)]
    return np.concatenate(parts)


def _first_in_hash_order(sample: DataFrame, n: int) -> np.ndarray:
    head = sample.orderBy(F.xxhash64("id"), "id").select("vector").limit(n).toArrow()
    return _unit(_matrix(head.column("vector")))


def learn_tree(sample: DataFrame, cells: int, rounds: int = ROUNDS) -> Tree:
    """A tree of about ``cells`` cells from a saved sample of (id, vector) with directions."""
    groups = _rounds(sample, _first_in_hash_order(sample, max(1, math.isqrt(cells))), _flat, rounds)
    shared = sample.sparkSession.sparkContext.broadcast(groups)

    @F.pandas_udf("int")
    def group_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(_flat(shared.value, _unit(_matrix(vectors))))

    grouped = save_parquet(sample.withColumn("group", group_of("vector")), work_dir(sample.sparkSession, "grouped"))
    held = np.zeros(len(groups), np.int64)
    for row in grouped.groupBy("group").count().collect():  # at most one row per group
        held[row["group"]] = row["count"]
    share = np.where(held > 0, np.maximum(1, np.rint(cells * held / max(1, held.sum()))), 0).astype(int)
    within = Window.partitionBy("group").orderBy(F.xxhash64("id"), "id")
    seeds = (
        grouped.withColumn("nth", F.row_number().over(within))
        .where((F.col("nth") <= int(share.max(initial=1))) & (F.col("nth") <= _by_number(share.tolist(), F.col("group"))))
        .orderBy("group", "nth").select("group", "vector").toArrow()
    )
    members = np.bincount(seeds.column("group").to_numpy(), minlength=len(groups))
    kept = members > 0
    first = np.concatenate([[0], np.cumsum(members[kept])]).astype(np.int64)
    groups = groups[kept]
    leaves = _rounds(
        sample, _unit(_matrix(seeds.column("vector"))), lambda means, units: Tree(groups, first, means).assign(units), rounds
    )
    return Tree(groups, first, leaves)


def _words_of(pieces: np.ndarray, rounds: int) -> np.ndarray:
    """``CODES`` means of the pieces of one part, by Lloyd rounds; fewer pieces repeat the last."""
    words = pieces[:CODES]
    words = np.concatenate([words, np.repeat(words[-1:], CODES - len(words), axis=0)])
    for _ in range(rounds):
        own = (2 * pieces @ words.T - np.einsum("ij,ij->i", words, words)).argmax(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, own, pieces)
        n = np.bincount(own, minlength=CODES)[:, None]
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return words


def learn_codes(sample: DataFrame, tree: Tree, rounds: int = 2 * ROUNDS) -> Codes:
    """Code words of every part, each learned by its own task from ``CODE_SAMPLE`` rows at most."""
    dims = tree.cells.shape[1]
    parts = -(-dims // VALUES_PER_CODE)
    shared = sample.sparkSession.sparkContext.broadcast(tree)
    none = Codes(np.zeros((parts, CODES, VALUES_PER_CODE)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units, tree = _unit(_matrix(batch.column("vector"))), shared.value
                split = none.split(units - tree.cells[tree.assign(units)])
                for part in range(parts):
                    yield pa.RecordBatch.from_pydict({
                        "part": np.full(len(units), part, np.int32), "piece": pa.array(split[:, part].tolist(), pa.list_(pa.float64())),
                    })

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        words = _words_of(_matrix(part["piece"]), rounds)
        return pd.DataFrame({"part": part["part"].iloc[:1], "words": [words.ravel()]})

    some = sample.orderBy(F.xxhash64("id"), "id").limit(CODE_SAMPLE)
    learned = (
        some.select("vector").mapInArrow(pieces, "part int, piece array<double>")
        .groupBy("part").applyInPandas(learn, "part int, words array<double>").orderBy("part").toArrow()
    )
    return Codes(_matrix(learned.column("words")).reshape(parts, CODES, VALUES_PER_CODE))


# --- writing --------------------------------------------------------------------


def _placed(rows: DataFrame, tree: Tree, codes: Codes) -> DataFrame:
    """(id, vector, code, distance, cell) of rows (id, vector) that have a direction."""
    shared = rows.sparkSession.sparkContext.broadcast((tree, codes))
    schema = T.StructType([
        rows.schema["id"], rows.schema["vector"], T.StructField("code", T.BinaryType()),
        T.StructField("distance", T.DoubleType()), T.StructField("cell", T.IntegerType()),
    ])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, codes = shared.value
        for batch in batches:
            if batch.num_rows:
                units = _unit(_matrix(batch.column("vector")))
                cell = tree.assign(units)
                rest = units - tree.cells[cell]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), batch.column("vector"),
                    pa.array([row.tobytes() for row in codes.encode(rest)], pa.binary()),
                    pa.array(np.linalg.norm(rest, axis=1)), pa.array(cell.astype(np.int32)),
                ], names=schema.fieldNames())

    return rows.select("id", "vector").mapInArrow(place, schema)


def _write_rows(placed: DataFrame, folder: str, generation: int) -> dict[int, tuple[int, float]]:
    """Write rows by cell; a large cell is written by several tasks. Rows and radius per cell."""
    path = f"{folder}/rows/generation={generation}"
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    try:
        written = placed.sparkSession.read.parquet(path)
    except AnalysisException:  # no rows, no files
        return {}
    measured = written.groupBy("cell").agg(F.count("*").alias("rows"), F.max("distance").alias("radius"))
    return {r["cell"]: (r["rows"], r["radius"]) for r in measured.collect()}  # at most one row per cell


def _write_model(spark: SparkSession, folder: str, generation: int, tree: Tree, codes: Codes) -> None:
    group = np.repeat(np.arange(len(tree.groups)), np.diff(tree.first))
    pieces = [("group", i, i, row.tolist()) for i, row in enumerate(tree.groups)]
    pieces += [("cell", i, int(g), row.tolist()) for i, (g, row) in enumerate(zip(group, tree.cells))]
    pieces += [("code", i, i, row.ravel().tolist()) for i, row in enumerate(codes.words)]
    table = spark.createDataFrame(pieces, "kind string, number int, of int, mean array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/learned/generation={generation}")


def _write_manifest(spark: SparkSession, folder: str, now: Stored) -> None:
    facts = (now.learned, now.learned_rows, now.changed)
    rows = [(-1, 0, 0, 0.0, *facts)]
    rows += [(i, int(g), int(n), float(r), *facts) for i, (g, n, r) in enumerate(zip(now.of, now.rows, now.radius))]
    table = spark.createDataFrame(
        rows, "cell int, of int, rows long, radius double, learned int, learned_rows long, changed long"
    )
    # One file: a generation is there as a whole or not at all.
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/generation={now.generation}")


def build_index(
    index: DataFrame, folder: str, cells: int | None = None, key: str = "id", vector: str = "vector"
) -> Stored:
    """Learn cells and codes and store every row that has a direction.

    Keys must be unique (raises otherwise). Rows whose vector is null, of length zero or not
    finite have no direction and are not stored. By default there are as many cells as rows
    in a cell, ``MOST_CELLS`` at most. In a folder that holds an index already, the new one
    becomes its next generation.
    """
    spark = index.sparkSession
    require_unique(index, key)
    usable = _with_direction(_named(index, key, vector, "id"))
    return _learn_and_write(spark, usable, folder, cells, _newest(spark, folder) + 1)


def _learn_and_write(spark: SparkSession, usable: DataFrame, folder: str, cells: int | None, generation: int) -> Stored:
    rows = usable.count()
    cells = max(1, min(cells or math.isqrt(rows), MOST_CELLS))
    if rows == 0:
        nothing = np.zeros((0, 1))
        tree, codes = Tree(nothing, np.zeros(1, np.int64), nothing), Codes(np.zeros((1, CODES, VALUES_PER_CODE)))
        stored = {}
    else:
        units = 1 << 30
        wanted = min(1.0, 1.2 * SAMPLE_PER_CELL * cells / rows)
        some = usable.where(F.pmod(F.xxhash64("id", F.lit(generation)), F.lit(units)) < int(wanted * units))
        sample = save_parquet(some, work_dir(spark, "sample"))
        if sample.limit(1).count() == 0:  # a tiny table whose hashes all lie high
            sample = save_parquet(usable.limit(SAMPLE_PER_CELL * cells), work_dir(spark, "sample"))
        tree = learn_tree(sample, cells)
        codes = learn_codes(sample, tree)
        stored = _write_rows(_placed(usable, tree, codes), folder, generation)
    n = len(tree.cells)
    now = Stored(
        generation, generation, rows, 0, tree, codes, np.full(n, generation),
        np.array([stored.get(i, (0, 0.0))[0] for i in range(n)], np.int64),
        np.array([stored.get(i, (0, 0.0))[1] for i in range(n)]),
    )
    _write_model(spark, folder, generation, tree, codes)
    _write_manifest(spark, folder, now)
    return now


def _newest(spark: SparkSession, folder: str) -> int:
    try:
        manifests = spark.read.parquet(f"{folder}/manifest")
    except AnalysisException:
        return -1
    return manifests.where("cell = -1").agg(F.max("generation").alias("newest")).first()["newest"]


def open_index(spark: SparkSession, folder: str) -> Stored:
    """The newest generation; what it reads grows with the number of cells only."""
    generation = _newest(spark, folder)
    if generation < 0:
        raise FileNotFoundError(f"no index in {folder}")
    table = spark.read.parquet(f"{folder}/manifest/generation={generation}").orderBy("cell").toPandas()
    learned = int(table["learned"].iloc[0])
    model = spark.read.parquet(f"{folder}/learned/generation={learned}").orderBy("kind", "number").toPandas()
    part = {kind: rows for kind, rows in model.groupby("kind")}
    means = lambda kind: np.stack(part[kind]["mean"].to_list()) if kind in part else np.zeros((0, 1))
    counts = np.bincount(part["cell"]["of"], minlength=len(part["group"])) if "cell" in part else np.zeros(0, np.int64)
    tree = Tree(means("group"), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), means("cell"))
    cell = table.iloc[1:]
    return Stored(
        generation, learned, int(table["learned_rows"].iloc[0]), int(table["changed"].iloc[0]), tree,
        Codes(means("code").reshape(-1, CODES, VALUES_PER_CODE)),
        cell["of"].to_numpy(), cell["rows"].to_numpy(), cell["radius"].to_numpy(),
    )


def stored_rows(spark: SparkSession, folder: str, now: Stored, cells: np.ndarray | None = None) -> DataFrame | None:
    """(id, vector, code, distance, cell) of the given cells, all by default; None without rows.

    Only the folders of these cells in their own generations are read.
    """
    wanted = np.flatnonzero(now.rows > 0) if cells is None else np.array([c for c in cells if now.rows[c] > 0], int)
    if len(wanted) == 0:
        return None
    which = F.lit(False)
    for generation in np.unique(now.of[wanted]):
        own = [int(c) for c in wanted[now.of[wanted] == generation]]
        which = which | ((F.col("generation") == int(generation)) & F.col("cell").isin(own))
    return spark.read.parquet(f"{folder}/rows").where(which).drop("generation")


def _sent(df: DataFrame, rows: int = SENT_IDS) -> DataFrame:
    """A saved table of ids with a broadcast hint if it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def apply_changes(
    changes: DataFrame, folder: str, key: str = "id", vector: str = "vector", change: str = "change_type"
) -> dict[str, int]:
    """Bring the stored index in step with a change list; returns what was done.

    ``changes`` has the key, the new vector and ``insert``, ``update`` or ``delete``, one row
    per key (raises otherwise). The vector of a deleted row is not looked at; a row whose new
    vector has no direction leaves the index. The cells that changed rows lie in or come to
    are rewritten, no other file is read for its vectors or touched. A change list that was
    applied before changes nothing but the generation's number. When more than
    ``RETRAIN_SHARE`` of the rows changed since cells were learned, or a cell
    holds ``UNEVEN`` times its even share, cells and codes are learned anew.
    """
    spark = changes.sparkSession
    now = open_index(spark, folder)
    listed = save_parquet(
        changes.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(change).alias("change")),
        work_dir(spark, "changes"),
    )
    require_unique(listed, "id")
    ids, generation = _sent(listed.select("id")), now.generation + 1
    fresh = _with_direction(_named(listed.where("change != 'delete'"), "id", "vector", "id"))
    changed = now.changed + listed.count()
    if now.learned_rows == 0 or changed > RETRAIN_SHARE * now.learned_rows:
        return _relearn(spark, folder, now, ids, fresh)
    placed = save_parquet(_placed(fresh, now.tree, now.codes), work_dir(spark, "placed"))
    # Where the rows to replace lie: only ids are read.
    every = stored_rows(spark, folder, now)
    gone = every.select("id", "cell").join(ids, "id", "left_semi") if every is not None else placed.select("id", "cell").limit(0)
    gone = save_parquet(gone, f"{folder}/removed/generation={generation}")
    touched = gone.select("cell").union(placed.select("cell")).distinct().collect()  # at most every cell
    cells = np.array(sorted(r["cell"] for r in touched), int)
    before = stored_rows(spark, folder, now, cells)
    after = placed
    if before is not None:
        after = before.join(_sent(gone.select("id")), "id", "left_anti").select(*placed.columns).unionByName(placed)
    written = _write_rows(after, folder, generation)
    of, rows, radius = now.of.copy(), now.rows.copy(), now.radius.copy()
    of[cells] = generation
    for c in cells:
        rows[c], radius[c] = written.get(int(c), (0, 0.0))
    if len(rows) > 1 and rows.max() > UNEVEN * max(1, rows.sum() / len(rows)) and now.rows.max() < rows.max():
        return _relearn(spark, folder, now, ids, fresh)
    _write_manifest(spark, folder, Stored(
        generation, now.learned, now.learned_rows, changed, now.tree, now.codes, of, rows, radius
    ))
    return {"generation": generation, "cells_rewritten": len(cells), "relearned": 0, "rows": int(rows.sum())}


def _relearn(spark: SparkSession, folder: str, now: Stored, ids: DataFrame, fresh: DataFrame) -> dict[str, int]:
    every = stored_rows(spark, folder, now)
    rows = fresh if every is None else every.select("id", "vector").join(ids, "id", "left_anti").unionByName(fresh)
    new = _learn_and_write(spark, save_parquet(rows, work_dir(spark, "current")), folder, None, now.generation + 1)
    return {
        "generation": new.generation, "cells_rewritten": len(new.rows), "relearned": 1, "rows": int(new.rows.sum()),
    }


# --- lookups --------------------------------------------------------------------


def _routed(queries: DataFrame, now: Stored, k: int, probes: int | None) -> DataFrame:
    """(query_id, vector, cell): every query once for each cell that it visits."""
    shared = queries.sparkSession.sparkContext.broadcast((now.tree, now.rows, now.radius))

    @F.pandas_udf("array<int>")
    def cells_for(vectors: pd.Series) -> pd.Series:
        tree, rows, radius = shared.value
        matrix = _matrix(vectors)
        if probes is not None:
            return pd.Series(tree.nearest(_unit(matrix), probes, rows))
        return pd.Series(Cells(tree.cells, rows, radius).visits(matrix, k, None))

    return queries.select("query_id", "vector", F.explode(cells_for("vector")).alias("cell"))


def _in_blocks(
    routed: DataFrame, rows: DataFrame, held: np.ndarray, block_rows: int,
    compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType,
) -> DataFrame:
    """Compare the queries of each cell with its rows, both cut into blocks of bounded size."""
    asked = np.zeros(len(held), np.int64)
    for row in routed.groupBy("cell").count().collect():  # at most one row per cell
        asked[row["cell"]] = row["count"]
    row_blocks = np.maximum(1, -(-held // block_rows)).tolist()
    query_blocks = np.maximum(1, -(-asked // block_rows)).tolist()

    def block(column: str, blocks: list[int]) -> Column:
        return F.pmod(F.xxhash64(column), _by_number(blocks, F.col("cell"))).cast("int")

    def numbers(blocks: list[int]) -> Column:
        return F.explode(F.sequence(F.lit(0), _by_number(blocks, F.col("cell")) - 1))

    left = routed.withColumn("query_block", block("query_id", query_blocks)).withColumn("row_block", numbers(row_blocks))
    right = rows.withColumn("row_block", block("id", row_blocks)).withColumn("query_block", numbers(query_blocks))
    blocks = ["cell", "query_block", "row_block"]
    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(compare, schema)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return candidates.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def shortlist(
    queries: DataFrame, folder: str, probes: int, wanted: int, now: Stored, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The ``wanted`` nearest rows by their codes of every query, and the routes of the queries.

    Reads ids and codes of the probed cells, no vectors. Both tables are saved.
    """
    spark = queries.sparkSession
    routed = save_parquet(_routed(queries, now, wanted, probes), work_dir(spark, "routed"))
    visited = np.array([r["cell"] for r in routed.select("cell").distinct().collect()], int)
    rows = stored_rows(spark, folder, now, visited).select("id", "code", "cell")
    shared = spark.sparkContext.broadcast((now.tree, now.codes))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([
        queries.schema["query_id"], rows.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("cell", T.IntegerType()),
    ])

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({name: [] for name in schema.fieldNames()})
        tree, codes = shared.value
        cell, ids = int(q["cell"].iloc[0]), _ids(x["id"], id_type)
        order = np.argsort(ids, kind="stable")
        code = np.frombuffer(b"".join(x["code"].iloc[order]), np.uint8).reshape(len(x), -1)
        units = (tree.cells[cell] + codes.decode(code, tree.cells.shape[1])).astype(np.float32).T
        asked, out = _unit(_matrix(q["vector"])).astype(np.float32), []
        step = max(1, PAIR_VALUES // len(x))
        for start in range(0, len(asked), step):
            near = asked[start:start + step] @ units
            top = (-near).argsort(axis=1, kind="stable")[:, :wanted]
            query = np.repeat(np.arange(start, start + len(near)), top.shape[1])
            out.append((query, top.ravel(), np.take_along_axis(near, top, axis=1).ravel()))
        query, row, score = (np.concatenate(part) for part in zip(*out))
        return pd.DataFrame({
            "query_id": q["query_id"].to_numpy()[query], "id": ids[order][row], "score": score.astype(float), "cell": cell,
        })

    found = _in_blocks(routed, rows, now.rows, block_rows, compare, schema)
    return save_parquet(_best(found, wanted).drop("rank"), work_dir(spark, "shortlist")), routed


def _rescored(listed: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id, score) of listed pairs by their full vectors."""

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        a, b = _matrix(left), _matrix(right)
        dots = np.einsum("ij,ij->i", a, b)
        norms = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        return pd.Series(np.rint(dots / norms * SCORE_UNITS) / SCORE_UNITS)

    pairs = rows.select("id", F.col("vector").alias("_row")).join(_sent(listed.select("query_id", "id")), "id")
    return pairs.join(queries, "query_id").select("query_id", "id", score("vector", "_row").alias("score"))


def lookup(
    queries: DataFrame, folder: str, k: int = TOP_K, probes: int | None = None, wanted: int | None = None,
    query_id: str = "query_id", vector: str = "vector", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest stored rows of every query: (query_id, rank, id, score).

    With ``probes`` it is approximate: codes of that many cells are scanned and the ``wanted``
    (ten times k by default) nearest are compared with full vectors. Without, it is exact.
    Query ids are unique; queries without direction find nothing. Ties go to the smaller id.
    """
    spark = queries.sparkSession
    now = open_index(spark, folder)
    named = _with_direction(_named(queries, query_id, vector, "query_id"))
    if now.rows.sum() == 0:
        try:
            kind = spark.read.parquet(f"{folder}/rows").schema["id"].dataType
        except AnalysisException:  # there never were rows
            kind = T.LongType()
        return spark.createDataFrame([], T.StructType([
            named.schema["query_id"], T.StructField("rank", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.DoubleType()),
        ]))
    if probes is not None:
        listed, _ = shortlist(named, folder, probes, wanted or 10 * k, now, block_rows)
        visited = np.array([r["cell"] for r in listed.select("cell").distinct().collect()], int)
        rows = stored_rows(spark, folder, now, visited)
        found = listed.limit(0).select("query_id", "id", "score") if rows is None else _rescored(listed, named, rows)
        return _best(found, k).select("query_id", "rank", "id", "score")
    routed = save_parquet(_routed(named, now, k, None), work_dir(spark, "routed"))
    visited = np.array([r["cell"] for r in routed.select("cell").distinct().collect()], int)
    rows = stored_rows(spark, folder, now, visited)
    if rows is None:
        rows = stored_rows(spark, folder, now)
    rows = rows.select("id", "vector", "cell")
    id_type = rows.schema["id"].dataType
    schema = T.StructType([named.schema["query_id"], rows.schema["id"], T.StructField("score", T.DoubleType())])

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({name: [] for name in schema.fieldNames()})
        best = _block_best(_matrix(q["vector"]), _ids(x["id"], id_type), _matrix(x["vector"]), k)
        return pd.DataFrame({
            "query_id": q["query_id"].to_numpy()[best.query], "id": best.ids, "score": best.units / SCORE_UNITS,
        })

    found = _in_blocks(routed, rows, now.rows, block_rows, compare, schema)
    return _best(found, k).select("query_id", "rank", "id", "score")


def with_effort(result: DataFrame, routed: DataFrame, listed: DataFrame, now: Stored) -> DataFrame:
    """Add ``scanned`` and ``compared``: the shares of stored codes and of full vectors that a query visits on average."""
    every = float(max(1, int(now.rows.sum()) * routed.select("query_id").distinct().count()))
    codes = routed.agg(F.sum(_by_number(now.rows.tolist(), F.col("cell")))).first()[0]
    return result.withColumns({"scanned": F.lit((codes or 0) / every), "compared": F.lit(listed.count() / every)})
