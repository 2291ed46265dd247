import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions.embedding import hashed_words
from passagework.operators.vectors import (
    embed,
    knn_join,
    nearest_to,
    recall,
    require_unique,
    train_cells,
)


def brute_force(queries, index, k, exclude_self=False):
    found = {}
    for qid, q in queries:
        scored = []
        for id_, v in index:
            norm = np.sqrt(np.dot(q, q) * np.dot(v, v))
            if norm > 0 and not (exclude_self and id_ == qid):
                scored.append((-round(float(np.dot(q, v) / norm), 9), id_))
        found[qid] = [id_ for _, id_ in sorted(scored)[:k]]
    return found


def table(spark, rows, id_type="long"):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in rows], f"id {id_type}, vector array<float>"
    )


def as_lists(result):
    found = {}
    for r in result.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    return found


@pytest.fixture(scope="module")
def data():
    """Clusters of unequal size, exact copies, small integers with many ties, zero vectors."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 12))
    rows = [centres[0] + 0.05 * rng.normal(size=12) for _ in range(120)]
    rows += [centres[i % 5] + 0.3 * rng.normal(size=12) for i in range(80)]
    rows += [rng.integers(0, 2, size=12) for _ in range(60)]
    rows += [rows[3]] * 90 + [np.zeros(12)] * 3
    rows = [np.asarray(r, dtype=np.float32).astype(np.float64) for r in rows]
    return list(enumerate(rows))


WAYS = {
    "queries sent": {},
    "by cells": {"broadcast_queries": 0, "cells": 7, "block_rows": 1000},
    "small blocks": {"broadcast_queries": 0, "cells": 4, "block_rows": 16},
    "one cell": {"broadcast_queries": 0, "cells": 1, "block_rows": 40},
}


@pytest.mark.parametrize("way", WAYS)
def test_exact_whatever_the_way(spark, data, way):
    queries, index = data[::3], data
    got = knn_join(
        table(spark, queries), table(spark, index).repartition(5), 6, query_id="id", **WAYS[way]
    )
    expected = {q: ids for q, ids in brute_force(queries, index, 6).items() if ids}
    assert as_lists(got) == expected


@pytest.mark.parametrize("way", ["queries sent", "small blocks"])
def test_exclude_self_and_text_ids(spark, data, way):
    rows = [(f"p{i:03}", v) for i, v in data]
    frame = table(spark, rows, "string")
    got = knn_join(frame, frame, 3, query_id="id", exclude_self=True, **WAYS[way])
    expected = {q: ids for q, ids in brute_force(rows, rows, 3, True).items() if ids}
    assert as_lists(got) == expected


def test_fewer_rows_than_k_and_empty_sides(spark, data):
    few = table(spark, data[:3])
    assert all(len(ids) == 3 for ids in as_lists(knn_join(few, few, 5, query_id="id")).values())
    none = few.filter("id < 0")
    for way in WAYS.values():
        assert knn_join(none, few, 5, query_id="id", **way).count() == 0
        assert knn_join(few, none, 5, query_id="id", **way).count() == 0
        assert knn_join(few, none, 5, query_id="id", **way).columns == ["query_id", "rank", "id", "score"]


def test_null_vectors_are_not_retrieved(spark, data):
    rows = table(spark, data[:20]).unionByName(
        spark.createDataFrame([(999, None)], "id long, vector array<float>")
    )
    for way in WAYS.values():
        found = as_lists(knn_join(rows, rows, 30, query_id="id", **way))
        assert 999 not in found and all(999 not in ids for ids in found.values())


def test_probing_every_cell_finds_everything(spark, data):
    frame = table(spark, data)
    truth = knn_join(frame, frame, 4, query_id="id")
    full = recall(knn_join(frame, frame, 4, query_id="id", probes=8, cells=8), truth).first()
    assert full["recall"] == 1.0
    some = recall(knn_join(frame, frame, 4, query_id="id", probes=2, cells=8), truth).first()
    assert 0.5 <= some["recall"] <= 1.0


def test_trained_cells_can_be_kept(spark, data):
    frame = table(spark, data)
    cells = train_cells(frame, 6)
    assert cells.rows.sum() == len(data) - 3
    again = knn_join(frame, frame, 3, query_id="id", cells=cells, broadcast_queries=0)
    assert as_lists(again) == as_lists(knn_join(frame, frame, 3, query_id="id"))


def test_cells_prune_separate_clusters(data):
    from passagework.operators.vectors import Cells

    pivots = np.eye(4)
    cells = Cells(pivots, np.array([10, 10, 10, 10]), np.full(4, 0.1))
    chosen = cells.reachable(np.eye(4)[:1] + 0.001, 5)
    assert chosen.tolist() == [[True, False, False, False]]


def test_one_query(spark, data):
    got = nearest_to(table(spark, data), list(data[5][1]), 4)
    assert got.columns == ["id", "score"]
    assert [r["id"] for r in got.collect()] == brute_force(data[5:6], data, 4)[5]


def test_embedding_does_not_depend_on_batches(spark):
    rows = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(50)], "id int, text string")
    one = embed(rows.coalesce(1), F.col("text"), hashed_words(16))
    many = embed(rows.repartition(8), F.col("text"), hashed_words(16))
    assert one.exceptAll(many).count() == 0
    assert one.filter(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x) != 2).count() == 0
    blank = embed(spark.createDataFrame([(1, None)], "id int, text string"), F.col("text"), hashed_words(4))
    assert blank.first()["vector"] == [0.0] * 4


def test_model_runs_once_below_a_filter(spark):
    rows = spark.createDataFrame([(1, "a b")], "id int, text string")
    filtered = embed(rows, F.col("text"), hashed_words(4)).filter(F.size("vector") == 4)
    assert filtered._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_keys_must_be_unique(spark):
    frame = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    with pytest.raises(ValueError):
        require_unique(frame, "id")
    assert require_unique(frame.distinct(), "id").count() == 2


def test_pairs_are_scored_in_slices(monkeypatch):
    from passagework.operators import vectors

    rng = np.random.default_rng(3)
    block = np.concatenate([rng.normal(size=(40, 8)), np.tile(rng.normal(size=8), (200, 1))])
    ids = rng.permutation(240)
    whole = vectors._block_best(block, ids, block, 5)
    monkeypatch.setattr(vectors, "PAIR_VALUES", 100)
    sliced = vectors._block_best(block, ids, block, 5)
    assert (whole.ids == sliced.ids).all() and (whole.units == sliced.units).all()
    expected = brute_force(list(enumerate(block)), list(zip(ids.tolist(), block)), 5)
    got = {q: whole.ids[whole.query == q].tolist() for q in range(240)}
    assert got == expected


@pytest.mark.parametrize("way", WAYS)
def test_odd_vectors_and_near_ties(spark, way):
    """Vectors without direction change nothing; scores that round alike tie, wherever they lie."""
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    ties = [(101, [float(np.cos(2e-5)), float(np.sin(2e-5)), 0.0, 0.0]), (105, [1.0, 0.0, 0.0, 0.0])]
    nan, inf = float("nan"), float("inf")
    odd = [(200, [nan, 1.0, 0.0, 0.0]), (201, [inf, 0.0, 0.0, 0.0]), (202, [-inf, 1.0, nan, 0.0]),
           (203, [0.0] * 4), (204, None), (205, [None, 1.0, 1.0, 1.0])]
    kind = "id long, vector array<double>"
    clean = spark.createDataFrame(good + ties, kind)
    mixed = spark.createDataFrame(good + ties + odd, kind)
    options = {**WAYS[way]}
    wanted = as_lists(knn_join(clean, clean, 3, query_id="id"))
    assert as_lists(knn_join(mixed, mixed, 3, query_id="id", **options)) == wanted
    assert wanted[105][:2] == [101, 105]


def test_lengths_must_agree(spark):
    kind = "id long, vector array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], kind)
    ragged = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0, 0.0])], kind).coalesce(1)
    with pytest.raises(Exception, match="lengths|matmul|mismatch"):
        knn_join(queries, ragged, 1, query_id="id").collect()


def test_one_query_ignores_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [0.0, 0.0])], "id long, vector array<double>")
    assert [r["id"] for r in nearest_to(rows, [1.0, 1.0], 3).collect()] == [1]


def test_stored_index_reads_the_cells_it_probes(spark, data, tmp_path):
    from passagework.operators.vectors import lookup, write_index

    frame = table(spark, data)
    write_index(frame, str(tmp_path), 6)
    exact = as_lists(knn_join(frame, frame, 3, query_id="id"))
    assert as_lists(lookup(frame, str(tmp_path), 3, query_id="id")) == exact
    near = lookup(frame.filter("id = 5"), str(tmp_path), 3, probes=1, query_id="id")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan)
    with pytest.raises(ValueError):
        write_index(frame.union(frame), str(tmp_path / "twice"), 6)


@pytest.mark.parametrize("tile_rows, block_rows", [(16, 16), (64, 16), (1 << 17, 16)])
def test_tiles_of_any_size_find_the_same(spark, data, monkeypatch, tile_rows, block_rows):
    from passagework.operators import vectors

    monkeypatch.setattr(vectors, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(vectors, "TILES_PER_SLOT", 0)
    monkeypatch.setattr(vectors, "MANY_FOUND", 0)
    got = knn_join(table(spark, data[::3]), table(spark, data), 6, query_id="id", broadcast_queries=0, cells=7, block_rows=block_rows)
    assert as_lists(got) == {q: ids for q, ids in brute_force(data[::3], data, 6).items() if ids}


def test_a_vector_is_not_sent_for_every_block(spark):
    """Blocks bound what is compared at a time; tiles, which are far larger, what is shuffled."""
    from passagework.operators import vectors

    assert vectors._tile_rows(600_000, 600_000, 64, 12, 512) == vectors._tile_rows(600_000, 600_000, 64, 12, 8192) > 80_000
    assert vectors._tile_rows(6_000_000, 6_000_000, 64, 12, 512) == vectors.TILE_ROWS
    assert vectors._tile_rows(6_000_000, 6_000_000, 1536, 12, 512) * 1536 <= vectors.TILE_VALUES
    first, number = vectors._tiles(np.array([3, 4, 30, 2, 0, 9]), 10, True)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and number.tolist() == [1, 1, 3, 1, 1, 1]
    first, number = vectors._tiles(np.array([3, 30, 2]), 10, False)
    assert first.tolist() == [0, 1, 4] and number.tolist() == [1, 3, 1]


@pytest.mark.parametrize("strip_rows, k", [(1, 5), (16, 5), (128, 5), (128, 400)])
def test_strips_leave_nothing_out(data, monkeypatch, strip_rows, k):
    """The best of every strip bounds what is looked into; the last strip may be short, and k beyond the strips."""
    from passagework.operators import vectors

    monkeypatch.setattr(vectors, "STRIP_ROWS", strip_rows)
    ids = np.array([i for i, _ in data])
    block = np.stack([v for _, v in data])
    for block_rows in (100, 1000):
        best = vectors._block_best(block[::7], ids, block, k, block_rows)
        got = {q: best.ids[best.query == n].tolist() for n, (q, _) in enumerate(data[::7])}
        assert got == brute_force(data[::7], data, k)


def test_pairs_of_tiles_are_shared_out(spark, monkeypatch):
    """Tiles are few bytes and much work; joining partitions by size left slots idle."""
    from passagework.operators import vectors

    monkeypatch.setattr(vectors, "TILE_ROWS", 50)
    monkeypatch.setattr(vectors, "TILES_PER_SLOT", 0)
    rng = np.random.default_rng(5)
    frame = table(spark, list(enumerate(rng.normal(size=(400, 8)))))
    named = frame.select(F.col("id").alias("query_id"), "vector")
    schema = vectors._result_schema(named.schema["query_id"].dataType, frame.schema["id"].dataType)
    found = vectors._join_by_cells(named, frame, 3, schema, train_cells(frame, 1), None, 16)
    tasks = found.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert tasks > 32  # of 64 pairs; one when partitions are joined by size
    assert found.select("query_id").distinct().count() == 400


def counts_near_and_far(rng, rows, dims=24):
    """Counts of very different lengths, with copies, ties and rows that share nothing with others."""
    values = rng.poisson(rng.choice([0.1, 1, 4], size=(rows, 1)), size=(rows, dims))
    values[rows // 3:rows // 3 + 40] = values[0]
    values[::50] *= rng.choice([1, 30, 100], size=(len(values[::50]), 1))
    values[7::90] = 0
    values[8::90] = np.eye(dims, dtype=int)[rng.integers(0, dims, len(values[8::90]))]
    return values.astype(np.float32)


@pytest.mark.parametrize("k, rows, seed_part", [(1, 400, 4), (5, 130, 64), (5, 1000, 7), (60, 400, 64), (500, 400, 2)])
@pytest.mark.parametrize("dtype", [np.float32, np.float64])
def test_counts_by_packed_products_equal_brute_force(monkeypatch, k, rows, seed_part, dtype):
    """Two or three index rows share a column of a product; every pair of blocks takes what its lengths allow."""
    from passagework.operators import vectors

    used = set()
    pack = vectors._pack
    monkeypatch.setattr(vectors, "_pack", lambda block, lanes: (used.add(lanes), pack(block, lanes))[1])
    monkeypatch.setattr(vectors, "PACKED_COLUMNS", 32)
    monkeypatch.setattr(vectors, "LEAST_PACKED", 1)
    monkeypatch.setattr(vectors, "QUERY_STEP", 16)
    monkeypatch.setattr(vectors, "SEED_PART", seed_part)
    rng = np.random.default_rng(rows + k)
    index = list(zip(rng.permutation(rows).tolist(), counts_near_and_far(rng, rows).astype(dtype)))
    queries = list(enumerate(counts_near_and_far(rng, 150).astype(dtype)))
    # Of a query that shares nothing with an index row, all pairs score 0.
    best = vectors._block_best(
        np.stack([v for _, v in queries]), np.array([i for i, _ in index]), np.stack([v for _, v in index]), k
    )
    got = {q: best.ids[best.query == q].tolist() for q, v in queries if v.any()}
    wanted = {q: ids for q, ids in brute_force(
        [(q, v.astype(np.float64)) for q, v in queries if v.any()], [(i, v.astype(np.float64)) for i, v in index], k
    ).items()}
    assert got == wanted
    assert used == {1, 2, 3}


def test_values_that_are_no_small_counts_are_compared_as_before(monkeypatch):
    from passagework.operators import vectors

    monkeypatch.setattr(vectors, "LEAST_PACKED", 1)
    monkeypatch.setattr(vectors, "_best_of_counts", None)
    counts = np.random.default_rng(2).poisson(2, size=(200, 8)).astype(np.float64)
    for block in (-counts, counts + 0.5, counts * 4096):
        rows = list(enumerate(block))
        best = vectors._block_best(block, np.arange(200), block, 4)
        assert {q: best.ids[best.query == q].tolist() for q, v in rows if v.any()} == {
            q: ids for q, ids in brute_force(rows, rows, 4).items() if ids
        }
