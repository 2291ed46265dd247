"""The stored, quantised index: recall, exact lookups, change lists and bounded work."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import inverted, vectors
from passagework.operators.vectors import knn_join, recall


def sets(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())


def made(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id {kind}, vector array<float>").repartition(4)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 10)) * 3
    rows = [(i, [float(x) for x in centres[i % 12 if i % 3 else 0] + rng.normal(size=10)]) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # copies tie
    return rows


def files(folder):
    found = {}
    for base, _, names in os.walk(os.path.join(folder, "rows")):
        for name in names:
            if name.endswith(".parquet"):
                path = os.path.join(base, name)
                found[path] = os.stat(path).st_mtime_ns
    return found


def test_exact_lookup_and_changes(spark, tmp_path, clustered):
    folder = str(tmp_path / "index")
    now = inverted.build_index(made(spark, clustered), folder, cells=30)
    assert now.rows.sum() == len(clustered) and 10 <= len(now.rows) <= 40
    asked = made(spark, clustered[::9]).withColumnRenamed("id", "query_id")
    assert sets(inverted.lookup(asked, folder, 7)) == sets(knn_join(asked, made(spark, clustered), 7))

    # A few rows near one another change: only their cells are written anew.
    held, before = dict(clustered), files(folder)
    near = [i for i in held if i < 900 and i % 3 and i % 12 == 7][:20]
    listed = [(i, None, "delete") for i in near[:8]] + [(i, [x + 0.01 for x in held[i]], "update") for i in near[8:14]]
    listed += [(5000 + i, held[i], "insert") for i in near[14:]] + [(77777, None, "delete"), (88888, [0.0] * 10, "insert"), (near[14], None, "update")]
    changes = spark.createDataFrame(listed, "id long, vector array<float>, change_type string")
    done = inverted.apply_changes(changes, folder)
    assert done["generation"] == 1 and done["relearned"] == 0 and 0 < done["cells_rewritten"] < len(now.rows) / 2
    for id, vector, kind in listed:
        held.pop(id, None)
        if kind != "delete" and vector and any(vector):
            held[id] = vector
    current = made(spark, list(held.items()))
    truth = sets(knn_join(asked, current, 7))
    assert sets(inverted.lookup(asked, folder, 7)) == truth
    after = files(folder)
    assert {p: after[p] for p in before} == before and len(after) > len(before)

    # The same list again changes nothing.
    again = inverted.apply_changes(changes, folder)
    assert again["generation"] == 2 and again["rows"] == done["rows"] == len(held)
    assert sets(inverted.lookup(asked, folder, 7)) == truth
    # A part-written generation is not seen, and is replaced by the next attempt.
    made(spark, clustered[:50]).withColumns({"code": F.lit(b"x"), "distance": F.lit(0.0), "cell": F.lit(3)}).write.partitionBy(
        "cell").parquet(f"{folder}/rows/generation=3")
    assert sets(inverted.lookup(asked, folder, 7)) == truth
    # Many changes: cells are learned anew.
    many = spark.createDataFrame([(i, v, "update") for i, v in list(held.items())[:600]], changes.schema)
    relearned = inverted.apply_changes(many, folder)
    assert relearned["relearned"] == 1 and relearned["rows"] == len(held)
    assert sets(inverted.lookup(asked, folder, 7)) == truth


def test_recall_and_effort(spark, tmp_path, clustered):
    folder = str(tmp_path / "index")
    now = inverted.build_index(made(spark, clustered), folder, cells=30)
    asked = made(spark, clustered).withColumnRenamed("id", "query_id")
    found = inverted.lookup(asked, folder, 5, probes=8, wanted=80)
    listed, routed = inverted.shortlist(asked, folder, 8, 80, now)
    row = inverted.with_effort(recall(found, knn_join(asked, made(spark, clustered), 5)), routed, listed, now).first()
    assert row["recall"] >= 0.9 and row["compared"] <= 0.25 and row["scanned"] < 0.6


def test_recall_on_the_table(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    folder = str(tmp_path / "index")
    now = inverted.build_index(rows, folder, cells=32)
    asked = rows.withColumnRenamed("id", "query_id")
    others = lambda df: df.filter("id != query_id")
    listed, routed = inverted.shortlist(asked, folder, 24, 60, now)
    found = recall(others(inverted.lookup(asked, folder, 6, probes=24, wanted=60)), others(knn_join(asked, rows, 6)))
    row = inverted.with_effort(found, routed, listed, now).first()
    assert row["recall"] >= 0.9 and row["compared"] <= 0.25


def test_odd_rows(spark, tmp_path):
    folder = str(tmp_path / "index")
    odd = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [float("nan"), 1.0]), ("e", [1.0, 1e-3]), ("f", [None, 1.0])]
    now = inverted.build_index(made(spark, odd, "string"), folder)
    assert now.rows.sum() == 2
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, vector array<float>")
    for probes in (None, 1):
        assert [r[:3] for r in sets(inverted.lookup(asked, folder, 5, probes))] == [("q", 1, "a"), ("q", 2, "e")]
    with pytest.raises(ValueError):
        inverted.build_index(made(spark, [("a", [1.0]), ("a", [2.0])], "string"), folder)
    with pytest.raises(FileNotFoundError):
        inverted.open_index(spark, str(tmp_path / "nowhere"))


def test_an_empty_index_fills(spark, tmp_path):
    folder = str(tmp_path / "index")
    inverted.build_index(made(spark, []), folder)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert inverted.lookup(asked, folder).count() == inverted.lookup(asked, folder, probes=3).count() == 0
    changes = spark.createDataFrame([(7, [1.0, 0.5], "insert")], "id long, vector array<float>, change_type string")
    assert inverted.apply_changes(changes, folder) == {"generation": 1, "cells_rewritten": 1, "relearned": 1, "rows": 1}
    assert [r["id"] for r in inverted.lookup(asked, folder).collect()] == [7]
    gone = changes.withColumn("change_type", F.lit("delete"))
    inverted.apply_changes(gone, folder)
    assert inverted.lookup(asked, folder).count() == 0


def test_work_per_batch_is_bounded(monkeypatch):
    """No table of distances passes ``PAIR_VALUES``, and slices change no result."""
    rng = np.random.default_rng(1)
    units = vectors._unit(rng.normal(size=(500, 8)))
    tree = inverted.Tree(units[:10], np.arange(0, 110, 10), units[:100])
    model = vectors.Cells(units[:100], np.full(100, 5), np.full(100, 0.4))
    whole = tree.assign(units), model.assign(units), model.visits(units, 3, None), tree.nearest(units, 4, model.rows)
    seen, distances = [], vectors.Cells.distances
    monkeypatch.setattr(vectors.Cells, "distances", lambda self, v: seen.append(len(v) * len(self.pivots)) or distances(self, v))
    for module in (vectors, inverted):
        monkeypatch.setattr(module, "PAIR_VALUES", 700)
    assert tree.step * 10 <= 700
    cut = tree.assign(units), model.assign(units), model.visits(units, 3, None), tree.nearest(units, 4, model.rows)
    assert max(seen) <= 700
    assert (whole[0] == cut[0]).all() and (whole[1][0] == cut[1][0]).all() and np.allclose(whole[1][1], cut[1][1], atol=1e-6)
    assert all((a == b).all() for i in (2, 3) for a, b in zip(whole[i], cut[i]))
    # About two square roots of comparisons a row, not one per cell.
    assert len(tree.groups) + np.diff(tree.first).max() <= 2 * np.sqrt(len(tree.cells))


def test_a_dominant_cell_is_cut(spark, tmp_path, monkeypatch):
    """Blocks of one cell are compared apart, with the same result."""
    rows = [(i, [1.0, i % 50 / 1000]) for i in range(600)] + [(1000 + i, [-1.0, i / 10]) for i in range(20)]
    folder = str(tmp_path / "index")
    inverted.build_index(made(spark, rows), folder, cells=4)
    asked = made(spark, rows[::40]).withColumnRenamed("id", "query_id")
    truth = sets(knn_join(asked, made(spark, rows), 6))
    assert sets(inverted.lookup(asked, folder, 6, block_rows=37)) == truth
    assert sets(inverted.lookup(asked, folder, 6, probes=4, wanted=400, block_rows=37)) == truth
