"""Recorded tables and the stream of their changes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from passagework.operators import changes
from passagework.sources import change_feed as feed
from passagework.streaming.index_sync import index_batch, read_index, sync_index


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def body(word):
    return " ".join(f"{word}{i}" for i in range(30))


def test_versions_and_change_lists(spark, tmp_path):
    folder = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        feed.read_version(spark, folder)
    assert feed.overwrite_recorded(table(spark, [(1, "a"), (2, "b"), (3, None)]), folder, "doc_id") == 0
    assert feed.overwrite_recorded(table(spark, [(1, "a"), (2, "B"), (4, "d")]), folder, "doc_id") == 1
    assert rows(feed.read_changes(spark, folder, 0)) == [(1, "a", "insert", 0), (2, "b", "insert", 0), (3, None, "insert", 0)]
    assert rows(feed.read_changes(spark, folder, 1)) == [(2, "B", "update", 1), (3, None, "delete", 1), (4, "d", "insert", 1)]
    assert rows(feed.read_version(spark, folder)) == [(1, "a"), (2, "B"), (4, "d")]
    assert rows(feed.read_version(spark, folder, 0)) == [(1, "a"), (2, "b"), (3, None)]
    # What a failed attempt wrote is not read, and the next attempt replaces it.
    table(spark, [(9, "lost")]).write.parquet(f"{folder}/versions/0000000002")
    assert feed.latest_version(spark, folder) == 1
    assert feed.overwrite_recorded(table(spark, []), folder, "doc_id") == 2
    assert rows(feed.read_changes(spark, folder, 2)) == [(i, None, "delete", 2) for i in (1, 2, 4)]
    assert feed.read_version(spark, folder).count() == 0


def test_many_changes_take_the_other_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "FEW_CHANGES", 1)
    folder = str(tmp_path / "table")
    feed.overwrite_recorded(table(spark, [(i, "x") for i in range(9)]), folder, "doc_id")
    feed.overwrite_recorded(table(spark, [(i, "y") for i in range(3, 12)]), folder, "doc_id")
    found = feed.read_changes(spark, folder, 1).groupBy("change_type").count()
    assert rows(found) == [("delete", 3), ("insert", 3), ("update", 6)]


def batches(folder):
    path = os.path.join(folder, "progress", "offsets")
    return [json.loads(open(os.path.join(path, name)).read().splitlines()[-1])["version"] for name in sorted(os.listdir(path), key=lambda n: n.zfill(9)) if name.isdigit()]


def test_batches_follow_versions_and_replays_change_nothing(spark, tmp_path):
    source, folder = str(tmp_path / "table"), str(tmp_path / "index")

    def sync():
        sync_index(feed.read_feed(spark, source), folder, "doc_id", "version").awaitTermination()
        return sorted((r["id"], r["chunk"].split("0")[0]) for r in read_index(spark, folder).collect())

    feed.overwrite_recorded(table(spark, [(1, body("one")), (2, body("two")), (3, body("three"))]), source, "doc_id")
    assert sync() == [("1_0", "one"), ("2_0", "two"), ("3_0", "three")]
    feed.overwrite_recorded(table(spark, [(1, body("one")), (2, body("new")), (4, body("four"))]), source, "doc_id")
    assert sync() == [("1_0", "one"), ("2_0", "new"), ("4_0", "four")]
    assert sync() == [("1_0", "one"), ("2_0", "new"), ("4_0", "four")]  # nothing arrived
    # Two versions arrive together: the later one counts.
    feed.overwrite_recorded(table(spark, [(1, body("mid")), (2, body("new"))]), source, "doc_id")
    feed.overwrite_recorded(table(spark, [(1, body("end")), (4, body("back"))]), source, "doc_id")
    last = sync()
    assert last == [("1_0", "end"), ("4_0", "back")]
    assert batches(folder) == [0, 1, 3]
    # A batch that is written again, as after a lost driver, replaces its own output.
    replay = feed.read_changes(spark, source, 1)
    index_batch(replay, "doc_id", "version").write.mode("overwrite").parquet(f"{folder}/log/batch=1")
    assert sorted((r["id"], r["chunk"].split("0")[0]) for r in read_index(spark, folder).collect()) == last


def test_reader_by_itself(spark, tmp_path):
    folder = str(tmp_path / "table")
    reader = feed.ChangeFeedReader(folder, feed.feed_schema(table(spark, [])))
    assert reader.initialOffset() == reader.latestOffset() == {"version": -1}
    feed.overwrite_recorded(table(spark, [(1, "a"), (None, None)]).withColumn("text", F.col("text")), folder, "doc_id")
    reader.folder = f"file://{folder}"
    assert reader.latestOffset() == {"version": 0} and reader.partitions({"version": 0}, {"version": 0}) == []
    found = [row for part in reader.partitions({"version": -1}, {"version": 0}) for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted(map(repr, found)) == sorted(map(repr, [
        {"doc_id": 1, "text": "a", "change_type": "insert", "version": 0}, {"doc_id": None, "text": None, "change_type": "insert", "version": 0}]))
