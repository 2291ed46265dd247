from passagework.operators.changes import (
    change_feed,
    index_status,
    index_upsert,
    latest_versions,
    snapshot_diff,
)

OLD = [("a", "one", 1), ("b", "two", 2), ("c", None, 3), ("d", "four", None)]
NEW = [("a", "one", 1), ("b", "TWO", 2), ("c", None, 4), ("e", None, None)]
SCHEMA = "id string, chunk string, n int"


def test_diff_and_upsert(spark):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    diff = {r["id"]: r["change_type"] for r in snapshot_diff(old, new, "id", ["chunk", "n"]).collect()}
    assert diff == {"b": "update", "c": "update", "d": "delete", "e": "insert"}
    feed = change_feed(old, new, "id", ["chunk", "n"])
    assert sorted(map(tuple, index_upsert(old, feed, "id").collect())) == sorted(NEW)


def test_applying_changes_again_changes_nothing(spark):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    feed = change_feed(old, new, "id", ["chunk", "n"])
    once = index_upsert(old, feed, "id")
    assert sorted(map(tuple, index_upsert(once, feed, "id").collect())) == sorted(NEW)
    assert snapshot_diff(once, new, "id", ["chunk", "n"]).count() == 0


def test_null_and_the_word_null_differ(spark):
    old = spark.createDataFrame([("a", None)], "id string, chunk string")
    new = spark.createDataFrame([("a", "null")], "id string, chunk string")
    assert snapshot_diff(old, new, "id", ["chunk"]).first()["change_type"] == "update"


def test_status(spark):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    assert index_status(new, old, "id").first().asDict() == {
        "source_rows": 4, "indexed_rows": 4, "missing": 1, "orphaned": 1, "ready": False,
    }
    assert index_status(new, new, "id").first()["ready"] is True
    empty = new.filter("false")
    assert index_status(empty, empty, "id").first().asDict() == {
        "source_rows": 0, "indexed_rows": 0, "missing": 0, "orphaned": 0, "ready": True,
    }


def test_latest_version_wins(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 2), ("b", None, 1)], SCHEMA)
    assert sorted(map(tuple, latest_versions(log, "id", "n").collect())) == [("a", "y", 3), ("b", None, 1)]
