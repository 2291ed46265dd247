"""Saved runs in every shape that they come in."""

import json

from passagework.sources import run_records as rr


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


RECORDS = [
    {  # pairs, details of both kinds, deep settings, no id
        "program_type": "P", "base_score": 18.25, "optimized_score": 49.5, "improvement": 31.25,
        "optimization_history": [["Bootstrap", 49.5]],
        "detailed_baseline_scores": {"example_1": {"citation": True}},
        "detailed_optimized_scores": {"example_1": {"citation": False, "comprehensive": 0.25}, "example_2": {"comprehensive": 1}},
        "config": {"strategy": "multi_stage", "stages": ["Bootstrap"], "a": {"b": {"c": 2, "d": None, "e": {}}, "on": True}},
    },
    {  # objects, other names of the scores
        "run_id": "r2", "strategy": "bootstrap_only", "baseline_score": 0.5, "final_score": 0.75, "timestamp": "2025-01-02T03:04:05",
        "optimization_history": [
            {"stage": "bootstrap", "score": 0.6, "timestamp": "2025-01-02T03:00:00"}, {"stage": "search", "score": 0.75, "config": {"x": 1}},
        ],
    },
    {"run_id": "r3", "optimization_history": [], "config": {}},
    {"run_id": "r4", "optimization_history": "lost", "detailed_baseline_scores": None, "config": 7, "base_score": "n/a"},
    {},
]


def test_parts_of_records(spark, tmp_path):
    lines = str(tmp_path / "lines")
    spark.createDataFrame([(json.dumps(r),) for r in RECORDS], "value string").write.text(lines)
    saved = rr.read_records(spark, lines)
    names = {r["run_id"] for r in saved.collect()}
    assert len(names) == 5 and {"r2", "r3", "r4"} < names
    first = next(r["run_id"] for r in rr.run_scores(saved).collect() if r["base_score"] == 18.25)
    scores = {r["run_id"]: tuple(r)[1:5] for r in rr.run_scores(saved).collect()}
    assert scores[first] == ("multi_stage", 18.25, 49.5, 31.25) and scores["r2"] == ("bootstrap_only", 0.5, 0.75, None)
    assert scores["r4"] == (None, None, None, None)
    assert str(rr.run_scores(saved).where("run_id = 'r2'").first()["ran_at"]) == "2025-01-02 03:04:05"
    history = rr.run_history(saved).drop("ran_at")
    assert rows(history.where(history["position"].isNotNull())) == sorted([
        (first, 0, "Bootstrap", 49.5), ("r2", 0, "bootstrap", 0.6), ("r2", 1, "search", 0.75)], key=repr)
    assert history.where("position is null").count() == 3
    assert rows(rr.run_details(saved).drop("run_id")) == sorted([
        ("baseline", "example_1", "citation", True, None), ("optimized", "example_1", "citation", False, None),
        ("optimized", "example_1", "comprehensive", None, 0.25), ("optimized", "example_2", "comprehensive", None, 1.0)], key=repr)
    assert rows(rr.run_settings(saved).drop("run_id")) == sorted([
        ("strategy", "multi_stage"), ("stages", '["Bootstrap"]'), ("a.b.c", "2"), ("a.b.d", "null"), ("a.on", "true")], key=repr)
    shallow = rows(rr.run_settings(saved, depth=2).where("setting like 'a.%'").drop("run_id"))
    assert shallow == [("a.b", '{"c":2,"d":null,"e":{}}'), ("a.on", "true")]


def test_one_record_per_file(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(RECORDS[1], indent=2))
    (tmp_path / "two.json").write_text(json.dumps(RECORDS[0], indent=2))
    saved = rr.read_records(spark, str(tmp_path), one_per_file=True)
    assert saved.count() == 2 and rr.run_history(saved).count() == 3
