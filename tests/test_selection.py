import pytest
from pyspark.sql import functions as F

from passagework.operators import evalset, selection
from passagework.operators import generation as gen
from passagework.sources import tables


@pytest.mark.parametrize(
    "scores, accepted, final, percent",
    [
        ([0.351, 0.485, 0.500], [1, 2], 0.500, 42.45),
        ([0.50, 0.50, 0.49], [], 0.50, 0.0),
        ([0.0, 0.2, None], [1], 0.2, 0.0),
        ([18.33, 49.8], [1], 49.8, 171.69),
    ],
)
def test_stage_acceptance(spark, scores, accepted, final, percent):
    rows = [("r", n, s) for n, s in enumerate(scores)]
    runs = spark.createDataFrame(rows, "run_id string, stage_no long, score double")
    stages = selection.accept_stages(runs, ok=F.col("score").isNotNull())
    assert [r["stage_no"] for r in stages.filter("accepted").orderBy("stage_no").collect()] == accepted
    result = selection.run_results(stages).first()
    assert result["final_score"] == pytest.approx(final)
    assert result["improvement_percent"] == pytest.approx(percent, abs=0.005)
    history = selection.accepted_history(stages).orderBy("entry").collect()
    assert [(r["entry"], r["stage_no"]) for r in history] == list(enumerate(accepted))


def test_demos(spark):
    rows = [("s", i, score) for i, score in enumerate([0.1, 0.9, 0.2, 0.8, 0.7])] + [("t", 9, 0.0)]
    scored = spark.createDataFrame(rows, "stage string, example int, score double")
    demos = selection.choose_demos(scored, "stage", "example", "score", max_bootstrapped=2, max_labeled=2)
    got = sorted((r["stage"], r["augmented"], r["position"], r["example"]) for r in demos.collect())
    assert got == [("s", False, 1, 0), ("s", False, 2, 2), ("s", True, 1, 1), ("s", True, 2, 3), ("t", False, 1, 9)]


def test_top_of_a_hot_group_is_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 990, "p").otherwise("q").alias("program"), F.col("id").alias("n"))
    detailed = selection.detailed_examples(rows, "program", ["n"])
    plan = detailed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    got = sorted((r["program"], r["n"]) for r in detailed.collect())
    assert got == [("p", 0), ("p", 1), ("p", 2), ("q", 990), ("q", 991), ("q", 992)]


def test_best_candidate_breaks_ties(spark):
    scores = spark.createDataFrame([(2, 0.5), (1, 0.5), (0, 0.4)], "candidate_id int, total double")
    assert selection.best_candidate(scores, "candidate_id", "total").first()["candidate_id"] == 1
    many = selection.try_candidates(scores, [f"text {i}" for i in range(1001)])
    assert many.count() == 3003


@pytest.mark.parametrize("num_evals", [0, 3, 10, 25, 40])
def test_allocation_is_even_and_complete(spark, num_evals):
    documents = spark.createDataFrame([(i * i,) for i in range(10)], "k long").repartition(4)
    evals = {r["k"]: r["evals"] for r in evalset.allocate_evals(documents, "k", num_evals).collect()}
    assert sum(evals.values()) == num_evals
    full = [evals.get(i * i, 0) for i in range(10)]
    assert full == sorted(full, reverse=True) and max(full) - min(full) <= 1


def test_eval_rows_to_examples(spark):
    rows = [
        (({"messages": [{"role": "user", "content": "Q1"}, {"role": "user", "content": "no"}]}), ({"expected_facts": ["a", "b"]})),
        (({"messages": []}), ({"expected_facts": []})),
    ]
    table = tables.eval_rows(spark, rows).withColumn("n", F.monotonically_increasing_id())
    got = [(r["request"], r["expected_facts"]) for r in evalset.training_examples(table, ["n"]).orderBy("n").collect()]
    assert got == [("Q1", ["a", "b"]), (None, [])]


def test_eval_documents_keep_null_titles(spark):
    articles = spark.createDataFrame([(2, "T", "x"), (1, None, "y")], "id int, title string, text string")
    got = [tuple(r) for r in evalset.eval_documents(articles).orderBy("doc_uri").collect()]
    assert got == [(None, "1"), ("T: x", "2")]


def test_held_out_split_is_stable(spark):
    rows = spark.range(2000)
    once = evalset.held_out_split(rows, "id")
    again = evalset.held_out_split(rows.repartition(7), "id")
    assert once.exceptAll(again).count() == 0
    assert 300 < once.filter("held_out").count() < 500


def test_prompt_with_demo(spark):
    row = spark.createDataFrame([("ctx", "why?")], "c string, q string")
    prompt = gen.render_prompt(
        "Do it.", gen.ANSWER_FIELDS, {"context": F.col("c"), "question": F.col("q")},
        [{"context": "c0", "question": "q0", "answer": "a0"}],
    )
    assert row.select(prompt.alias("p")).first()["p"] == (
        "Do it.\n\n---\n\nContext: c0\nQuestion: q0\nAnswer: a0\n\n---\n\nContext: ctx\nQuestion: why?\nAnswer:"
    )
    many = gen.render_prompt("x", {"context": "Context:"}, {}, [{"context": f"c{i}"} for i in range(65)])
    assert row.select(many.alias("p")).first()["p"].count("Context: c") == 65


def test_best_passage(spark):
    rows = [
        (1, 1, "heavy rain", "nothing here\nline"),
        (1, 2, "heavy rain", "  Heavy Rain fell\nmore"),
        (1, 3, "heavy rain", "rain and heavy"),
    ]
    passages = spark.createDataFrame(rows, "query_id int, rank int, question string, chunk string")
    best = gen.with_candidate_answers(passages).groupBy("query_id").agg(gen.best_candidate_answer().alias("a"))
    assert best.first()["a"] == "Heavy Rain fell [2]"


def test_run_and_program_files(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text(
        '{"run_id": "a", "base_score": 18.33,\n "optimized_score": 49.8, "improvement": 31.47,\n'
        ' "optimization_history": [["Bootstrap", 49.8]]}'
    )
    (tmp_path / "runs" / "b.json").write_text(
        '{"run_id": "b", "optimization_history": [{"stage": "bootstrap", "score": 0.4}, {"stage": "search", "score": 0.5}]}'
    )
    (tmp_path / "runs" / "c.json").write_text('{"run_id": "c", "optimization_history": []}')
    runs = tables.read_run_files(spark, str(tmp_path / "runs"), one_per_file=True)
    got = sorted((r["run_id"], r["position"] or 0, r["stage"], r["score"]) for r in runs.collect())
    assert got == [("a", 0, "Bootstrap", 49.8), ("b", 0, "bootstrap", 0.4), ("b", 1, "search", 0.5), ("c", 0, None, None)]
    (tmp_path / "p.json").write_text(
        '{"retriever": {"k": 5}, "answer.predict": {"demos": [{"augmented": true, "question": "q", "answer": "a"}],\n'
        '"signature": {"instructions": "Do it.", "fields": [{"prefix": "Q:", "description": "d"}]}}, "rewrite.predict": {"demos": []}}'
    )
    demos = tables.read_program_files(
        spark, str(tmp_path / "p.json"), ["answer.predict", "rewrite.predict"], one_per_file=True
    ).collect()
    assert [(r["stage"], r["position"], r["augmented"], r["question"], r["instructions"]) for r in demos] == [
        ("answer.predict", 0, True, "q", "Do it.")
    ]


def test_work_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = tables.work_dir(spark, "x"), tables.work_dir(spark, "x")
    assert first.startswith(root) and first != second


def test_spread_leaves_wide_tables_alone(spark):
    wide = spark.range(0, 100, 1, numPartitions=16)
    assert tables.spread(wide, "id") is wide
    assert tables.spread(wide.coalesce(1), "id").rdd.getNumPartitions() == 8


def test_every_allotted_row_is_written(spark):
    rows = [("b", "One. Two."), ("a", " . ."), ("c", "Three."), ("d", None)]
    documents = spark.createDataFrame(rows, "k string, t string")
    for total in (1, 5, 6):
        allotted = evalset.allocate_evals(documents, "k", total, "t")
        assert evalset.question_rows(allotted, "k", "t").count() == total


def test_stages_without_score_or_place(spark):
    nan = float("nan")
    rows = [("r", 0, 0.3), ("r", 1, nan), ("r", 2, 0.4), ("r", None, 0.9), (None, 1, 0.9), ("q", 0, None)]
    stages = selection.accept_stages(spark.createDataFrame(rows, "run_id string, stage_no int, score double"))
    found = {(r["run_id"], r["stage_no"]): (r["ok"], r["accepted"], r["stage_score"]) for r in stages.collect()}
    assert len(found) == len(rows)
    assert found["r", 1] == (False, False, 0.0) and found["r", 2] == (True, True, 0.4)
    assert not found["r", None][1] and not found[None, 1][1]
    result = selection.run_results(stages.filter("run_id = 'r' and stage_no is not null")).first()
    assert result["final_score"] == 0.4
