"""Resumable generation, model steps, bootstrapped demos, racing and the selection job."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators import evalset
from passagework.operators import generation as gen
from passagework.operators.bootstrap import Stage, bootstrap, traces, with_prompt
from passagework.operators.positions import key_at
from passagework.operators.racing import race
from passagework.plans import models
from passagework.plans.jobs import answer_job, answerer, embed_words
from passagework.sources import run_records

REPLY = T.StructType([T.StructField("said", T.StringType())])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def counted(spark):
    """A client that counts its calls and prompts, and refuses prompts with "bad" in them."""
    calls, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def client():
        def generate(prompts):
            calls.add(1)
            asked.add(len(prompts))
            if any("bad" in p for p in prompts):
                raise RuntimeError("refused")
            return [{"said": p.upper()} for p in prompts]

        return generate

    return client, calls, asked


def test_second_run_asks_nothing(spark, tmp_path, counted):
    client, calls, asked = counted
    prompts = spark.createDataFrame([(i, f"p{i % 5}") for i in range(20)] + [(99, None), (0, "p0"), (None, "p1")], "k long, prompt string")
    folder = str(tmp_path / "cache")
    first = gen.resumed_generate(prompts, "prompt", client, REPLY, "k", folder)
    wanted = sorted([(i, f"P{i % 5}", None) for i in range(20)] + [(99, "", None), (0, "P0", None), (None, "P1", None)], key=repr)
    assert rows(first) == wanted
    assert asked.value == 6  # five different prompts and the empty one
    before = calls.value
    assert rows(gen.resumed_generate(prompts, "prompt", client, REPLY, "k", folder)) == wanted
    assert calls.value == before
    more = prompts.unionByName(spark.createDataFrame([(7, "new")], prompts.schema))
    assert gen.resumed_generate(more, "prompt", client, REPLY, "k", folder).count() == 24
    assert asked.value == 7
    assert gen.resumed_generate(prompts.where("false"), "prompt", client, REPLY, "k", str(tmp_path / "none")).count() == 0


def test_a_failing_prompt_costs_no_other_row(spark, tmp_path, counted):
    client, calls, asked = counted
    prompts = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(8)], "k long, prompt string").coalesce(1)
    folder = str(tmp_path / "cache")
    found = gen.resumed_generate(prompts, "prompt", client, REPLY, "k", folder, attempts=2, rows_per_write=3)
    assert rows(found.where("error is null")) == sorted((i, f"P{i}", None) for i in range(8) if i != 3)
    assert rows(found.where("error is not null")) == [(3, None, "RuntimeError: refused")]
    before = asked.value
    again = gen.resumed_generate(prompts, "prompt", client, REPLY, "k", folder, attempts=2)
    assert again.where("error is not null").count() == 1 and asked.value == before + 2  # twice, alone
    short = gen.resumed_generate(prompts, "prompt", lambda: lambda p: [{"said": "x"}] * (len(p) - 1), REPLY, "k", str(tmp_path / "s"), attempts=1)
    assert short.where("error like 'ValueError: 0 replies%'").count() == 8


def test_an_interrupted_run_goes_on(spark, tmp_path):
    """What earlier slices wrote is kept when a later one can't be."""
    folder = str(tmp_path / "cache")
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "k long, prompt string")
    asked = spark.sparkContext.accumulator(0)

    def client():
        def generate(some):
            asked.add(len(some))
            return [{"said": p} for p in some]

        return generate

    gen.resumed_generate(prompts.where("k < 12"), "prompt", client, REPLY, "k", folder, rows_per_write=5)
    assert asked.value == 12
    assert gen.resumed_generate(prompts, "prompt", client, REPLY, "k", folder).where("said is null").count() == 0
    assert asked.value == 30


def test_steps_ask_each_prompt_once(spark, tmp_path):
    chunks = embed_words(
        spark.createDataFrame([(f"{i}_0", 0, f"t{i}", f"{w} " * 20) for i, w in enumerate(["rain", "snow"])],
                              "id string, chunk_id int, title string, chunk string"), "chunk")
    questions = spark.createDataFrame([("a", "rain when"), ("b", "snow now"), ("c", "bad")], "query_id string, question string")
    seen = spark.sparkContext.accumulator(0)

    def rewriter():
        def generate(prompts):
            seen.add(len(prompts))
            if any("Question: bad" in p for p in prompts):
                raise RuntimeError("no")
            return [{"rewritten_query": "snow"} for _ in prompts]

        return generate

    rewrite = models.rewriting(rewriter, str(tmp_path / "r"), attempts=1)
    assert {r["query_id"]: r["search"] for r in rewrite(questions).collect()} == {"a": "snow", "b": "snow", "c": "bad"}
    before = seen.value

    def client():
        return lambda prompts: [{"answer": p.split("Context: ")[1][:8]} for p in prompts]

    answered = answer_job(questions, chunks, 1, answer=models.answering(client, str(tmp_path / "a")), rewrite=rewrite)
    assert {r["query_id"]: r["answer"] for r in answered.where("passages > 0").collect()}["a"] == "[1] snow"
    assert seen.value == before + 1  # only the refused one is asked again
    plain = answer_job(questions, chunks, 1, answer=answerer(client), rewrite=rewrite, use_rewriter=False)
    assert {r["query_id"]: r["answer"] for r in plain.where("passages > 0").collect()}["a"] == "[1] rain"


def test_judge_and_question_writer(spark, tmp_path):
    table = spark.createDataFrame([(1, "q", "r", ["f"]), (2, None, None, None)], "k long, request string, response string, expected_facts array<string>")

    def judge():
        return lambda prompts: [
            {"factual_accuracy": "1", "completeness": "1", "overall_score": "0.5" if "- f" in p else "none", "reasoning": ""} for p in prompts
        ]

    assert rows(models.judging(judge, str(tmp_path / "j"), "k", "Own words.")(table).select("k", "judge_score")) == [(1, 0.5), (2, 0.0)]

    def writer():
        return lambda prompts: [{"question": p.split("This is ")[1].split(" on")[0], "facts": " a \n\nb"} for p in prompts]

    documents = spark.createDataFrame([(1, "One. Two."), (2, " . "), (3, "x")], "id long, text string")
    allocated = evalset.allocate_evals(documents, "id", 3, "text")
    written = models.question_writing(writer, str(tmp_path / "w"), "Be short.")(allocated, "id", "text")
    assert rows(written) == [(1, 0, "question 1", ["a", "b"]), (1, 1, "question 2", ["a", "b"]), (3, 0, "question 1", ["a", "b"])]


def test_bootstrapped_demos_reach_prompts(spark):
    run = spark.createDataFrame([
        (1, "q1", "s1", "a1", "e1", 0.9), (2, "q2", "s2", "a2", "e2", 0.1), (3, "q3", "s3", "a3", None, 0.2), (4, "q4", "s4", "a4", "e4", 0.95),
    ], "id long, q string, s string, a string, e string, total double")
    first = Stage("one", "Rewrite.", {"q": "Q:", "s": "S:"}, {"q": "q"}, {"s": "s"})
    second = Stage("two", "Answer.", {"q": "Q:", "a": "A:"}, {"q": "q"}, {"a": "a"}, {"a": "e"})
    demos = bootstrap(traces(run, [first, second], "id", "total"), "id", "total", threshold=0.5, max_bootstrapped=1, max_labeled=1)
    assert rows(demos) == [("one", ["Q: q1\nS: s1"]), ("two", ["Q: q1\nA: a1", "Q: q2\nA: e2"])]
    prompt = with_prompt(run.where("id = 4"), second, demos).first()["prompt"]
    assert prompt == "\n\n---\n\n".join(["Answer.", "Q: q1\nA: a1", "Q: q2\nA: e2", "Q: q4\nA:"])
    none = demos.where("false")
    assert with_prompt(run.where("id = 4"), first, none).first()["prompt"] == "Rewrite.\n\n---\n\nQ: q4\nS:"
    # The same as with demos that the caller holds.
    held = gen.render_prompt("Answer.", second.fields, {"q": F.col("q")}, [{"q": "q1", "a": "a1"}, {"q": "q2", "a": "e2"}])
    assert run.where("id = 4").select(held).first()[0] == prompt


def scorer(df):
    return df.withColumn("total", F.col("worth") + (F.col("x") % 7) / 100)


def test_race_finds_the_best_and_counts(spark):
    examples = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 31 % 97).alias("x"))
    worth = [0.3 + ((i * 37) % 16) / 50 for i in range(16)]
    candidates = spark.createDataFrame([(i, worth[i]) for i in range(16)], "candidate_id long, worth double")
    row = race(examples, candidates, scorer, "k").first()
    assert row["candidate_id"] == max(range(16), key=lambda i: worth[i])
    assert row["examples"] == 4000 and 4000 * 4 < row["evaluations"] < 4000 * 6  # about 5 times, not 16
    mean = examples.agg(F.avg(F.col("x") % 7)).first()[0] / 100
    assert abs(row["mean_score"] - max(worth) - mean) < 1e-9
    tied = candidates.withColumn("worth", F.lit(0.5))
    assert race(examples, tied, scorer, "k").first()["candidate_id"] == 0
    alone = race(examples, candidates.where("candidate_id = 5"), scorer, "k").first()
    assert (alone["candidate_id"], alone["evaluations"]) == (5, 4000)
    assert race(examples.where("false"), candidates, scorer, "k").count() == 0
    unkeyed = examples.withColumn("k", F.when(F.col("k") > 10, F.col("k")))
    assert race(unkeyed, candidates, scorer, "k").first()["examples"] == 4000
    missing = race(examples, candidates, lambda df: df.withColumn("total", F.when(F.col("candidate_id") == 3, 0.1)), "k").first()
    assert missing["candidate_id"] == 3
    with pytest.raises(ValueError):
        race(examples, candidates, scorer, "k", keep=1)


def test_selection_job_records_the_run(spark, tmp_path):
    examples = spark.createDataFrame([(i, f"q{i}", [f"f{i}"]) for i in range(6)], "k long, request string, expected_facts array<string>")
    worth = lambda x: (lambda df: df.withColumn("response", F.lit(x)))

    def broken(df):
        raise KeyError("gone")

    def late(df):  # fails when it runs
        return df.withColumn("response", F.raise_error(F.lit("late")).cast("string"))

    judge = lambda df: df.withColumn("judge_score", F.col("response").cast("double"))
    folder = str(tmp_path / "run")
    programs = [("base", worth("0.4")), ("broken", broken), ("worse", worth("0.3")), ("late", late), ("good", worth("0.6")), ("same", worth("0.6"))]
    stages = models.selection_job(examples, programs, judge, folder, "r1", "k", config={"note": "x"})
    found = {r["stage"]: (r["stage_no"], r["ok"], r["accepted"], round(r["stage_score"], 9)) for r in stages.collect()}
    assert found == {
        "base": (0, True, False, 0.4), "broken": (1, False, False, 0.0), "worse": (2, True, False, 0.3), "late": (3, False, False, 0.0),
        "good": (4, True, True, 0.6), "same": (5, True, False, 0.6),
    }
    saved = run_records.read_records(spark, f"{folder}/record")
    assert rows(run_records.run_history(saved).select("run_id", "position", "stage")) == [("r1", 0, "good")]
    assert run_records.run_settings(saved).where("setting = 'note'").first()["value"] == "x"
    ledger = spark.read.parquet(f"{folder}/ledger").first()
    assert ledger["strategy"] == "bootstrap_only" and round(ledger["improvement"], 9) == 0.2


def test_key_at(spark):
    table = spark.createDataFrame([(i * 7 % 101, f"k{i:03d}") for i in range(101)] + [(None, None)], "n long, t string")
    for rows_per_range in (10**6, 5):
        assert [key_at(table, "n", p, rows_per_range) for p in (0, 50, 100, 101)] == [0, 50, 100, None]
    assert key_at(table, "t", 7) == "k007"
    hot = spark.range(400).select((F.col("id") % 3 * 0 + 5).alias("n"))
    assert key_at(hot, "n", 399, 20) == 5


def test_allotment_moves_no_texts(spark):
    table = spark.createDataFrame([(i, "Some words. More." if i % 4 else " . . ") for i in range(40)], "id long, text string")
    counts = {r["id"]: r["evals"] for r in evalset.allocate_evals(table, "id", 70, "text").collect()}
    assert sum(counts.values()) == 70 and all(i % 4 for i in counts) and sorted(counts.values()) == [2] * 20 + [3] * 10
    assert [i for i in sorted(counts) if counts[i] == 3] == sorted(counts)[:10]
    few = evalset.allocate_evals(table, "id", 7, "text")
    assert sorted(r["id"] for r in few.collect()) == [1, 2, 3, 5, 6, 7, 9]
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    assert evalset.allocate_evals(table.where("false"), "id", 7, "text").count() == 0
