from pyspark.sql import functions as F

from passagework.plans.jobs import answer_job, embed_words
from passagework.streaming.index_sync import compact_index, read_index, sync_index
from passagework.streaming.replies import answer_stream, read_answers

SCHEMA = "doc_id long, version long, text string"


def text(word, n=30):
    return " ".join(f"{word}{i}" for i in range(n))


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def sync(spark, source, folder):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    sync_index(stream, folder, "doc_id", "version").awaitTermination()
    return sorted((r["id"], r["chunk"]) for r in read_index(spark, folder).collect())


def test_incremental_sync_equals_the_latest_articles(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")
    long = text("long", 400)
    arrive(spark, source, [(1, 1, text("old")), (2, 1, text("two")), (3, 1, long), (1, 2, text("one"))])
    first = sync(spark, source, folder)
    assert [i for i, _ in first][:2] == ["1_0", "2_0"] and len(first) > 4
    assert first[0][1].startswith("one0")

    # An update, a shortened article, an article that became too short, and a new one.
    arrive(spark, source, [(2, 2, text("new")), (3, 2, text("cut")), (1, 3, "tiny"), (4, 1, text("four"))])
    second = sync(spark, source, folder)
    assert [i for i, _ in second] == ["2_0", "3_0", "4_0"]
    assert [c.split("0")[0] for _, c in second] == ["new", "cut", "four"]

    compact_index(spark, folder)
    assert sync(spark, source, folder) == second
    arrive(spark, source, [(1, 4, text("back")), (4, 2, None)])
    third = sync(spark, source, folder)
    assert [i for i, _ in third] == ["1_0", "2_0", "3_0"]
    compact_index(spark, folder)
    compact_index(spark, folder)
    assert sorted((r["id"], r["chunk"]) for r in read_index(spark, folder).collect()) == third


def test_streamed_answers_equal_the_batch(spark, tmp_path):
    chunks = embed_words(
        spark.createDataFrame(
            [(f"{i}_0", 0, f"t{i}", text(w)) for i, w in enumerate(["rain", "snow", "wind"])],
            "id string, chunk_id int, title string, chunk string",
        ),
        "chunk",
    )
    questions = spark.createDataFrame(
        [("a", "where is rain1 rain2"), ("b", "tell about snow3"), ("c", "who is it")],
        "query_id string, question string",
    )
    source, folder = str(tmp_path / "q"), str(tmp_path / "out")
    for part in ("a", "b"):
        questions.filter(F.col("query_id") == part).write.mode("append").parquet(source)
    questions.filter("query_id = 'c'").write.mode("append").parquet(source)
    stream = spark.readStream.schema(questions.schema).parquet(source)
    answer_stream(stream, chunks, folder, k=2).awaitTermination()
    streamed = sorted(map(tuple, read_answers(spark, folder).select("query_id", "context", "answer").collect()))
    batch = answer_job(questions, chunks, k=2)
    assert streamed == sorted(map(tuple, batch.select("query_id", "context", "answer").collect()))
    answers = {q: a for q, _, a in streamed}
    assert answers["a"].endswith("[1]") and answers["c"].startswith("I couldn't find")


def test_deletions_and_two_versions_in_one_batch(spark, tmp_path):
    schema = SCHEMA + ", change_type string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")

    def sync_rows(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        sync_index(stream, folder, "doc_id", "version").awaitTermination()
        return sorted((r["id"], r["chunk"].split("0")[0]) for r in read_index(spark, folder).collect())

    first = [(1, 1, text("old"), "insert"), (1, 2, text("new"), "update"), (2, 1, text("two"), "insert")]
    assert sync_rows(first) == [("1_0", "new"), ("2_0", "two")]
    assert sync_rows([(2, 2, text("two"), "delete"), (3, 1, text("three"), None)]) == [("1_0", "new"), ("3_0", "three")]
    assert sync_rows([(2, 3, text("back"), "insert")]) == [("1_0", "new"), ("2_0", "back"), ("3_0", "three")]


def test_jobs_take_models(spark):
    from passagework.plans.jobs import answerer, embedder

    import numpy as np

    calls = spark.sparkContext.accumulator(0)

    def letters(texts):
        calls.add(len(texts))
        return np.array([[t.count(c) + 0.01 for c in "abcdefgh"] for t in texts])

    def client():
        return lambda prompts: [{"answer": f"{len(p)} [1]"} for p in prompts]

    model = embedder(letters)
    chunks = spark.createDataFrame(
        [("1_0", 0, "t", "aaaa bbbb"), ("2_0", 0, "t", "cccc dddd"), ("3_0", 0, "t", "eeee")],
        "id string, chunk_id int, title string, chunk string",
    )
    questions = spark.createDataFrame([(1, "ccc d"), (2, "ee")], "query_id long, question string")
    index = model(chunks, "chunk", "vector")
    answered = answer_job(questions, index, k=1, embed=model, use_rewriter=False, answer=answerer(client)).collect()
    assert {r["query_id"]: r["answer"][-4:] for r in answered} == {1: " [1]", 2: " [1]"}
    context = {r["query_id"]: r["context"] for r in answered}
    assert "cccc dddd" in context[1] and "eeee" in context[2]


def test_only_changed_chunks_are_embedded(spark, tmp_path):
    from passagework.plans.jobs import embedder, sync_job

    import numpy as np

    def lengths(texts):
        return np.array([[len(t), 1] for t in texts])

    model = embedder(lengths)
    old = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "zzz")], "id string, chunk string")
    new = spark.createDataFrame([("a", "x"), ("b", "changed"), ("d", "new one")], "id string, chunk string")
    index = model(old, "chunk", "vector")
    folder = str(tmp_path / "sync")
    done = sync_job(index, old, new, "id", "chunk", folder, model)
    assert sorted((r["id"], r["vector"][0]) for r in done.collect()) == [("a", 1.0), ("b", 7.0), ("d", 7.0)]
    assert spark.read.parquet(f"{folder}/fresh").count() == 2


def test_passages_are_fetched_without_shuffling_their_texts(spark):
    from passagework.plans.jobs import retrieve

    rows = [(f"{i}_0", i, text(f"w{i}")) for i in range(40)]
    chunks = embed_words(spark.createDataFrame(rows, "id string, chunk_id int, chunk string"), "chunk")
    questions = spark.createDataFrame([(1, text("w3", 4))], "query_id long, question string")
    plan = retrieve(questions, chunks, 2)._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("BroadcastHashJoin"):]
    assert "SortMergeJoin [id" not in plan and "BroadcastHashJoin" in joined


def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path):
    import os

    import pyarrow.parquet as pq

    from passagework.plans.flow_queries import stream_index_sync

    rows = spark.createDataFrame([(i, text(f"w{i}x")) for i in range(6)], "doc_id long, text string")
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    rows.repartition(3).write.parquet(f"{many}/documents.parquet")
    os.mkdir(one)
    pq.write_table(rows.toArrow(), f"{one}/documents.parquet")
    for folder in (many, one):
        assert sorted(r["id"] for r in stream_index_sync(spark, folder).collect()) == [f"{i}_0" for i in range(6)]
