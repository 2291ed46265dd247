from passagework.operators.chat import answered_turns, history_pairs, latest_prompt, reply_rows
from passagework.operators.positions import (
    best_before,
    position_in_key,
    position_in_table,
    with_next,
)

SCHEMA = "conv_id int, turn long, role string, text string"


def talk(spark, *conversations):
    rows = [
        (c, t, {"q": "user", "a": "assistant", "s": "system"}[text[0]], text)
        for c, texts in enumerate(conversations)
        for t, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_history_pairs_by_position(spark):
    messages = talk(spark, ["q1", "a1", "q2"], ["q1", "a1", "q2", "a2"], ["s", "q1", "a1"], ["q1"])
    pairs = sorted((r["conv_id"], r["pair"], r["question"], r["answer"]) for r in history_pairs(messages).collect())
    assert pairs == [(0, 0, "q1", "a1"), (1, 0, "q1", "a1"), (1, 1, "q2", "a2"), (2, 0, "s", "q1")]


def test_answered_turns_by_role(spark):
    messages = talk(spark, ["s", "q1", "a1"], ["q1", "q2", "a2", "a3"], ["a0", "q1"], ["q1", "s", "a1"])
    pairs = sorted((r["conv_id"], r["turn"], r["question"], r["answer"]) for r in answered_turns(messages).collect())
    assert pairs == [(0, 1, "q1", "a1"), (1, 1, "q2", "a2")]


def test_latest_prompt_has_any_role(spark):
    messages = talk(spark, ["q1", "a1"], ["s", "q1"])
    assert sorted((r["conv_id"], r["question"]) for r in latest_prompt(messages).collect()) == [(0, "a1"), (1, "q1")]


def test_one_conversation_with_most_rows(spark):
    """The hot conversation spans many buckets; turn numbers have gaps and one is negative."""
    turns = [t * 3 - 7 for t in range(3000)]
    rows = [(1, t, "user" if i % 2 == 0 else "assistant", f"m{i}") for i, t in enumerate(turns)]
    rows += [(2, 0, "user", "hello"), (2, 9, "assistant", "hi")]
    messages = spark.createDataFrame(rows, SCHEMA).repartition(8)
    for width in (16, 4096):
        placed = position_in_key(messages, "conv_id", "turn", width=width)
        got = [r["position"] for r in placed.filter("conv_id = 1").orderBy("turn").collect()]
        assert got == list(range(3000))
    assert history_pairs(messages).count() == 1501
    assert answered_turns(messages).count() == 1501


def test_best_before_over_buckets(spark):
    values = [(7 * i) % 101 for i in range(500)]
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, n long, v double")
    got = [
        r["best"]
        for r in best_before(rows.repartition(5), "k", "n", "v", "best", width=32).orderBy("n").collect()
    ]
    assert got == [None] + [float(max(values[:i])) for i in range(1, 500)]


def test_position_in_table_on_uneven_keys(spark):
    keys = [i for i in range(400)] + [10**15 + 3 * i for i in range(400)] + [-5]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    placed = position_in_table(rows, "k", buckets=7).orderBy("k").collect()
    assert [r["position"] for r in placed] == list(range(801))
    assert [r["k"] for r in placed] == sorted(keys)


def test_reply_ids_repeat(spark):
    answers = spark.createDataFrame([(1, 4, "text")], "conv_id int, turn long, answer string")
    first, again = reply_rows(answers).first(), reply_rows(answers).first()
    assert first == again and first["turn"] == 5 and first["role"] == "assistant"


def test_next_row_across_bucket_edges(spark):
    rows = [("a", 5 * i, f"m{i}") for i in range(50)] + [("b", 0, "only")]
    frame = spark.createDataFrame(rows, "k string, n long, text string").repartition(4)
    for width in (3, 10, 1000):
        got = with_next(frame, "k", "n", ["text"], width=width).orderBy("k", "n").collect()
        assert [r["next"] and r["next"]["text"] for r in got] == [f"m{i}" for i in range(1, 50)] + [None, None]
        assert [r["position"] for r in got] == list(range(50)) + [0]


def test_texts_are_exchanged_once(spark):
    """Rows with their texts pass one exchange; its other uses read that again."""
    import re

    rows = [(i % 5, i // 5, "user" if i // 5 % 2 == 0 else "assistant", f"m{i}") for i in range(20000)]
    messages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    pinned = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in pinned}
    try:
        for name, value in pinned.items():
            spark.conf.set(name, value)
        for made in (answered_turns(messages), history_pairs(messages)):
            plan = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            # The buckets' exchange; the edges' small one and the narrow counts hold no whole bucket.
            whole = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(conv_id#\d+, _bucket#\d+L?,", plan)
            assert sum("text#" in columns and "next" not in columns for columns in whole) == 1
            assert made.count() == 10000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
