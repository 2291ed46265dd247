import pytest
from pyspark.sql import functions as F

from passagework.functions import metrics
from passagework.operators.generation import parse_judge
from passagework.operators.scoring import score_answers, with_completeness, with_fact_f1

# Example texts and the scores they must have.
GENRE = "Heavy metal is a genre of rock music [1]. It developed in the late 1960s [2]."
EXPECTED = "Heavy metal is a genre of rock music characterized by aggressive sounds."


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected, strict",
    [
        ("x [1] y [2]", True, True),
        ("x [1] y [3]", True, False),
        ("x [0]", False, False),
        ("x [00] [2]", False, False),
        ("none", False, False),
        (None, False, False),
    ],
)
def test_citation(spark, text, expected, strict):
    response = F.col("r")
    assert one(spark, metrics.citation_ok(response), r=text) is expected
    assert one(spark, metrics.citation_ok(response, strict=True), r=text) is strict


def test_citation_options(spark):
    assert one(spark, metrics.citation_ok(F.col("r"), require_citations=False), r="none") is True
    cited = metrics.citation_ok(F.col("r"), strict=True, passages=F.lit(1))
    assert one(spark, cited, r="[1] [2]") is False


@pytest.mark.parametrize(
    "context, answer, expected",
    [
        ("Abc\n\nDef", "has abc in it", True),
        ("Abc\n\nDef", "has neither", False),
        (None, "anything", False),
        ("", "anything", False),
        ("x1\n\nx2\n\nx3\n\nyes", "only yes here", False),
        ("q\n\n\n\nz", "an empty block is part of everything", True),
    ],
)
def test_context_used(spark, context, answer, expected):
    assert one(spark, metrics.context_used(F.col("a"), F.col("c")), a=answer, c=context) is expected


def test_jaccard_and_diversity(spark):
    a, b = "Who started heavy metal music?", "who is the founder of heavy metal music"
    pair = (F.col("a"), F.col("b"))
    assert one(spark, metrics.word_jaccard(*pair), a=a, b=b) == pytest.approx(0.3)
    assert one(spark, metrics.query_diverse(*pair), a=a, b=b) is True
    assert one(spark, metrics.word_jaccard(*pair), a="", b="  ") == 0
    assert one(spark, metrics.query_diverse(*pair), a="", b="") is False
    assert one(spark, metrics.query_diverse(*pair), a=a, b=None) is True


def f1(spark, predicted, expected, **options):
    row = spark.createDataFrame([(predicted, expected)], "p string, e string")
    given, wanted = metrics.facts_of_text(F.col("p")), metrics.facts_of_text(F.col("e"))
    return with_fact_f1(row, given, wanted, **options).first()["f1"]


def test_fact_f1(spark):
    assert f1(spark, GENRE, EXPECTED) == pytest.approx(2 / 3)
    assert f1(spark, "a b. a b. a b", "a b") == pytest.approx(1.5)
    assert f1(spark, "a b. a b. a b", "a b", cap=True) == 1.0
    assert f1(spark, "a b. a b. a b", "a b", fuzzy=False) == 1.0
    assert f1(spark, "", "") == 1.0
    assert f1(spark, "some", "") == 0.0
    assert f1(spark, "", "some") == 0.0
    assert f1(spark, "apple", "pear") == 0.0
    assert f1(spark, None, "some") == 0.0
    assert f1(spark, "!!!. a", "z") == pytest.approx(2 * (0.5 * 1.0) / 1.5)


def test_fact_lists(spark):
    row = spark.createDataFrame([(["King of Gods!", " ", "!!!"],)], "f array<string>")
    assert row.select(metrics.facts_of_list(F.col("f")).alias("v")).first()["v"] == ["king of gods", ""]


@pytest.mark.parametrize(
    "question, answer, expected",
    [
        ("What is heavy metal music?", GENRE, True),
        ("Who is it", "anything", True),
        ("So what, then", "then so", False),
        (None, "x", False),
        ("x", None, False),
    ],
)
def test_completeness(spark, question, answer, expected):
    row = spark.createDataFrame([(question, answer)], "question string, response string")
    assert with_completeness(row).first()["completeness"] is expected


def test_keywords_keep_order_and_repeats(spark):
    words = one(spark, metrics.keywords(F.col("q")), q="What, what metal? (Metal) is ok!!  big")
    assert words == ["what", "metal", "metal", "ok", "big"]


def test_total(spark):
    row = spark.createDataFrame(
        [("What is heavy metal music?", GENRE, EXPECTED)], "question string, response string, e string"
    )
    scored = score_answers(row, metrics.facts_of_text(F.col("e")), context=None).first()
    assert scored["total"] == pytest.approx(0.2 + 0.4 * 2 / 3 + 0.1)
    assert (scored["f1_pass"], scored["total_pass"]) == (False, False)


def test_saved_totals_against_the_threshold(spark):
    rows = spark.createDataFrame([(0.62,), (0.2142857142857143,), (0.4,)], "t double")
    passed = [r["v"] for r in rows.select((F.col("t") >= metrics.TOTAL_PASS).alias("v")).collect()]
    assert passed == [True, False, False]


@pytest.mark.parametrize(
    "overall, accuracy, completeness, reasoning, expected",
    [
        ("0.7", "1", "1", "ok", 0.7),
        (" 0.7\n", None, None, "ok", 0.7),
        ("1.4", "1", "1", "ok", 1.0),
        ("-0.2", "1", "1", "ok", 0.0),
        ("0.7x", "1", "1", "ok", 0.0),
        ("0.7d", "1", "1", "ok", 0.0),
        ("0.7", "bad", "1", "ok", 0.0),
        ("0.7", "1", "", "ok", 0.0),
        ("nan", "1", "1", "ok", 1.0),
        ("inf", "1", "1", "ok", 1.0),
        ("1e-1", "1_0", "1", "ok", 0.1),
        ("0.7", "1", "1", None, 0.0),
        (None, "1", "1", "ok", 0.0),
    ],
)
def test_judge(spark, overall, accuracy, completeness, reasoning, expected):
    row = spark.createDataFrame(
        [(overall, accuracy, completeness, reasoning)],
        "overall_score string, factual_accuracy string, completeness string, reasoning string",
    )
    assert parse_judge(row).first()["judge_score"] == pytest.approx(expected)
