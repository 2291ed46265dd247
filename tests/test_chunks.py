import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.operators.corpus import (
    boundary_chunks,
    boundary_spans,
    fixed_chunks,
    split_at_boundaries,
)
from passagework.sources.tables import read_parquet


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.data())
def test_boundary_pieces(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    spans = boundary_spans(text, size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(end - start <= size for start, end in spans)
    for (start, end), (next_start, next_end) in zip(spans, spans[1:]):
        assert start < next_start and end < next_end
        assert end - overlap <= next_start <= end
    rest = "".join(text[max(start, end):stop] for (_, end), (start, stop) in zip(spans, spans[1:]))
    assert text[slice(*spans[0])] + rest == text


def test_coarse_boundaries_come_first():
    text = "a" * 30 + "\n\n" + "b" * 20 + "\n" + "c" * 20 + " " + "d" * 60
    assert split_at_boundaries(text, 80, 5)[0] == "a" * 30 + "\n\n"
    assert split_at_boundaries("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 5]
    assert split_at_boundaries("one two, three", 10, 7) == ["one two, ", "two, three"]
    assert split_at_boundaries("one two three four", 10, 4) == ["one two ", "three four"]


def test_ids_and_ordinals(spark):
    rows = spark.createDataFrame([(7, "T", "z" * 2500)], "id int, title string, text string")
    for chunks in (fixed_chunks(rows, "id"), boundary_chunks(rows, "id")):
        assert chunks.columns == ["id", "chunk_id", "title", "chunk"]
        assert dict(chunks.dtypes)["id"] == "string" and dict(chunks.dtypes)["chunk_id"] == "int"
        got = sorted((r["chunk_id"], r["id"]) for r in chunks.collect())
        assert got == [(0, "7_0"), (1, "7_1"), (2, "7_2")]


def test_fixed_chunks_cover_the_text(spark):
    rows = spark.createDataFrame([(n, "q" * n) for n in (0, 1, 50, 51, 999, 1000, 1001, 1950, 1951)], "id int, text string")
    lengths = {}
    for r in fixed_chunks(rows, "id").orderBy("chunk_id").collect():
        lengths.setdefault(int(r["id"].split("_")[0]), []).append(len(r["chunk"]))
    assert lengths[0] == [0] and lengths[50] == [50] and lengths[1000] == [1000]
    assert lengths[1001] == [1000, 51] and lengths[1950] == [1000, 1000]
    assert lengths[1951] == [1000, 1000, 51]


@pytest.mark.parametrize("chunk", [fixed_chunks, boundary_chunks])
def test_same_result_for_any_partitioning(spark, folder, chunk):
    documents = read_parquet(spark, folder, "documents").select("doc_id", "text")
    one = chunk(documents.coalesce(1), "doc_id")
    many = chunk(documents.repartition(8), "doc_id")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert one.groupBy("id").count().filter("count > 1").count() == 0
    assert one.agg(F.max(F.length("chunk"))).first()[0] <= 1000


def test_bad_sizes_are_refused(spark):
    rows = spark.createDataFrame([(1, "x")], "id int, text string")
    for chunk in (fixed_chunks, boundary_chunks):
        with pytest.raises(ValueError):
            chunk(rows, "id", size=50, overlap=50)
