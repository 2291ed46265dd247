"""Byte-level BPE against the tokenizer library, and the decoder against Python's."""

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.llm import bpe
from passagework.llm.queries import multilingual

TOKENS, PATTERN = multilingual()
REFERENCE = tiktoken.Encoding(
    "own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={}
)
PIECES, UTF8, MACHINE = bpe.Pieces(TOKENS, PATTERN), bpe.Utf8(TOKENS), bpe.Transducer(TOKENS)
mixed = st.lists(st.sampled_from(
    ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "ing", "12", "'s", "'ll", "..", "ª", "Ω", "\u200b", "\xa0", "x.", "|", "²"]
), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), mixed))
def test_same_ids_as_the_library(text):
    ids = PIECES.ids(text).tolist()
    assert ids == REFERENCE.encode_ordinary(text)
    assert UTF8.decode(ids) == text


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=40), st.text("aeinrst", min_size=1, max_size=40).map(str.encode)))
def test_same_ids_for_any_bytes(data):
    ids = MACHINE.encode(data)
    assert ids == REFERENCE._encode_single_piece(data)
    assert UTF8.decode(ids) == data.decode("utf-8", "replace")


def test_long_pieces_and_resets(monkeypatch):
    long = "ab" * 5000 + "é" * 3000 + " " * 2000 + "x"
    assert PIECES.ids(long).tolist() == REFERENCE.encode_ordinary(long)
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 20)
    tiny = bpe.Pieces(TOKENS, PATTERN)
    text = "streams of rather different words, " * 3 + "und ähnliche Wörter mit Zügen und Bäumen."
    assert tiny.ids(text).tolist() == REFERENCE.encode_ordinary(text)


def test_ranks_that_do_not_grow():
    """A vocabulary whose merges are not in the order of their ranks still merges by rank."""
    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"bc", b"ab", b"cd", b"abcd"]
    plain, machine = bpe.Merges(tokens), bpe.Transducer(tokens)
    for text in (b"abc", b"abcd", b"bcd", b"aabcdd", b"abab", b"cdabc"):
        assert machine.encode(text) == plain(text)


def test_tables(odd, empty):
    found = bpe.encode(odd, TOKENS, PATTERN)
    assert found.columns == [*odd.columns, "ids"]
    for row in found.collect():
        assert row["ids"] == REFERENCE.encode_ordinary(row["text"] or "")
    back = bpe.decode(found, TOKENS).where(F.coalesce("text", F.lit("")) != F.col("decoded"))
    assert back.count() == 0
    both = bpe.round_trip(odd.select("doc_id", "text"), TOKENS, PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in both) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert bpe.encode(empty, TOKENS, PATTERN).count() == 0
    assert bpe.digest(odd, TOKENS, PATTERN).count() == odd.count()


def test_rank_file():
    assert len(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))) == 50256
    with pytest.raises(FileNotFoundError):
        bpe.read_ranks("/nowhere")
