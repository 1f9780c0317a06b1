import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from trajgraph.llm.pieces import MergeModel, encode, op9_pieces, piece_model, segments

MODEL = MergeModel(piece_model())
HARD = [
    "", " ", "  ", "a  b", "\n", " \n ", "a\n\nb", "▁a ▁", "a▁b", "   x", "x   ", "\x00a\tb", "é́🙂ﬁ", "a" * 300,
    " " * 40 + "y" + " " * 33 + "\n" + " " * 20, "<s></s><unk><0x41>", "▁▁\n▁", "the" * 50 + "\n" + "1" * 60, "\r\n x\r", "﻿a", "a　b\xa0c",
]


def ids_of(text):
    return [i for s in segments(text) for i in MODEL.encode_segment(s)]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert ids_of(text) == MODEL.library.encode(text)
    assert MODEL.decode(ids_of(text)) == MODEL.library.decode(ids_of(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ▁\nabetheé日🙂1.,'")), max_size=80))
def test_any_text(text):
    assert ids_of(text) == MODEL.library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(28700, 28720), st.integers(0, 31999)), max_size=12))
def test_decoding_any_ids(ids):
    assert MODEL.decode(ids) == MODEL.library.decode(ids)


def test_short_and_long_agenda_agree():
    for text in HARD:
        if text:
            assert MODEL._short(list(text)) == MODEL._long(list(text))


def digests(text):
    ids = MODEL.library.encode(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(MODEL.library.decode(ids))


def test_query_against_the_library(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_pieces(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(docs[r.doc_id])


def test_nulls_repeats_and_other_columns(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, *HARD, "a  b", "x" * 100_000])], "doc_id long, text string, ids string")
    frame = frame.union(frame.filter("doc_id < 3"))
    for r in encode(frame, piece_model(), digests=True).join(frame.select("doc_id", "text").distinct(), "doc_id").collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(r.text)
    full = encode(frame, piece_model()).filter("doc_id = 4").first()
    assert full.ids == MODEL.library.encode("a  b") and full.decoded == "a  b"
    assert encode(frame.limit(0), piece_model()).count() == 0


def test_query_decodes_its_ids(spark, sf, monkeypatch):
    """With a decoder that answers otherwise, the query's digests change: they come from the ids."""
    rows = {r.doc_id: r.decoded_sha256 for r in op9_pieces(spark, sf).collect()}
    monkeypatch.setattr(MergeModel, "decode", lambda self, ids, first=True: f"<{len(ids)}>")
    other = {r.doc_id: r.decoded_sha256 for r in op9_pieces(spark, sf).collect()}
    assert rows.keys() == other.keys() and all(rows[i] != other[i] for i in rows)
