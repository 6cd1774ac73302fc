"""Backtracking encoder and decoder against the sentencepiece library."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrate.llm import sentence_pieces
from stayrate.llm.queries import op11_sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = sentence_pieces.Model.read(PATH)
ENCODER, DECODER = sentence_pieces.Encoder(MODEL), sentence_pieces.Decoder(MODEL)
BLANK = "▁"


def encoder_of(model, known={}):
    return known.setdefault(model.led, sentence_pieces.Encoder(model))


def ids_of(text):
    return np.frombuffer(ENCODER.encode(text), np.int32).tolist()


HARD = [
    "", " ", "  ", "a", " a", "a ", "   lead", "tail    ", " " * 7 + "x" + " " * 33, "tab\tand\nline\r\n", "a" * 300, "ab" * 500,
    "</s> <s> <unk> <0x41>", "▁under", "x▁▁y", "▁" * 40, "中文 字符 한국어 日本語", "🙂🙃 mixed 🇩🇪 flags", "é vs é",
    "\x00 nul \x7f", "12345 67890", "thethethethe", "antidisestablishmentarianism", "https://example.org/a?b=c&d=%20", "﻿bom",
]


@pytest.mark.parametrize("text", HARD)
def test_ids_and_texts_are_those_of_the_library(text):
    wanted = LIBRARY.encode(text)
    assert ids_of(text) == wanted
    assert DECODER.decode(np.array(wanted, np.int32)) == LIBRARY.decode(wanted)


pieces = st.sampled_from([p for i, p in enumerate(MODEL.pieces) if MODEL.kinds[i] == sentence_pieces.NORMAL])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(pieces, max_size=12).map("".join), st.text("aeinst ▁é中", max_size=40)))
def test_any_text(text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    wanted = LIBRARY.encode(text)
    assert ids_of(text) == wanted
    assert DECODER.decode(np.array(wanted, np.int32)) == LIBRARY.decode(wanted)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(3, 258)), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert DECODER.decode(np.array(ids, np.int32)) == LIBRARY.decode(ids)


def test_every_piece_is_read_as_the_library_reads_it():
    for i, piece in enumerate(MODEL.pieces):
        if MODEL.kinds[i] == sentence_pieces.NORMAL:
            assert ids_of(piece) == LIBRARY.encode(piece)


def test_reading_whole_texts_equals_reading_words():
    text = "the quick  brown fox, 12 jumps   over"
    encoder = sentence_pieces.Encoder(MODEL)
    encoder.by_word = False
    assert np.frombuffer(encoder.encode(text), np.int32).tolist() == ids_of(text)


class Asked(dict):
    """Known pairs that count how often they are asked for."""

    number = 0

    def get(self, pair):
        self.number += 1
        return super().get(pair)


def test_a_place_fails_once():
    """Texts that need backtracking at many places stay linear."""
    encoder = sentence_pieces.Encoder(MODEL)
    encoder.pairs = Asked()
    text = "ing" * 4000 + "s" * 4000
    encoder.split(text)
    assert 0 < encoder.pairs.number < 20 * len(text)


def wanted_row(doc_id, text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "two words", "z"), (3, "two words", "z"), (None, "no id", "q"), (9, "very long é text " * 60000, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = [tuple(r) for r in sentence_pieces.digests(docs, PATH).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(found, key=key) == sorted((wanted_row(i, t) for i, t, _ in rows), key=key)
    assert sentence_pieces.digests(docs.where("false"), PATH).count() == 0


def test_decode_is_an_operator_of_its_own(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "")], "doc_id long, text string")
    ids = sentence_pieces.encode(docs, MODEL, end=False)
    nulls = spark.createDataFrame([(3, None)], ids.schema)
    back = {r["doc_id"]: r["decoded"] for r in sentence_pieces.decode(ids.unionByName(nulls), MODEL).collect()}
    assert back == {1: "some text", 2: "", 3: None}


def test_a_model_without_a_leading_blank(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.add_dummy_prefix = False
    path = tmp_path / "plain.model"
    path.write_bytes(proto.SerializeToString())
    library, model = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentence_pieces.Model.read(str(path))
    for text in HARD:
        wanted = library.encode(text)
        found = np.frombuffer(encoder_of(model).encode(text), np.int32)
        assert found.tolist() == wanted
        assert sentence_pieces.Decoder(model).decode(found) == library.decode(wanted)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    for change in (lambda p: setattr(p.normalizer_spec, "remove_extra_whitespaces", True), lambda p: setattr(p.trainer_spec, "model_type", 1)):
        other = sentencepiece_model_pb2.ModelProto()
        other.CopyFrom(proto)
        change(other)
        path = tmp_path / "other.model"
        path.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            sentence_pieces.Model.read(str(path))


def test_the_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    found = sorted(tuple(r) for r in op11_sentence_pieces(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert found == sorted(wanted_row(*r) for r in docs)
