"""The table of last tokens next to the sentencepiece library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelltrail.llm import pieces

MODEL = pieces.read_model("piece_bpe_32k.model")
PIECES = pieces.Pieces(MODEL)
TABLE = pieces.PrefixTable(PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

TEXTS = [
    "", " ", "a", "Hello world's best.", "  two  spaces \n\n\n tabs\t\tx", "ééàü ßẞ 東京 🙂🙂🏽 ‍", "1234567890 12,345.67", "x" * 5000,
    "ab" * 3000, "=" * 1000 + "-" * 777, "<s> </s> <unk> <0x41> don't", "\x1c\x1d\x85  　 end", "a\x00b", "aaab" * 999 + "Z",
    "▁a ▁▁ b▁", " " * 11, " " * 17 + "x", " " * 500, "the" + " " * 40 + "the\r\n", "東 京the▁", "�⁇", "ﬁ ① Ⅳ",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text):
    ids = LIBRARY.encode(text)
    assert TABLE.encode(text) == ids
    decoder = pieces.PieceDecoder(PIECES.surfaces, [kind == pieces.BYTE for kind in MODEL["kinds"]])
    assert decoder.text(ids) + decoder.finish() == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text("abeth \n▁", max_size=200) | st.text(" ▁t", max_size=90) | st.text("instructor ", max_size=300))
def test_equals_the_library_on_any_text(text):
    assert TABLE.encode(text) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, len(MODEL["pieces"]) - 1), max_size=40), st.integers(1, 5))
def test_decodes_any_ids_as_the_library(ids, at_once):
    decoder = pieces.PieceDecoder(PIECES.surfaces, [kind == pieces.BYTE for kind in MODEL["kinds"]])
    assert "".join(decoder.text(ids[i : i + at_once]) for i in range(0, len(ids), at_once)) + decoder.finish() == LIBRARY.decode(ids)


def test_pairs_that_fit():
    rng = random.Random(3)
    some = rng.sample(sorted(TABLE.sizes), 250) + [i for name, i in PIECES.ids.items() if set(name) == {pieces.SPACE}] + [PIECES.symbol("\n")]
    for left in rng.sample(some, 80):
        for right in some:
            assert TABLE.fits(left, right) == TABLE._merged_apart(left, right)


def test_every_prefix_has_its_last_token():
    for text in ["▁instructional▁the▁▁there", "▁Über\nstraße▁"]:
        last = TABLE.last_tokens(text)
        for end in range(1, len(text) + 1):
            assert PIECES.name(last[end - 1]) == PIECES.merged(text[:end])[-1][0]


def test_steps_as_defined():
    for text in TEXTS:
        if len(text) < 100:
            assert PIECES.encode_as_defined(text) == LIBRARY.encode(text)


def test_full_memories_start_anew(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_SEGMENTS", 3)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 5)
    monkeypatch.setattr(pieces, "LONG_TEXT", 9)
    monkeypatch.setattr(pieces, "AT_ONCE", 2)
    table = pieces.PrefixTable(PIECES)
    for text in TEXTS:
        assert table.encode(text) == LIBRARY.encode(text)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.read_model(str(tmp_path / "m"))


def test_documents_and_round_trip(spark, monkeypatch):
    rows = [(i, text, "extra", 1) for i, text in enumerate([*TEXTS, None, TEXTS[3]])] + [(None, "a b", "x", 2), (3, "again", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").coalesce(1)
    monkeypatch.setattr(pieces, "IDS_OUT", 50)
    encoded = pieces.encode_documents(docs, MODEL, keep_ids=True)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in encoded.collect()]
    expected = []
    for doc_id, text, _, _ in rows:
        ids = LIBRARY.encode(text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        expected.append((doc_id, len(ids), *digests, ids))
    assert sorted(got, key=str) == sorted(expected, key=str)
    texts = [r.text for r in pieces.decode_documents(encoded, MODEL, at_once=3).collect()]
    assert sorted(texts) == sorted(LIBRARY.decode(x[4]) for x in expected)


def test_no_rows(spark):
    assert pieces.encode_documents(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
