"""The transducer next to the tiktoken library, and exact round trips."""

import gc
import hashlib
import random

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shelltrail.llm import bpe

RANKS = bpe.vocabulary("byte_bpe_50k.tiktoken")
MACHINE = bpe.Transducer(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=MACHINE.ranks, special_tokens={})
MATCHES = regex.compile(bpe.pattern())

TEXTS = [
    "", " ", "a", "Hello world's best.", "  two  spaces \n\n\n tabs\t\tx", "ééàü ßẞ 東京 🙂🙂🏽 ‍", "1234567890 12,345.67", "x" * 5000,
    "ab" * 3000, "=" * 1000 + "-" * 777, "<|endoftext|> don't I'LL we're", "\x1c\x1d\x1e\x1f\x85  　 end", "a\x00b", "aaab" * 999 + "Z",
]


def ids_of(text):
    return [i for piece in MATCHES.findall(text) for i in MACHINE.piece(piece)]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("abe \n'st", max_size=300) | st.text("ab", max_size=400))
def test_equals_the_library_on_any_text(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)
    assert list(MACHINE.feed(text.encode())) == MACHINE.merged(text.encode())


def test_a_long_piece_is_written_before_its_end():
    feed = MACHINE.feed(b"ab" * 50_000)
    assert next(feed) is not None and feed.gi_frame.f_locals["n"] < 5000


def test_a_full_machine_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 20)
    monkeypatch.setattr(bpe, "MOST_PIECES", 6)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 8)
    machine = bpe.Transducer(RANKS)
    for text in TEXTS:
        assert [i for piece in MATCHES.findall(text) for i in machine.piece(piece)] == LIBRARY.encode_ordinary(text)


def made_up_words(count):
    rng = random.Random(7)
    parts = ["th", "in", "ation", "er", "re", "on", "ous", "ing", "ent", "ly", "éa", "sch", "qu", "ra"]
    return [" " + "".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(count)]


def test_prefixes_share_states():
    machine = bpe.Transducer(RANKS)
    words = made_up_words(6000)
    assert [i for word in words for i in machine.piece(word)] == LIBRARY.encode_ordinary("".join(words))
    assert len(machine.states) < 4000


def test_a_machine_leaves_nothing_behind():
    machine = bpe.Transducer(RANKS)
    gc.collect()
    gc.disable()
    try:
        empty = len(gc.get_objects())
        for word in made_up_words(2000):
            machine.piece(word)
        del machine
        assert len(gc.get_objects()) < empty
    finally:
        gc.enable()


@pytest.mark.parametrize("ids_out", [1 << 18, 300])
def test_documents_and_round_trip(spark, monkeypatch, ids_out):
    monkeypatch.setattr(bpe, "IDS_OUT", ids_out)
    rows = [(i, text, "extra") for i, text in enumerate([*TEXTS, None, TEXTS[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode_documents(docs, RANKS, keep_ids=True)
    got = {r.doc_id: r for r in encoded.collect()}
    for doc_id, text, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        assert got[doc_id].ids == ids and got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, RANKS, at_once=3).collect()} == {i: t or "" for i, t, _ in rows}


def test_no_rows(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_long_texts_are_read_in_parts():
    text = "some words, " * 2000
    assert [p for some in bpe.pieces(MATCHES, text, 100, 50) for p in some] == MATCHES.findall(text)


def test_pairs_that_fit():
    rng = random.Random(3)
    tokens = rng.sample(sorted(MACHINE.tokens), 300)
    for left in tokens[:60]:
        for right in tokens:
            pair = MACHINE.merged(MACHINE.tokens[left] + MACHINE.tokens[right])
            assert MACHINE.pair_fits(left, right) == (pair == [left, right])
