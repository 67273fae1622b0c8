"""Alignment next to a plain version over whole texts."""

import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelltrail.llm import alignment

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FIRST = alignment.tokenizer_file("byte_bpe_50k.json")
SECOND = alignment.tokenizer_file("piece_bpe_32k.model")
PAIR = alignment.Pair(FIRST, SECOND)
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

TEXTS = [
    None, "", " ", "a", "Hello world's best.", "  two  spaces \n\n\n tabs\t\tx", "ééàü ßẞ 東京 🙂🙂🏽 ‍", "12345 12,345.67", "x" * 500, "ab" * 300,
    "<|endoftext|> <s> </s> <0x41>", "\x1c\x1d\x85  　 end", "a\x00b", "with ▁ inside", "▁", "ends in space ", "and in two  ", "line\n", "line \n ",
    "\n\n x\r\n y", " the the the the", "aaaa aaaaaaa aaaa", "東京都 東京 京都 京都", "the the", "İstanbul ŉ ǰ",
]


def plain_tokens(text):
    """(ids and byte lengths of A, of B), or none."""
    data = (" " + (text or "")).encode()
    a, b = A.encode(" " + (text or ""), add_special_tokens=False), B.encode(text or "")
    letters = alignment.byte_of_letter()
    a = [(i, bytes(letters[c] for c in A.id_to_token(i))) for i in a.ids]
    b = [(i, bytes((int(B.id_to_piece(i)[3:5], 16),)) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in b]
    if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return None
    return [(i, len(x)) for i, x in a], [(i, len(x)) for i, x in b]


def spans(tokens):
    at, out = 0, []
    for i, n in tokens:
        out.append((i, at, at + n))
        at += n
    return out


def plain(texts):
    rows, corpus = [], Counter()
    for text in texts:
        tokens = plain_tokens(text)
        if tokens is None:
            rows.append(None)
            continue
        a, b = map(spans, tokens)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts = sorted({e for _, _, e in a} & {f for _, _, f in b})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)))
        corpus.update(links)
        rows.append((len(a), len(b), links, groups))
    most = Counter()
    for (_, j), n in corpus.items():
        most[j] = max(most[j], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = row
            best = sum(corpus[x] == most[x[1]] for x in links)
            total = sum(corpus[x] for x in links)
            out.append((n_a, n_b, len(groups), len(links), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def found(spark, texts, **options):
    docs = spark.createDataFrame([(i, text, 1, "x") for i, text in enumerate(texts)], "doc_id long, text string, pairs int, row string").repartition(3)
    rows = alignment.tokenizer_alignment(docs, FIRST, SECOND, **options).collect()
    return [tuple(row)[1:] for row in sorted(rows)]


def fixture(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["the", "ü", "\n", " ", "東京", "'s", "12"]
    return TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)] + ["the the"]


@pytest.mark.parametrize("hot", [1 << 17, 25, 0])
def test_equals_plain(spark, hot):
    texts = fixture(hot)
    assert found(spark, texts, hot=hot) == plain(texts)


def test_small_steps(spark, monkeypatch):
    for name, value in (("STEP_CHARS", 40), ("AT_ONCE", 3), ("ENTRIES_OUT", 10), ("MOST_SEGMENTS", 6)):
        monkeypatch.setattr(alignment, name, value)
    texts = fixture(5)
    assert found(spark, texts) == plain(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n\t'st", max_size=80) | st.lists(st.sampled_from(["the", " ", "  ", "\n", "é", "'s", "x1", "　"]), max_size=20).map("".join))
def test_segments_have_the_tokens_of_the_whole(text):
    segments = alignment.SEGMENTS.findall(" " + text)
    assert "".join(segments) == " " + text
    if text:
        encoded = PAIR.encode(segments)
        assert [i for a, _ in encoded for i in a] == A.encode(" " + text, add_special_tokens=False).ids
        assert [i for _, b in encoded for i in b] == B.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab▁ é東'\n", max_size=7) | st.sampled_from(["the", "x  y", "instructor"]), max_size=12))
def test_rows_of_segments_equal_single_ones(words):
    segments = list(dict.fromkeys(alignment.SEGMENTS.findall("".join(" " + word for word in words))))
    assert PAIR.aligned(segments) == [PAIR.align(x, *ids) for x, ids in zip(segments, PAIR.encode(segments))]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60) | st.text("aeéß 'stx12\n\x1c\x85\xa0", max_size=90))
def test_ranks_give_the_ids_of_the_library(text):
    assert PAIR.quick.encode_ordinary(text) == A.encode(text, add_special_tokens=False).ids


def test_identity_has_the_same_bytes():
    there = [(a, b) for a, b in enumerate(PAIR.identity.tolist()) if b >= 0]
    assert len(there) > 10_000 and all(PAIR.a_bytes[a] == PAIR.b_bytes[b] for a, b in there)


def test_repeated_and_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "the cat"), (5, "the cat"), (None, "the cat"), (5, None)], "doc_id long, text string")
    rows = alignment.tokenizer_alignment(docs, FIRST, SECOND).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["5", "5", "5", "None"]
    assert sorted(r.count_sum for r in rows) == [0, 6, 6, 6]
    assert alignment.tokenizer_alignment(docs.limit(0), FIRST, SECOND).count() == 0
