"""Operators 9 and 4 against the public libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cryoframe.llm import bpe, token_counts
from cryoframe.llm.common import pieces

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TRICKY = ["", None, " ", "a", "don't  stop\n\n now", "été 中文字 🙂🙂", "x" * 3000, "1234567890" * 50, "\t \n ", "<|endoftext|> a<|endoftext|>", "   x", "a" + "́" * 40, "the the the", "!!?? ''' 's're"]


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec.get(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return [i for some in codec.encode(text) for i in some]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdetionhs éüß中文\n\t '’s🙂12!.,-<|>"), max_size=80))
def test_transducer_is_the_library(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)


def test_small_tables_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_TRANSITIONS", 20)
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    monkeypatch.setattr(bpe, "STRETCH", 7)
    codec.machine.reset()
    for text in filter(None, TRICKY):
        assert ids(codec, text) == library.encode_ordinary(text)


def test_merges_out_of_rank_order():
    """A vocabulary whose parts are younger than the whole still gives what its merges give."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 300, b"cd": 301, b"bc": 302, b"abcd": 303, b"aa": 304}
    machine = bpe.Transducer(ranks)
    for text in ("abcd", "aabcd", "abccd", "aaabcabcdab", "bcd" * 5):
        want = [ranks[t] for t in machine.merged(text.encode())] if text.encode() not in ranks else [ranks[text.encode()]]
        assert list(machine.piece(text.encode())) == want


def test_decoder_joins_characters_across_tokens(codec):
    text = "中文字 🙂 é"
    parts = list(codec.decode([[i] for i in ids(codec, text)]))
    assert b"".join(b for b, _ in parts) == text.encode() and "".join(s for _, s in parts) == text
    assert "".join(s for _, s in codec.decode([[codec.machine.ranks[b"\xf0"]]])) == "�"


def test_round_trip_of_rows(spark, library):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TRICKY)] + [(None, "no id", None), (3, "a", "again")], "doc_id bigint, text string, token_ids string")
    for r in bpe.round_trip(docs, RANKS, P.PATTERN, with_ids=True).collect():
        text = "no id" if r.doc_id is None else TRICKY[r.doc_id] or ""
        want = library.encode_ordinary(text)
        assert r.token_ids == want and r.n_tokens == len(want) and r.same_text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    tokens = bpe.encode(docs, RANKS, P.PATTERN)
    assert {(r.doc_id, r.text) for r in bpe.decode(tokens, RANKS, P.PATTERN).collect()} == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_pieces_cut_between_tokens(library):
    text = "one two  three\nfour\n five ... six" * 20
    for most in (1, 3, 10, 50):
        parts = list(pieces(text, most))
        assert "".join(parts) == text
        assert sum((library.encode_ordinary(p) for p in parts), []) == library.encode_ordinary(text)
    assert list(pieces("x" * 100, 10)) == ["x" * 100]


def test_token_counts(spark, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate([*TRICKY, "word and word " * 40_000])] + [(None, "x y")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_batches_are_balanced():
    """By bytes: a character of three bytes weighs three times."""
    parts = ["ab", "", "中" * 10, "c" * 30, "x" * 200, "tail", "é"]
    batches = list(token_counts.balanced(parts, 64))
    assert sum(batches, []) == parts
    assert all(len("".join(b).encode()) <= 64 or len(b) == 1 for b in batches) and len(batches) == 3


@pytest.mark.parametrize("stretch", [7, 64, 1 << 20])
def test_segments_are_the_text(monkeypatch, stretch):
    monkeypatch.setattr(token_counts, "STRETCH", stretch)
    for text in ["", "x", "  a b\n\n c\td  e ", "long text " * 100, "x" * 500, "x" * 90 + " y " + "z" * 90, " 中文 字 " * 20]:
        assert "".join(sum(token_counts.segments(text), [])) == text


def test_counts_through_generations(monkeypatch):
    """Segments that are forgotten, kept from the generation before, or too long to keep count alike."""
    path = P.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "MOST_KEPT", 40)
    monkeypatch.setattr(token_counts, "STRETCH", 300)
    counter, tokenizer = token_counts.Counter(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    rng = random.Random(3)
    for _ in range(12):
        texts = [" ".join(rng.choice(["the", "of", "x" * 60, f"n{rng.randrange(200)}", "a\tb", "don't\n"]) for _ in range(rng.randrange(150))) for _ in range(4)]
        assert counter.count(texts).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counter.before) > 0


def test_token_counts_of_odd_tables(spark):
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "z"), (2, None, None)], "doc_id bigint, text string, n_tokens string")
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect()) == [(1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False)]
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
