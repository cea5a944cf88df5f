"""op4 against the library that owns the vocabulary."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadloom.llm.tokens import Counter, byte_names, read_merges, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return Counter(read_merges(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_byte_names():
    assert byte_names()[32] == "Ġ" and byte_names()[10] == "Ċ" and len(set(byte_names())) == 256


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text(counter, library, texts):
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want


def test_runs_specials_and_blanks(counter, library):
    rng = random.Random(1)
    texts = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(30)] + ["<|endoftext|>", "x<|endoftext|><|endoftext|> y", " <|endoftext|>  ", "don't  we'll\n\n  x\u0085y\x1c z　"]
    texts += ["".join(rng.choice("etaoin shrdlu\n'.0é中") for _ in range(300)) for _ in range(60)]
    assert counter.count(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_does_not_change_counts(library):
    import threadloom.llm.tokens as tokens

    old, tokens.REMEMBERED = tokens.REMEMBERED, 5
    try:
        got = Counter(read_merges(PATH))
        for text in ("some words that are here", "other words that come then", "some words"):
            assert got.count([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    finally:
        tokens.REMEMBERED = old


def test_odd_rows(odd, nothing, library):
    got = token_counts(odd.withColumnRenamed("author", "n_tokens"), PATH).collect()
    assert len(got) == 13
    for r in got:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
    assert token_counts(nothing, PATH).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        read_merges(public_tokenizers.path("word_bpe_49k.json"))
    assert isinstance(read_merges(PATH)["key"], np.ndarray)
