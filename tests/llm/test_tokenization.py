"""Word-wise encoding gives the ids of the library over whole texts."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm.tokenization import Encoder, word_keys

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
OWN = Encoder(PATH)
PIECES = ["the ", "a<|endoftext|>b", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", " ", "\n\n", "it's", "é", " ́", "123", "K", "x​y", "İ", "end.", "\t", "ß", "😀", "<|startoftext|><|endoftext|>"]


def same(texts):
    own = [list(memoryview(x).cast("H")) for x in OWN.ids(texts)]
    assert own == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=12).map("".join), min_size=1, max_size=4))
def test_any_text(texts):
    same(texts)


@pytest.mark.parametrize("text", ["", " ", "x" * 50_000, "word " * 30_000, "<|endoftext|> <|endoftext|>"])
def test_edges(text):
    same([text, text])


def test_memo_is_merged_and_cut(monkeypatch):
    import random

    monkeypatch.setattr("pulsegrid.llm.tokenization.MEMO_WORDS", 40)
    monkeypatch.setattr("pulsegrid.llm.tokenization.FRESH_WORDS", 10)
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcé0'", k=rnd.randint(1, 40))) for _ in range(120)]
    for _ in range(60):
        same([" ".join(rnd.choices(words, k=9)) for _ in range(3)])


def test_words_of_one_mix(monkeypatch):
    monkeypatch.setattr("pulsegrid.llm.tokenization.word_keys", lambda data, starts, sizes, f=word_keys: (np.zeros(len(starts), np.uint64), f(data, starts, sizes)[1]))
    same(["one two three one", "two four"])


def test_other_tokenizer_is_encoded_whole():
    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    t = ["Hello  world <|endoftext|>"]
    got = [list(memoryview(x).cast("H")) for x in other.ids(t)]
    assert got == [x.ids for x in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(t, add_special_tokens=False)]
