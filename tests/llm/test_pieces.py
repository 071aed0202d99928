"""Pieces of words in the token encoder: the library's ids, and fewer pieces than words."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidegraph.llm import token_binary
from tidegraph.llm.entries import vocabulary


@pytest.fixture(scope="module")
def encoder():
    return token_binary.WordEncoder(vocabulary("word_bpe_49k.json"))


def test_marks_and_digits_are_pieces_of_their_own(encoder):
    encoder.begin()
    encoder.encode(["Word word. word, (word) word-word 12 21 word12"])
    assert set(encoder.known) == {None, b"word", b".", b",", b"(", b")", b"-", b"1", b"2"}


def test_pieces_give_the_ids_of_the_library(encoder):
    draw = random.Random(5)
    parts = [*"abzAZ019'.,-<|>_ \t\n\0\x01\x1f\x85\xa0éßİΣς", "'s", "'ll", "n't", "'RE", "́", "̸", " ", "≠", "K", "`", "<|endoftext|>", "<|StartOfText|>", "</w>", "word", "ﬁ", "日本", "😀"]
    texts = [None, "", *("".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(6000))]
    wanted = [x.ids for x in encoder.library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for size in (1, 7, 2000):  # a group with a special spelling is cut at blanks only
        encoder.begin()
        ids = np.concatenate([encoder.encode(texts[i:i + size]) for i in range(0, len(texts), size)])
        ends = np.flatnonzero(ids == token_binary.END)
        assert [x[:-1].tolist() for x in np.split(ids, ends + 1)[:-1]] == wanted


def test_pieces_that_share_a_slot_or_are_learned_anew(encoder, monkeypatch):
    monkeypatch.setattr(token_binary, "SLOTS", 3)
    monkeypatch.setattr(token_binary, "KEPT_WORDS", 40)
    encoder.begin()
    draw = random.Random(6)
    for _ in range(40):
        text = " ".join("".join(draw.choices("abcdefgh.", k=draw.randint(1, 12))) for _ in range(30))
        assert encoder.encode([text])[:-1].tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) < 200
    monkeypatch.undo()
    encoder.begin()
