"""Ids by pieces against the library's plain call on a fresh tokenizer, and the size of the store."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import tokens

BITS = ["a", "The", "don't", "it's", "'s", " ", "  ", "   ", "\n", "\n ", "\t", "\r\n", "\x85", "\xa0", "　", "<|endoftext|>", "<|startoftext|>", "<|END", "1", "12", "é", "é", "́", "İ", "ſ", "ß",
        "ẞ", "漢字", "かな", "😀", "👩‍👩", "ª", "×", "µ", "!", "...", "'", "’", "-", "_x", "ﬁ", "\x1c", "\x00", "​", "word,", "Straße.", "...'", "ŉ", "ǅ", "K", "Å", "ʼ", "عر", "हि"]


@pytest.mark.parametrize(("vocabulary", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_those_of_the_plain_call(monkeypatch, vocabulary, words):
    rng, plain = random.Random(5), Tokenizer.from_file(public_tokenizers.path(vocabulary))
    coder = (tokens.WordEncoder if words else tokens.Encoder)(public_tokenizers.path(vocabulary))
    assert coder.encode([]) == [] and coder.encode(["a<|endoftext|>\x851"])[0] == np.array(plain.encode("a<|endoftext|>\x851", add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(tokens, "BYTES", 30_000)  # the store is emptied many times
    monkeypatch.setattr(tokens, "AT_ONCE", 200)
    for _ in range(150):
        texts = ["".join(rng.choice(BITS) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
        for text, got in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("words", [False, True])
def test_texts_without_blanks_leave_nothing_in_the_store(words):
    coder = (tokens.WordEncoder if words else tokens.Encoder)(public_tokenizers.path("word_bpe_49k.json" if words else "byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(5):
        coder.encode(["\n".join(" " + "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(3000)) for _ in range(3)) for _ in range(4)])
    assert coder.held < 5_000
    text = [" ".join(f"w{rng.random()}" for _ in range(2000))]
    coder.encode(text)
    kept = sum(len(k) + len(v) for d in (coder.known, coder.older) for k, v in d.items())
    assert 0 < kept < coder.held < 2_000_000


def test_a_smaller_store_gives_the_same_ids_and_stays_within_its_room(monkeypatch):
    monkeypatch.setattr(tokens, "_encoders", {})
    rng = random.Random(5)
    some = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(60)) for _ in range(400)]
    whole = tokens.encoder().encode(some)
    small = tokens.encoder(room=50_000)
    got = [ids for t in some for ids in small.encode([t])]
    assert got == whole and small.held <= 50_000 + 60 * 400 and len(small.known) + len(small.older) < 1000
    assert tokens.encoder().room == tokens.BYTES
