"""Words spaced out beside other words of one letter, several in a row, and cut into groups."""

import numpy as np
import pytest

from tideline.llm import toxicity


@pytest.fixture(scope="module")
def reader():
    counts = np.zeros(toxicity.BUCKETS, np.float32)
    words = {"idiot": 50, "stupid": 50, "loser": 40, "the": 500, "letter": 90, "moon": 60, "a": 300, "i": 250, "am": 120, "you": 200, "are": 200, "is": 200, "it": 200, "to": 300, "be": 150, "no": 90}
    for word, times in words.items():
        for _, codes in toxicity.word_codes([word]):
            for n in (1, 2, 3):
                np.add.at(counts, toxicity.slots(codes, n)[:, 1:].ravel(), times)
    return toxicity.Reader(counts)


@pytest.mark.parametrize(("seen", "meant"), [
    ("a l o s e r", "a loser"), ("I a m s t u p i d", "i am stupid"), ("y o u i d i o t", "you idiot"), ("the id iot moon", "the idiot moon"), ("the lo ser.", "the loser"),
    ("you are a l 0 s e r", "you are a loser"), ("i d i o t l o s e r", "idiot loser"), ("s t u u u u p i d", "stupid"), ("to be or it is no letter", "to be or it is no letter"), ("it is a moon", "it is a moon")])
def test_spaced_words_come_apart(reader, seen, meant):
    assert " ".join(reader.words(seen)) == meant


def test_readings_of_runs_are_the_cheapest(reader):
    for run in ("a l o s e r", "i a m", "id iot", "lo ser a", "s t u u u p i d", "l 0 s e r", "mo on s t"):
        parts = run.split()
        ways = []
        for cut in range(1 << (len(parts) - 1)):
            words, total = [[parts[0]]], 0.0
            for k, p in enumerate(parts[1:]):
                if cut >> k & 1:
                    words.append([p])
                else:
                    total += toxicity.GAP_COST if len(words[-1][-1]) == len(p) == 1 else toxicity.BLANK_COST
                    words[-1].append(p)
            whole = ["".join(w) for w in words]
            if all(len(w) <= toxicity.GROUPS or len(x) == len(w) for w, x in zip(words, whole, strict=True)) and all(len(w) == 1 or x.isalpha() or toxicity.disguised(x) for w, x in zip(words, whole, strict=True)):
                ways.append((total + sum(map(reader.decoder.word_cost, whole)), whole))
        assert reader.segment(tuple(parts)) == min(ways)[1]
