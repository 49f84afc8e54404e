"""Harmonic packing against the library's plain ids, and the layout of bins."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_rows import odd_rows
from tokenizers import Tokenizer

from tideline.llm import harmonic


def test_cuts_are_the_upper_ends_of_classes():
    for n in [*range(1, 300), 2047, 2048, 2049, 5000]:
        for capacity in (1, 8, 64, 2048):
            got = harmonic.cuts(n, capacity)
            assert sum(got) == n and got == sorted(got, reverse=True)
            assert all(capacity % x == 0 for x in got) and len({x for x in got if x < capacity}) == len([x for x in got if x < capacity])


@pytest.mark.parametrize("seed", range(20))
def test_bins_hold_a_fixed_number_and_leave_no_padding(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 4, 32, 256])
    bins, placed, lengths = harmonic.Bins(capacity, 100), [], []
    for _ in range(rng.randint(0, 400)):
        for length in harmonic.cuts(rng.randint(1, 3 * capacity), capacity):
            lengths.append(length)
            placed += bins.put((len(lengths) - 1, length), length)
    full = len(placed)
    placed += bins.rest()
    assert sorted(p[0] for p, _, _ in placed) == list(range(len(lengths)))
    by_bin = {}
    for k, ((_, length), s, o) in enumerate(placed):
        by_bin.setdefault(s, []).append((o, length, k < full))
    short = 0
    for rows in by_bin.values():
        rows.sort()
        at = 0
        for o, length, _ in rows:
            assert o == at
            at += length
        assert at <= capacity and at & at - 1 == 0
        if rows[0][2]:
            assert len({length for _, length, _ in rows}) == 1 and len(rows) == capacity // rows[0][1]
        short += at < capacity
    assert short <= capacity.bit_length()


def test_pieces_of_every_row(spark, odd, empty):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for r in odd_rows():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for length in harmonic.cuts(len(ids)):
            expected.append((r[0] is None, r[0], at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)))
            at += length
    rows = harmonic.pack(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == sorted(expected)
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_bin.values():
        pieces.sort()
        assert all(o == sum(n for _, n in pieces[:k]) for k, (o, _) in enumerate(pieces))
        total = sum(n for _, n in pieces)
        assert total <= 2048 and total & total - 1 == 0
    assert harmonic.pack(empty).count() == 0
    with pytest.raises(ValueError):
        harmonic.pack(odd, 1000)
