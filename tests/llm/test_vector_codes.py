"""Product codes against plain integer k-means, and what the bounds may skip."""

import hashlib
import math
import random

import numpy as np
import pytest

from tideline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def plain(rows, parts, entries, rounds, scale):
    """(codes by row, errors, codebooks of all rounds) by full scans in Python integers; rows are (vec_id, embedding, label)."""
    whole = [[math.floor(scale * x) for x in r[1]] for r in rows]
    d = len(whole[0]) // parts
    cut = [[tuple(w[p * d : (p + 1) * d]) for p in range(parts)] for w in whole]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[[cut[i][p] for i in order] for p in range(parts)]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [[min(range(len(books[-1][p])), key=lambda e: (dist(c[p], books[-1][p][e]), e)) for p in range(parts)] for c in cut]  # noqa: B023
        if turn < rounds:
            book = []
            for p in range(parts):
                own = {}
                for c, n in zip(cut, near, strict=True):
                    own.setdefault(n[p], []).append(c[p])
                book.append([tuple(sum(v) // len(v) for v in zip(*own[e], strict=True)) if e in own else old for e, old in enumerate(books[-1][p])])
            books.append(book)
    errors = [sum(dist(c[p], books[-1][p][n[p]]) for p in range(parts)) for c, n in zip(cut, near, strict=True)]
    return ["".join(f"{e:02x}" for e in n) for n in near], errors, books


def drawn(n, dims, seed, spread=0.3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i * 3, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centre)], rng.choice([1, 2, None])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "dims", "parts", "entries", "rounds", "groups"), [(300, 16, 4, 16, 3, 4), (40, 8, 2, 64, 2, 8), (120, 6, 6, 5, 8, 2), (30, 4, 1, 1, 2, 8), (25, 4, 2, 7, 0, 3)])
def test_codes_errors_and_codebooks_are_those_of_full_scans(spark, n, dims, parts, entries, rounds, groups):
    rows = drawn(n, dims, n)
    rows += [(1, rows[5][1], 2), (1, rows[5][1], 2), (4, rows[6][1], None), (None, rows[7][1], 1)]  # copies, an id twice, no id
    rows.append((2, [(x + y) / 2 for x, y in zip(rows[0][1], rows[1][1], strict=True)], 1))
    codes, errors, books = plain(rows, parts, entries, rounds, 256)
    coded, history, work = vector_codes.encode(frame(spark, rows), parts, entries, rounds, 256, groups)
    got = sorted((r["vec_id"] is None, r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_errors(coded).collect())
    total = {}
    for r, e in zip(rows, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    assert got == sorted((r[0] is None, r[0], c, e, total[r[2]]) for r, c, e in zip(rows, codes, errors, strict=True))
    assert [h.tolist() for h in history] == [[[list(e) for e in p] for p in b] for b in books]
    assert vector_codes.digest(history[-1]) == hashlib.sha256(",".join(str(x) for p in books[-1] for e in p for x in e).encode()).hexdigest()
    assert len(work) == rounds and all(scanned <= seen for scanned, seen in work)


def test_bounds_skip_scans_once_entries_settle():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(0, 1, (6, 1, 2, 4)) + rng.normal(0, 0.2, (6, 200, 2, 4)))).astype(np.int64).reshape(-1, 2, 4)
    history, state, shares = [x[:24].transpose(1, 0, 2)], (None, None, None), []
    for _ in range(12):
        coder = vector_codes.Coder(history, 8)
        near, own, bound, stamp = coder.run(x, *state)
        full = np.stack([vector_codes.squared(x[:, p], history[-1][p]) for p in range(2)], axis=1)
        assert (near == full.argmin(axis=2)).all() and (own == full.min(axis=2)).all()
        shares.append(coder.scanned / coder.seen)
        state = (near, bound, stamp)
        sums = np.stack([np.column_stack([np.bincount(near[:, p], x[:, p, k], 24) for k in range(4)] + [np.bincount(near[:, p], minlength=24)]) for p in range(2)]).astype(np.int64)
        history.append(vector_codes.replaced(history[-1], sums))
    assert shares[0] == 1 and shares[-1] < 0.1
    net, steps = vector_codes.moves(history, 1), sum(vector_codes.moves(history[k : k + 2], 1)[0] for k in range(12))
    assert (net[0] <= steps * (1 + 1e-9)).all() and net[0].sum() < 0.9 * steps.sum()


def test_large_numbers_are_exact():
    x = np.array([[2**30, -(2**30)], [2**30 - 1, 5]], np.int64)
    entries = np.array([[2**30, -(2**30)], [0, 0], [2**30 - 1, 4]], np.int64)
    assert vector_codes.squared(x, entries).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in entries] for r in x]


def test_odd_vectors(spark):
    good = drawn(20, 8, 1)
    odd = [(100, None, 1), (101, [], 1), (102, [1.0] * 7 + [None], 1), (103, [1.0] * 7 + [float("nan")], 1), (104, [1.0] * 7 + [float("inf")], None), (105, [1.0] * 7, 1), (106, [1.0] * 16, 1)]
    coded, history, _ = vector_codes.encode(frame(spark, good + odd), 4)
    again, other, _ = vector_codes.encode(frame(spark, good), 4)
    assert sorted(coded.collect()) == sorted(again.collect()) and coded.count() == 20
    assert (history[-1] == other[-1]).all()
    none, books, _ = vector_codes.encode(frame(spark, good).where("false"), 4)
    assert vector_codes.with_label_errors(none).count() == 0 and books == []
    assert vector_codes.encode(frame(spark, odd), 4)[0].count() == 1  # the one of 16 components is the table then
