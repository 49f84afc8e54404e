"""Rows that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, size string, shard string, range int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "ro", "mi", "len", "so", "ka", "ver"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", "", ".", ",", ".\n"]) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, exact copies, near copies, ties, repeated rows, blanks of all kinds."""
    long = prose(1, 9000)
    near = prose(2, 300).split(" ")
    texts = [None, "", " ", "\n\n", "a", "a b", "A  B\tc", "ß é 漢字 😀", "  lead  and trail  ", long, long, long + " end",
             " ".join(near), " ".join([*near[:150], "changed", *near[151:]]), "under the MIT License; apache license, version 2.0", "Cc-By-Nc", "1d10t s.t.u.p.i.d", "x" * 3000]
    texts += [prose(10 + i, 20 + 7 * i) for i in range(30)] + [prose(40, 60)] * 12
    rows = [(i, t, ["en", None][i % 2], ["b", "a", None, "c"][i % 4] if i % 3 else "a", None if t is None else len(t), 1.5, "x", "y", "z", 7) for i, t in enumerate(texts)]
    rows += [(3, "same id, other text", None, "a", 3, None, None, None, None, None), rows[20], rows[20], (None, "no id", "en", None, 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows
