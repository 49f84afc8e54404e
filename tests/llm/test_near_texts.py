"""Near copies at a five-word similarity of 0.8 and more against all pairs."""

import random

import corpus_pipeline
import pytest
from llm_rows import prose

from tideline.llm import near_texts


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def planted():
    """Copies with words changed one by one until the similarity would fall below a target between 0.8 and 0.95."""
    rng, rows, pairs = random.Random(3), [], []
    for i in range(120):
        words = prose(5000 + i, 200).split(" ")
        target, copy = 0.8 + 0.15 * (i % 16) / 16, list(words)
        while True:
            tried = list(copy)
            tried[rng.randrange(len(tried))] = f"changed{rng.random()}"
            if similarity(" ".join(words), " ".join(tried)) < target:
                break
            copy = tried
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        pairs.append((2 * i, 2 * i + 1))
    for i in range(40):  # alike by less than 0.8: both stay
        words = prose(9000 + i, 200).split(" ")
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join(words[:75] + prose(9500 + i, 30).split(" ") + words[105:]))]
    return rows, pairs


def test_stage_catches_near_copies_and_only_these(spark, planted):
    rows, pairs = planted
    assert all(0.8 <= similarity(rows[a][1], rows[b][1]) < 0.97 for a, b in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {a for a, _ in pairs} | {i for i, _ in rows if i >= 1000}


def test_groups_are_the_components_of_all_verified_pairs(spark, odd, empty):
    base, rng = prose(77, 120).split(" "), random.Random(8)
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # a cloud around the bound: many members of a bucket fail with its head
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"other{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    group = {i: i for i, _ in rows}
    find = lambda i: i if group[i] == i else find(group[i])
    for i, a in rows:
        for j, b in rows[:i]:
            if similarity(a, b) >= 0.8:
                group[find(i)] = find(j)
    least = {}
    for i, _ in rows:
        least.setdefault(find(i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in near_texts.keep_one(docs).collect()} == set(least.values())
    assert near_texts.keep_one(empty).count() == 0 and near_texts.keep_one(odd).columns == odd.columns


def test_simhash_links_are_proposed_and_verified(spark, planted, monkeypatch):
    """Without MinHash buckets the stage still finds what the SimHash index links, and links nothing below the bound."""
    monkeypatch.setattr(near_texts, "band_keys", lambda found: [near_texts.signed(hash(found.tobytes()) & (1 << 64) - 1)])
    rows, _ = planted
    long = [(3000 + i, prose(11000 + i, 900)) for i in range(12)]
    long += [(3100 + i, t + " tail") for i, (_, t) in enumerate(long)]
    docs = spark.createDataFrame(rows + long, "doc_id long, text string").repartition(4)
    found = near_texts.marks(docs).select("doc_id", "set_id", "fp").collect()
    by_set, by_doc = ({r[c]: r["fp"] & (1 << 64) - 1 for r in found} for c in ("set_id", "doc_id"))
    asked = near_texts.hashed_alike(near_texts.marks(docs)).collect()
    assert asked and all((by_set[a] ^ by_set[b]).bit_count() <= 3 for a, b in asked)
    near = {i for i in range(12) if (by_doc[3000 + i] ^ by_doc[3100 + i]).bit_count() <= 3}
    kept = {r["doc_id"] for r in near_texts.keep_one(docs).collect()}
    assert near and kept & set(range(3100, 3112)) == {3100 + i for i in range(12) if i not in near}
    assert kept >= {i for i, _ in rows if i >= 1000}
