"""Scores separate at any share of toxic labels."""

import random

import pytest

from tideline.llm import toxicity


@pytest.mark.parametrize("base", [0.05, 0.5, 0.8])
def test_scores_separate_whatever_the_share_of_toxic_labels(spark, base):
    rng, n = random.Random(6), 1200
    toxic = {i for i in range(n) if rng.random() < base}
    plain = lambda: " ".join(rng.choice(["tree", "house", "river", "cloud", "stone"]) for _ in range(30))
    docs = spark.createDataFrame([(i, plain() + (" " + " ".join(rng.sample(["idiot", "stupid", "loser"], 2)) if i in toxic else "")) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(n)], "doc_id long, toxic int")
    assert {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 1").collect()} == toxic
