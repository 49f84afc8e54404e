"""The stages on a planted corpus, step by step and as a run."""

import os
import random

import corpus_pipeline
import pytest
from llm_rows import prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(1)
    passage = prose(999, 80)
    rows = [(i, prose(i, 120), "en", f"s{i % 3}", 0) for i in range(240)]
    rows = [(i, t + (" idiot stupid 1d10t" if i % 6 == 0 else ""), lang, s, n) for i, t, lang, s, n in rows]
    rows += [(300 + k, rows[1][1], "en", "s0", 0) for k in range(5)]
    rows += [(400 + k, prose(2000 + k, 60) + "\n" + passage + "\n" + prose(3000 + k, 60), "en", "s1", 0) for k in range(4)]
    rows += [(500, None, None, None, None), (501, "", "en", None, 0)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, folder)
    assert clean.columns == COLUMNS
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {i for i in range(240) if i % 6 == 0}
    single = steps["near_copies"](spark, clean, folder)
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == COLUMNS and 1 in kept and not kept & set(range(300, 305)) and kept >= {400, 401, 402, 403, 500} and 501 not in kept
    cut = {r["doc_id"]: r["text"] for r in steps["repeated_units"](spark, single, folder).collect()}
    whole = dict(r[:2] for r in rows)
    assert set(cut) == kept and cut[400] == whole[400] and len(cut[401]) < len(whole[401]) - 300 and cut[7] == whole[7] and cut[500] is None
    mixed = steps["mix"](spark, single, folder)
    assert mixed.columns == COLUMNS and mixed.count() > 100
    packed = steps["packing"](spark, mixed, folder)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run_applies_all_stages(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert os.path.isdir(folder)


def test_odd_columns_and_empty_tables(spark, corpus, tmp_path):
    """Columns named like an operator's own results pass through every stage; an empty table stays empty."""
    folder, rows = corpus
    names = ["score", "predicted", "source_size", "target", "copies", "removed_spans", "removed_chars", "label", "size"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.where("doc_id < 40 or doc_id >= 300")
    for k, n in enumerate(names):
        wide = wide.withColumn(n, (docs["doc_id"] * 10 + k).cast(["string", "double"][k % 2]))
    for step, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, wide, folder)
        assert out.columns == wide.columns, step
        some = out.where("doc_id is not null").limit(1).collect()[0]
        assert all(float(some[n]) == some["doc_id"] * 10 + k for k, n in enumerate(names)), step
    assert corpus_pipeline.pack_sequences(spark, wide, folder).count() >= wide.count()
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
