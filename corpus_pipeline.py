"""A corpus pipeline in five stages: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the shared folder and reads it back
as the next stage's docs, so a stage starts from files and a lost executor never reaches back further than one stage. All but the
last return the columns of documents, in their order, whatever further columns there are.

Defined results: a null text counts as empty in every stage; empty texts are near copies of each other, so one of them stays; a text cut to
nothing stays, empty. Null doc_id ranks last: its rows are near copies, repeats or packed pieces like any others. Rows equal in doc_id and
text are one document to near_copies; ties go to the smaller doc_id, then to the lesser hash of the text. A stage that is handed no rows
hands on none, and an empty table gives an empty result. Columns named like an operator's own results (score, predicted, source_size,
target, copies, removed_spans) pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import mixing, near_texts, packing, toxicity, unit_dedup
from tideline.llm.common import stage

#: Bytes of a generation of the encoder's store: earlier stages have grown the executors, so less than where packing runs alone.
PACKING_ROOM = 40_000_000


def kept(docs: DataFrame, own: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The step's rows with the columns of docs, those named like the step's own results included."""
    held = {c: f"_given_{c}" for c in docs.columns if c in own}
    out = step(docs.withColumnsRenamed(held))
    return out.select(*[F.col(held[c]).alias(c) if c in held else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; a model that could not be fitted drops nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kept(docs, ("score", "predicted"), lambda d: toxicity.score(d, labels).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash links, and MinHash bands for what these cannot reach, each link verified
    (five-word similarity of 0.8 or more)."""
    return near_texts.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentences and lines are cut; n_chars follows. A document cut to nothing stays, empty."""
    return kept(docs, ("removed_spans", "removed_chars"), lambda d: unit_dedup.remove_repeats(d).withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so a row may be repeated or left out."""
    taken = lambda d: mixing.mix(d.withColumn("_size", mixing.words()), "_size").where("copies > 0")
    return kept(docs, ("source_size", "target", "copies"), lambda d: taken(d).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2,048 tokens."""
    return packing.pack(docs, room=PACKING_ROOM)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_units", cut_repeats),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
