"""One query for each operator, over its whole table with the contract's parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import conversation_repair, embedding_caps, harmonic, huffman_ids, license_automaton, mixing, packing, sharding, simhash_gray, toxicity, unit_dedup, vector_codes, winnowing
from tideline.llm.common import stage
from tideline.session import configure, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_mix_sources", mixing.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words().alias("size"))
    return mixing.mix(stage(docs, "sizes"), "size").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op2_repeated_units", unit_dedup.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unit_dedup.remove_repeats(docs)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, labels)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_automaton.scan(table(spark, sf_dir, "documents"))


@query("op7_winnowing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op4_minimax_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op1_cap_filters")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_caps.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_huffman_ids")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "huffman")
    huffman_ids.write(table(spark, sf_dir, "documents"), path)
    return huffman_ids.read(spark, path)


@query("op13_vector_codes", vector_codes.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks, _ = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    named = F.lit(vector_codes.digest(codebooks[-1] if codebooks else None))
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", named.alias("codebooks_sha256"))


@query("op12_conversation_repair", conversation_repair.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), rows)


@query("op11_harmonic_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack(table(spark, sf_dir, "documents"))
