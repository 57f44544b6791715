"""The queries of the ten operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import decontamination, language, lines, minhash, mixing, paragraphs, pii, sharding, simhash, substrings
from lattice.sources import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[: pii.BASE])],
        F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = language.predict(docs.select("doc_id", "text"), language.learn(docs))
    return judged.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_cut = F.aggregate("cut", F.lit(0), lambda a, x: a + x["n"]).cast("long")
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "kept_in", n_cut.alias("n_cut"), "n_long", "cut", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents").select("doc_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = F.aggregate("removed", F.lit(0), lambda a, x: a + x["n"]).cast("long")
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_chunks"), count.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_paragraph_dedup": op7_paragraph_dedup,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
}
