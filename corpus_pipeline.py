"""The corpus pipeline: five stages, each on all that its predecessor kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import decontamination, language, mixing, sharding, simhash
from lattice.llm._shared import discard, written
from lattice.sources import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go.  Null texts and texts without a letter are rejected; null ids and repeats are judged like others."""
    return language.predict(docs.select(*COLUMNS), language.learn(docs)).where("NOT rejected").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the first document of each group stays, by doc_id (null last), then by a hash of the text."""
    return simhash.deduplicated(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: a document with a window of an item goes, however small its share of the document.

    Rows that share a doc_id are judged by their own texts; a null text has no window and stays.
    """
    judged = decontamination.judge(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))
    return judged.where("n_hit = 0").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document has as many rows as the mix takes it, dealt to the output shards and shuffled within them.

    A null source is a source of its own; documents without words weigh nothing.
    """
    return mixing.shuffled(docs.select(*COLUMNS)).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: every row gets its shard; a null doc_id has that of the empty string."""
    return sharding.place(docs.select(*COLUMNS)).select(*COLUMNS, "shard")


STAGES = [("language", identify), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: Compression and 64-bit hashes of shingles are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs.select(*[F.col(c) for c in docs.columns]), f"pipeline-{name}")
            discard(before)
    return docs
