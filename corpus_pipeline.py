"""A training corpus from documents: toxic ones go, one of each near-duplicate group stays, sources are mixed, the mix is packed.

Stages take and return the columns of documents, extra ones of any name included; packing returns its pieces. Null ids:
judged by their texts, no near duplicate of any row, mixed and packed. Null, empty and blank texts: not toxic without
evidence, no near duplicates, of size 0 and so not taken by the mix. Null sources are one source. Repeated rows: all
are judged, one stays of those whose texts link. Ties go to the smallest id. Texts of any length are read whole; the mix
cuts the last one that a source's target reaches. Empty table: empty result. Labels that tell nothing: nothing goes as toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.common import discard, materialize
from lumenfold.llm.curriculum import mixed_documents
from lumenfold.llm.minhash import without_near_duplicates
from lumenfold.llm.packing import pack_documents
from lumenfold.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weak supervision: documents that score 0.7 or more go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash over five-word shingles, similarity 0.8 or more: the document of smallest id of each group stays."""
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Curriculum mix at 150 % of the words left, in training order, repeats as rows."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("source mix", mix_sources), ("packing", pack)]

#: No SQL can express MinHash, the classifier or byte-pair encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input; what the stage before wrote is then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
