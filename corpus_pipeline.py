"""A training-corpus pipeline: five stages, each one of the library's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as
Parquet and reads it again as the next stage's docs. All but the last return the
columns of documents; the last returns them with the shard each row is in.

Defined cases, stage by stage: a null, empty or blank text has no words, so the quality rules reject its row, and an empty table
gives empty tables throughout. Repeated rows are one document after near_duplicates, as are equal texts; a null doc_id or source is a value like others.
Very long texts are rows like others (a decontamination candidate carries some of the words, not the text). Columns that
operators add take clashing names out of the way and are gone at a stage's end, except for the shard's at the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, jaccard, mixing, quality, sharding
from docloom.llm.common import forget, scratch, written
from docloom.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines over the limit are cut from the others."""
    return quality.keep_good(docs, max_docs=quality.MAX_DOCS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles at 0.8 stays: the smallest doc_id."""
    return jaccard.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in 5 % of their words or more go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at their source's rate."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in target-sized shards under a manifest, each row with its shard."""
    return sharding.shard_rows(sharding.shard(docs, scratch(spark, "corpus")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Components of near duplicates are a transitive closure over all pairs: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the corpus. A stage's table is deleted once the next one is written, the last one's once the store has it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    forget(docs)
    return out
