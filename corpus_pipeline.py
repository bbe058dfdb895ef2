"""A corpus pipeline: quality filter, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's
documents. Nulls, ties, empty tables and further columns are treated as the operators' modules
say; rows with a null doc_id go through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import decontaminate, mixing, quality, secrets, simhash
from pluvia.llm.common import fold, shared_dir, table, written

#: SQL can express neither the network nor the automata; tests hold run() against a plain version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of quality is under 0.3 go; it is learned outside the held-out fold of all documents given."""
    net = quality.train(docs, table(spark, sf_dir, "labels"), keep=~fold("doc_id", 5, 0))
    return quality.keep(docs, net, 0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials in the texts give way to a mark; n_chars follows the text, and every document stays."""
    done = secrets.redact(docs, secrets.infer(docs))
    if "n_chars" not in docs.columns:
        return done
    kind = docs.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, with its source's size and target."""
    return mixing.mix(written(mixing.sized(docs), "sizes"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("mixing_sources", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
