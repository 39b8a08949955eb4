"""A corpus pipeline of the training-data operators, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
to the shared folder and reads it again as the next stage's docs. All but the last
return the columns of documents; the last adds ``copies``, how often a document is taken.

Defined results, as told by each operator: a null text is an empty one in every stage and no
stage drops it for that, but of several only one stays after exact dedup and, as it has no
words, the mix takes it as its source's share says; a very long text is scored, compared,
aligned and counted whole; of repeated rows one stays; rows without an id stay through near-dedup
and share their fate in the mix; ties go to the smallest doc_id; an empty table passes all
stages; further columns are carried untouched, but one named copies is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfall.llm import decontaminate, exact_dedup, minhash_dedup, mixing, toxicity
from tarnfall.llm.common import delete, settled


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more as toxic go."""
    model = toxicity.train_fold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.dedup(docs, keep="min")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return minhash_dedup.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their sources' target weights."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The models and alignments have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a stage and its predecessor wrote are deleted once
    the stage's result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, path = settled(spark, f"stage-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        delete(spark, last)
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
