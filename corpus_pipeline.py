"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing and token output.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last
return the columns of docs; the last returns the rows of the token files.

Nulls: a null text isn't toxic, has no duplicates and isn't contaminated, but has no words to mix, so it ends
there.  Repeated rows are near-duplicates of one another, so one stays.  An empty table stays empty.  Extra columns are
carried along up to the mix, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontamination, minhash_dedup, mixing, token_output, toxicity
from tracelake.session import ship
from tracelake.storage import saved, scratch, scratch_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity models reject."""
    ship(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    ship(spark)
    return minhash_dedup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more stems from the benchmark."""
    ship(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources does."""
    ship(spark)
    return mixing.mixture(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns their documents."""
    ship(spark)
    return token_output.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: Neither the models' scores nor the token ids can be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written and read again; a stage's own tables go with its end."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark)
    for name, stage in STAGES[:-1]:
        path = f"{folder}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    name, stage = STAGES[-1]  # its token files stay
    return saved(stage(spark, docs, sf_dir), f"stage-{name}")
