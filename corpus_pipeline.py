"""A corpus pipeline of five operators: toxicity, quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of
``documents``; ``run`` writes what a stage returns as Parquet in the folder that
all executors share and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import packing, quality, repeats, simhash, toxicity
from tidewater.llm.base import shared_folder, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the nearest labelled examples say are toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the weakly trained scorer rejects."""
    return quality.keep_good(docs, quality.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that an earlier document has."""
    return repeats.cut_spans(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' segments in sequences of balanced cost."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: The classifier's training isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; an empty table gives none."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
