"""A corpus in five stages: toxic documents go, lines and near duplicates are thinned out, benchmark leaks go, the rest is tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
keep the columns of ``documents``.

In every stage rows with a null ``doc_id`` or ``text`` and empty texts stay
(they are neither toxic nor copies nor leaks), extra columns are kept whatever
their names, and an empty table stays empty. Rows that share a ``doc_id`` are
treated as one document where stages go by ``doc_id``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, decontam, line_dedup, ngram_join, toxicity
from lexforge.llm._text import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model fitted on the labels calls toxic go; without both kinds of labels none does."""
    return toxicity.harmless(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier one go, and documents of which nothing else was left."""
    return line_dedup.dedup_lines(docs)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links connect, the document of least ``doc_id`` stays."""
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim match of a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, every row kept; a null text has null tokens."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_near_duplicate),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", tokenise),
]

#: SQL can't train and scan for toxic passages, nor merge byte pairs. Tests compare line dedup, n-gram join, decontamination and BPE with brute force, toxicity with held-out labels, and the run with its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what each returns is written to the shared folder and read again."""
    shared_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
