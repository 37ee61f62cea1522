"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Every stage but the last returns the columns that it got, others than those of ``documents``
included.  Null texts count as empty; rows without an id, language or source are rows like all
others; of an empty table nothing is left, and without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglattice.llm import decontam, mixing, neardup, token_records, toxicity
from loglattice.llm import textkit as tk
from loglattice.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not reject; texts without words stay unless most labelled ones are toxic."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id, null ids last; of rows equal in id and text, any one."""
    return neardup.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty ones hold none."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic marginals; a null is a category, and rows equal in id and text are decided alike."""
    return mixing.sample(docs)


def write_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all documents, read back: a row per record, null ids first; an empty text is the end id alone."""
    folder = tk.work_dir(spark, "pipeline-records")
    token_records.write_records(docs, folder, tokenizer_path())
    return token_records.read_records(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_records", write_token_records),
]

#: A compression model, hashed signatures and a tokenizer are not expressible in SQL; the tests
#: hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tk.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
