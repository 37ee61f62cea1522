"""Token counts with a digest cache.

The cache is a Parquet folder of (version, digest, n_tokens).  Texts are looked up by the
SHA-256 digest of their normalised content together with the tokenizer's version digest; only
distinct misses are encoded, and their counts are appended for later runs.

Normalisation must not change a count, so it is the identity on texts; a null text counts as
the empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import bpe
from loglattice.llm import textkit as tk

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
TOKEN_LIMIT = 1024


def content_digest(text: Column) -> Column:
    """32 bytes; equal exactly for equal normalised texts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One row per digest known for this version; empty where there is no cache yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    # Runs that appended at the same time may both hold a digest, with the same count.
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(tokenizer_path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tokenizer_path)
        for batch in batches:
            text = batch.column("text")
            for a, b in tk.column_slices(text, bpe.SLICE_BYTES):
                _, off = encoder.encode(*tk.text_bytes(text.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(a, b - a), pa.array(np.diff(off))], ["digest", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens.  Repeated texts are encoded once; every row
    stays.  Columns of ``docs`` with the names of the outputs are replaced.
    """
    spark = docs.sparkSession
    version = bpe.tokenizer_version(tokenizer_path)
    # Copies are folded before the shuffle, so a text that a third of the rows share is one row a task.
    distinct = docs.select(content_digest(docs[f"`{text_col}`"]).alias("digest"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache_path, version).select("digest"), "digest", "left_anti")
    counted = tk.map_arrow(misses, _counter(tokenizer_path), "digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    # Written, so that no aggregate stands on either side of the join and a text that many rows share can be split.
    known = tk.stored(read_cache(spark, cache_path, version), "token-counts")
    p = tk.fresh(docs)
    digest, size, key, n = (f"{p}{x}" for x in ("digest", "bytes", "known", "n"))
    known = known.select(F.col("digest").alias(key), F.col("n_tokens").alias(n))
    text = docs[f"`{text_col}`"]
    keyed = docs.withColumns({digest: content_digest(text), size: F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")})
    joined = keyed.join(known, F.col(digest) == F.col(key), "left")
    return tk.with_outputs(joined, n_bytes=F.col(size), n_tokens=F.col(n), over_limit=F.col(n) > limit).drop(digest, size, key, n)
