"""The registered queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import textkit as tk
from loglattice.llm import bpe, decontam, fill_middle, fingerprints, line_dedup, mixing, neardup, phrases, pii, quality, rules, token_counts, token_records, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).select("doc_id", toxicity.held_out(docs["doc_id"]).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path()
    cache = f"{tk.shared_dir(spark)}/token-cache/{bpe.tokenizer_version(path)[:16]}"  # later calls find what earlier ones counted
    return token_counts.count_tokens(docs, path, cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tk.work_dir(spark, "token-records")
    token_records.write_records(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_records.read_records(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


#: The key is a parameter of the operator; a deployment passes its own secret.
PSEUDONYM_KEY = "example key, not a secret"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs, model).select("doc_id", toxicity.held_out(docs["doc_id"]).alias("held_out"), "expected_grade", "tail_probability", "selected")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rules.apply_rules(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.inclusion(docs).select("doc_id", "source", "lang", "topic", "probability", "kept")


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("output"), F.col("form")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(output).alias("output_sha256"), sha(fill_middle.restored(output, form)).alias("restored_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_token_records, op4_pseudonyms, op5_line_dedup, op6_quality, op7_quality_rules, op8_source_mix, op9_benchmark_leaks, op10_near_duplicates, op11_fingerprints, op12_phrases, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.SQL, "op7_quality_rules": rules.SQL, "op12_phrases": phrases.SQL, "op13_fill_middle": fill_middle.SQL}
