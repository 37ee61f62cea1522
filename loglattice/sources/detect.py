"""What kind of source a file is, by its name and content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.sources import splits

# Kinds that a file's extension tells.
BY_EXTENSION = {"reg": "reg", "evtx": "evtx_binary", "pcap": "capture_binary", "pcapng": "capture_binary", "cap": "capture_binary", "yar": "yara_rules", "yara": "yara_rules", "dat": "hive_binary", "hve": "hive_binary"}
LOG_EXTENSIONS = ("log", "txt", "json", "jsonl", "csv")

# By extension, what a text file's lines hold (all of the patterns, anywhere in the file), most special first.
BY_LINES = (
    (("txt",), "thor", (r" THOR: ",)),
    (("csv",), "thor_csv", (r"^[0-9a-fA-F]{32},",)),
    (("json", "jsonl", "log"), "osquery", (r'"hostIdentifier"', r'"unixTime"')),
    (("txt", "log"), "crowdstrike", (r"Host name:", r"Description:|Agent ID:")),
    (("json", "jsonl"), "evtx", (r'"RuleTitle"', r'"Computer"')),
    (("json", "jsonl"), "evtx_full", (r'"EventId"', r'"Payload"')),
    (("json",), "registry_tree", (r'"KeyPath"', r'"LastWriteTimestamp"')),
    (("json", "jsonl"), "mft", (r'"EntryNumber"', r'"FileName"')),
)
# The first bytes of files without an extension.
BY_MAGIC = {b"regf": "hive_binary", b"FILE": "mft_binary"}


def _heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, head): the first four bytes of some files, read in tasks and no more than these where tasks can open the files."""
    if not all(map(splits.reachable, paths)):
        return spark.read.format("binaryFile").load(paths).select(_spelled(F.col("path")).alias("path"), F.substring("content", 1, 4).alias("head"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for p in batch.column("path").to_pylist():
                try:
                    heads.append(splits.Bytes(p).at(0, 4))
                except OSError:
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.binary())], ["path", "head"])

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)), "path")
    return table.mapInArrow(look, "path string, head binary")


def _spelled(path: Column) -> Column:
    """A path with three slashes after ``file:``; readers differ in this."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def detect(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of the files under a path or pattern: a reader's kind, ``log`` for other text, a
    ``..._binary`` kind for what an outside parser must read first, null where nothing fits.

    Files are listed first.  Those with a text extension are tested line by line, in splits; of
    those without an extension four bytes are read; all others are told by their extension alone.
    Empty files have no row.
    """
    listed = spark.read.format("binaryFile").load(path).select(_spelled(F.col("path")).alias("path"))  # without content, so nothing is opened
    names = sorted(r.path for r in listed.collect())  # a row a file
    extension = {p: p.rpartition("/")[2].rpartition(".")[2].lower() if "." in p.rpartition("/")[2] else "" for p in names}
    texts, bare = [p for p in names if extension[p] in LOG_EXTENSIONS], [p for p in names if not extension[p]]
    out = spark.createDataFrame([(p, BY_EXTENSION.get(extension[p])) for p in names if p not in {*texts, *bare}], "path string, kind string")
    if texts:
        lines = spark.read.text(texts).select(_spelled(F.col("_metadata.file_path")).alias("path"), "value")
        tests = [F.max(F.col("value").rlike(p)).alias(f"m{i}_{j}") for i, (_, _, patterns) in enumerate(BY_LINES) for j, p in enumerate(patterns)]
        every = spark.createDataFrame([(p, extension[p]) for p in texts], "path string, ext string")
        seen = every.join(lines.groupBy("path").agg(*tests), "path", "left")
        kind = F.lit("log")
        for i, (extensions, name, patterns) in reversed(list(enumerate(BY_LINES))):
            all_held = F.col("ext").isin(*extensions)
            for j in range(len(patterns)):
                all_held &= F.coalesce(F.col(f"m{i}_{j}"), F.lit(False))
            kind = F.when(all_held, name).otherwise(kind)
        out = out.unionByName(seen.select("path", kind.alias("kind")))
    if bare:
        by_magic = F.lit(None).cast("string")
        for head, name in BY_MAGIC.items():
            by_magic = F.when(F.col("head") == F.lit(head), name).otherwise(by_magic)
        out = out.unionByName(_heads(spark, bare).select("path", by_magic.alias("kind")))
    return out


def routed(spark: SparkSession, path: str) -> tuple[list[tuple[str, str, dict]], list[tuple[str, str | None]]]:
    """(kind, path, options) for ``build_events``, and the files that no reader takes with their kind.

    A THOR report tells all that its hash list does, so the list is read only where there is no report.
    """
    from loglattice.sources.readers import READERS

    found = [(r.path, r.kind) for r in detect(spark, path).orderBy("path").collect()]  # a row a file
    if any(kind == "thor" for _, kind in found):
        found = [(p, kind) for p, kind in found if kind != "thor_csv"]
    options = lambda p, kind: {"hive": p.rpartition("/")[2].rpartition(".")[0]} if kind == "registry_tree" else {}
    return [(kind, p, options(p, kind)) for p, kind in found if kind in READERS], [(p, kind) for p, kind in found if kind not in READERS]
