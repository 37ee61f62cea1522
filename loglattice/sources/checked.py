"""Reading that keeps account of what it could not read.

``checked`` gives the events of some sources and, in the same table, a row for everything that was
not read, with its ``reason``: a file that can't be opened or breaks off, a line that is no JSON or
does not fit the pattern, an object that does not close.  Nothing runs until the table is used.
``settle`` writes it once, counts both kinds in that same pass, and gives the events and the dead
letters back as two tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loglattice.schema import RAW
from loglattice.sources import readers, splits


def _marked(rows: DataFrame, test: Column, reason: str) -> DataFrame:
    """Rows that have no reason so far and fail a test get one; a null test fails."""
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & ~F.coalesce(test, F.lit(False)), F.lit(reason)).otherwise(F.col("reason")))


def _json(spark: SparkSession, kind: str, path: str, split_bytes: int) -> DataFrame:
    docs = splits.documents(spark, path)
    packed = [f[0] for f in splits.files_under(path)]
    by_line = [f for f in packed if f not in set(docs)]
    parts = []
    if by_line:
        lines = splits.split_rows(spark, by_line, "lines", split_bytes).filter("text is null or trim(text) <> ''")
        parts.append(lines.withColumn("text", F.regexp_replace("text", r"^\s*@rawstring:\s*", "")))
    if docs:
        parts.append(splits.json_elements(spark, docs, split_bytes))
    if not parts:
        parts.append(spark.createDataFrame([], splits.SCHEMA))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("m", F.from_json("text", readers.MAP)).withColumnsRenamed({"text": "original", "file": "origin"})
    rows = _marked(rows, F.col("m").isNotNull() & (F.size("m") > 0), "not a JSON object")
    return readers.RECORD_EVENTS[kind](rows)


def _log(spark: SparkSession, path: str, split_bytes: int, fmt: str = "auto", pattern: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    rows = splits.split_rows(spark, path, "lines", split_bytes).filter("text is null or trim(text) <> ''")
    rows = rows.withColumn("original", F.col("text")).withColumnsRenamed({"text": "line", "file": "origin"})
    if fmt == "jsonl":
        m = F.from_json("line", readers.MAP)
        rows = _marked(rows, m.isNotNull() & (F.size(m) > 0), "not a JSON object")
    elif fmt == "regex":
        rows = _marked(rows, F.col("line").rlike(readers.plain_pattern(pattern)), "does not fit the pattern")
    rows = rows.withColumn("line", F.when(F.col("reason").isNull(), F.col("line"))).withColumn("file", F.substring_index("origin", "/", -1))
    return readers.log_rows(rows, fmt, pattern, mapping)


def checked(spark: SparkSession, sources: list[tuple[str, str, dict]], split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """Raw events of (kind, path, options) sources with ``original``, ``origin``, ``pos`` and ``reason``.

    Rows with a reason are no events: their other columns don't count.  A source whose folder
    isn't there is one row.  Kinds are those whose records are JSON (``readers.RECORD_EVENTS``),
    ``log`` and ``reg``.
    """
    out = None
    for kind, path, options in sources:
        try:
            if kind == "log":
                part = _log(spark, path, split_bytes, **options)
            elif kind == "reg":
                part = readers.registry_rows(splits.split_rows(spark, path, "registry", split_bytes).withColumnRenamed("file", "origin"), **options)
            else:
                part = _json(spark, kind, path, split_bytes)
        except FileNotFoundError:
            part = spark.createDataFrame([(path, None, "no such file or folder")], "origin string, pos bigint, reason string")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def settle(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write ``checked`` rows to a new folder of shared storage in one pass.

    Returns the events with ids, the dead letters (origin, pos, original, reason), and how many
    there are of each, counted while they were written.
    """
    seen = Observation("checked")
    is_dead = F.col("reason").isNotNull()
    rows = rows.observe(seen, F.count_if(~is_dead).alias("events"), F.count_if(is_dead).alias("dead"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in RAW.fields if f.name not in rows.columns]
    kept = rows.select("*", *missing, *[F.lit(None).cast("string").alias(c) for c in ("original",) if c not in rows.columns])
    kept = kept.withColumn("dead", is_dead)
    kept.write.partitionBy("dead").parquet(folder)
    back = kept.sparkSession.read.schema(kept.schema).parquet(folder)
    events = back.filter("not dead").select(*[F.monotonically_increasing_id().alias("id") if c == "id" else c for c in RAW.names], "original")
    return events, back.filter("dead").select("origin", "pos", "original", "reason"), dict(seen.get)
