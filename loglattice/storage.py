"""Tables of a run on the cluster's shared storage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"/tmp/checkpoints/loglattice-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str = "graph") -> DataFrame:
    """Written to the cluster's checkpoint folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
