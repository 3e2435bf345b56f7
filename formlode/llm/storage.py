"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local one only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/formlode/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut and lost executors cost no recomputation.

    files: into how many files aggregated rows are gathered, so that a small table has a small size for the choice of joins.
    """
    path = fresh_path(df.sparkSession, label)
    df = df.repartition(files) if files else df
    # Most are tables of texts or hashes that live until the job ends; on texts zstd takes about a third less than the default.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
