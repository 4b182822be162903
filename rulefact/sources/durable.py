"""Intermediates that outlive a lost executor: written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named in spark.checkpoint.dir. A temporary one is made only where none is set and the
    session is a local one, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.get(context.applicationId) or _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="rulefact-"))
    return found.rstrip("/")


def in_parts(df: DataFrame, n_rows: int, rows_each: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many partitions as n_rows need at about rows_each in one; up to that many rows, df as it is. The number
    grows with the rows, so that a task's share does not, and Spark does not merge partitions of a given number."""
    n = -(-n_rows // rows_each)
    return df.repartition(n, *keys) if n > 1 else df


def durable(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df, computed once and written to the shared folder: its lineage ends in that table, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
