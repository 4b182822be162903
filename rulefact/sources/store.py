"""Tables kept in buckets of a key, of which a change rewrites only those whose rows differ afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefact.sources.durable import durable

BUCKET = "store_bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A stored table of rows, in `buckets` folders by the hash of `key` (a case, say). Null keys are a key."""
    _write(rows.withColumn(BUCKET, _bucket(key, buckets)), path, "error")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {BUCKET} int").parquet(path).drop(BUCKET)


def _prints(rows: DataFrame) -> DataFrame:
    """Of each bucket, a figure that any other set of rows would almost surely change: sums of hashes, and the number of rows."""
    h = lambda seed: F.xxhash64(F.lit(seed), F.to_json(F.struct(*(c for c in rows.columns if c != BUCKET)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return rows.groupBy(BUCKET).agg(F.struct(F.sum(h(1)).alias("a"), F.sum(h(2)).alias("b"), F.count(F.lit(1)).alias("n")).alias("print"))


def change(spark: SparkSession, path: str, schema: str, key: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> list[int]:
    """Brings changes into a stored table: apply(rows, changes) gives the rows of the buckets that the changes' keys lie in.

    Only those buckets are read, and only those whose rows differ afterwards are written, each in one step by replacing its
    folder; the others, and every bucket when the same changes come again, keep their files. A run that was cut off is made good
    by running it again. Returns the buckets written or emptied. apply must keep rows in their bucket, that is, their key.
    """
    changes = durable(changes, "changes")
    touched = sorted(r[0] for r in changes.select(_bucket(key, buckets)).distinct().collect())  # at most `buckets`
    old = spark.read.schema(f"{schema}, {BUCKET} int").parquet(path).where(F.col(BUCKET).isin(touched))
    names = [c for c in old.columns if c != BUCKET]
    new = durable(apply(old.drop(BUCKET), changes).select(*names).withColumn(BUCKET, _bucket(key, buckets)), "changed-buckets")
    if (strays := new.where(~F.col(BUCKET).isin(touched)).limit(1).count()):
        raise ValueError(f"{strays} row has left the touched buckets")
    both = _prints(old).withColumnRenamed("print", "was").join(_prints(new), BUCKET, "full").where(~F.col("was").eqNullSafe(F.col("print")))
    differ = sorted((r[BUCKET], r["print"] is None) for r in both.collect())
    filled, emptied = [b for b, gone in differ if not gone], [b for b, gone in differ if gone]
    if filled:
        _write(new.where(F.col(BUCKET).isin(filled)), path, "overwrite")
    for b in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return [b for b, _ in differ]
