"""Folders of texts taken in as they fill, each file once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefact.sources.durable import durable

TEXTS = "case_id string, source_id string, content string, digest string, path string"
ERRORS = "case_id string, kind string, digest string, path string"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(f"{schema}, batch long").parquet(folder) if there else spark.createDataFrame([], f"{schema}, batch long")


def ingested(spark: SparkSession, into: str) -> tuple[DataFrame, DataFrame]:
    """(texts, errors) that ingest() has written so far."""
    return _read(spark, f"{into}/texts", TEXTS), _read(spark, f"{into}/errors", ERRORS)


@contextmanager
def _small_files(spark: SparkSession) -> Iterator[None]:
    """Settings for many small files: a few tasks for each core list them (Spark's default is a task for each path, up to 10,000),
    and a task reads up to about 2,000 instead of 32."""
    listing, cost = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"
    before = {name: spark.conf.get(name) for name in (listing, cost)}
    spark.conf.set(listing, str(min(int(before[listing]), 4 * spark.sparkContext.defaultParallelism)))
    spark.conf.set(cost, "64KB")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def ingest(spark: SparkSession, folder: str, into: str, pattern: str = "*.txt", case_of: str = r"([^/]*?)(?:\.[^./]*)?$", files: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Takes in the files of a folder (and its folders) that are new since the last call; returns (texts, errors) of all calls.

    texts: case_id (the first group of `case_of` in the path; else the file's stem), source_id (case_id-TEXT), content without
    outer white space, its digest and path. errors: kind blank (no text), not_utf8, duplicate (a text with this content is there,
    or comes first by path in the same batch) or known_case (another text has this case_id). A batch of at most `files` files
    replaces its own rows if it runs again, so a lost driver neither loses nor repeats a file.
    """

    def take(batch: DataFrame, number: int) -> None:
        raw = F.col("content").cast("string")
        text = F.regexp_replace(raw, r"^\s+|\s+$", "")
        x = batch.select(F.regexp_extract("path", case_of, 1).alias("case_id"), F.is_valid_utf8(raw).alias("valid"), F.when(F.is_valid_utf8(raw), text).alias("content"), "path")
        x = x.withColumns({"digest": F.sha2("content", 256), "source_id": F.concat("case_id", F.lit("-TEXT"))})
        x = durable(x, "ingest")
        # What becomes of each file is decided without its text; only texts taken in move, once.
        named = x.select("case_id", "valid", (F.col("content") == "").alias("blank"), "digest", "path")
        before = ingested(spark, into)[0].where(F.col("batch") != number)
        good = named.where("valid AND NOT blank")
        new = good.join(before.select("digest").distinct(), "digest", "left_anti")
        fresh = new.groupBy("digest").agg(F.min(F.struct("path", "case_id")).alias("f")).select("f.*")
        taken = fresh.join(before.select("case_id").distinct(), "case_id", "left_anti").groupBy("case_id").agg(F.min("path").alias("path"))
        texts = durable(x.join(taken.select("path"), "path", "left_semi"), "ingest-texts")
        kind = F.when(~F.col("valid"), "not_utf8").when(F.col("blank"), "blank").when(F.col("fresh"), "known_case").otherwise("duplicate")
        errors = named.join(texts.select("path"), "path", "left_anti").join(fresh.select("path", F.lit(True).alias("fresh")), "path", "left").select("case_id", kind.alias("kind"), "digest", "path")
        for name, rows, schema in (("texts", texts, TEXTS), ("errors", errors, ERRORS)):
            rows.select(*(c.split()[0] for c in schema.split(", "))).write.mode("overwrite").parquet(f"{into}/{name}/batch={number}")

    with _small_files(spark):
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(folder)
        stream.select("path", "content").writeStream.foreachBatch(take).option("checkpointLocation", f"{into}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ingested(spark, into)


def settled(texts: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, duplicates) as case_id, digest, path, as if all files had come at once: of equal texts the first by path counts,
    in whichever batch it came. Blank, undecodable and known cases stay what they are."""
    every = texts.select("case_id", "digest", "path").unionByName(errors.where("kind = 'duplicate'").select("case_id", "digest", "path"))
    first = every.groupBy("digest").agg(F.min("path").alias("path"))
    return every.join(first, ["digest", "path"], "left_semi"), every.join(first, ["digest", "path"], "left_anti")
