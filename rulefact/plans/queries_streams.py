"""Queries that run as streams: folder ingestion (A1) and constraints over streams (J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulefact.plans.queries_sources import _folder
from rulefact.plans.registry import Tables, query
from rulefact.sources.records import write_texts
from rulefact.streaming import ingest, temporal


@query("""WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents), y AS (SELECT *, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY t) AS first FROM x)
SELECT CAST(doc_id AS VARCHAR) AS case_id, CASE WHEN t = '' THEN 'blank' WHEN first <> CAST(doc_id AS VARCHAR) THEN 'duplicate' ELSE 'text' END AS kind, CASE WHEN t = '' THEN NULL ELSE sha256(t) END AS digest FROM y""")
def a1_ingested_texts(t: Tables):
    """Documents written as one text file each, taken in as a stream of files; equal texts count once, for the first
    document: which of them came in the earlier batch of files is chance."""
    path, into = _folder(t, "texts"), _folder(t, "ingested")
    write_texts(t.documents.select(F.col("doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("text")), path)
    texts, errors = ingest.ingest(t.spark, path, into, case_of=r"(\d+)(?:\.txt|/part-[^/]*)$", files=100_000)
    first, again = ingest.settled(texts, errors)
    rest = errors.where("kind <> 'duplicate'").select("case_id", "kind", F.when(F.col("kind") != "blank", F.col("digest")).alias("digest"))
    return first.select("case_id", F.lit("text").alias("kind"), "digest").unionByName(again.select("case_id", F.lit("duplicate").alias("kind"), "digest")).unionByName(rest)


@query("""SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS ordered FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY)""")
def j3_missing_followers(t: Tables):
    """Orders and shipments as streams: orders of which nothing is shipped within 30 days. A last row far ahead (with a key that
    no order has) moves the watermark past all others, so that every order is decided."""
    spark, both = t.spark, {}
    for name, rows in (("orders", t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("ts"))), ("lines", t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("ts")))):
        path = _folder(t, name)
        end = rows.agg((F.max("ts") + F.expr("INTERVAL 20000 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("k"), "ts")
        rows.unionByName(end).write.parquet(path)
        both[name] = spark.readStream.schema("k long, ts timestamp").parquet(path)
    out, checkpoint = _folder(t, "missing"), _folder(t, "missing-state")
    temporal.write_available(temporal.missing_followers(both["orders"], both["lines"], "k", "30 DAYS", "8000 DAYS"), out, checkpoint)
    return spark.read.schema("key long, a timestamp").parquet(out).where("key >= 0").select("key", F.to_date("a").alias("ordered"))
