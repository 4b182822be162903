"""Exact token counts through a histogram of encoded lengths and its suffix sums.

Defined cases: a null or empty text has length 0 and counts as a document; repeated rows count each time; very long texts are
encoded whole; other columns are not read, whatever their names; an empty table gives an empty histogram (and totals of 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulefact.llm.common import encode, stored

#: Lengths are summed in blocks of so many, so that no window runs over all of them.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x.as_py(), vocabulary)) for x in batch.column(0)], pa.int64())], names=["n_tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long")


def histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """length, n_docs: documents of each encoded length."""
    return encoded_lengths(docs, vocabulary).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def with_sums(hist: DataFrame) -> DataFrame:
    """For each length L: documents and tokens of at least L, all tokens if every document is cut at L, and the rank of its last document.

    Sums go over blocks of lengths first (few rows), then inside each block.
    """
    hist = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *(F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"{x}_{n}") for n, w in (("above", above), ("ahead", ahead)) for x in "dt"))
    up = Window.partitionBy("block").orderBy(F.desc("length"))
    down = Window.partitionBy("block").orderBy("length")
    x = hist.join(blocks, "block").withColumns({
        "docs_at_least": F.col("d_above") + F.sum("n_docs").over(up),
        "tokens_at_least": F.col("t_above") + F.sum("n_tokens").over(up),
        "docs_at_most": F.col("d_ahead") + F.sum("n_docs").over(down),
        "tokens_at_most": F.col("t_ahead") + F.sum("n_tokens").over(down),
    })
    longer = F.col("docs_at_least") - F.col("n_docs")
    return x.select("length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", "docs_at_most", (F.col("tokens_at_most") + longer * F.col("length")).alias("truncated_total"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Total tokens if documents are cut at each limit, also between observed lengths: the next observed length L above gives
    truncated_total(L) - docs_at_least(L) * (L - limit); beyond the longest document nothing is cut."""
    want = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    next_up = sums.join(F.broadcast(want), F.col("length") >= F.col("limit")).groupBy("limit").agg(F.min_by(F.struct("length", "docs_at_least", "truncated_total"), "length").alias("u"))
    whole = sums.agg(F.sum("n_tokens")).first()[0] or 0
    return want.join(next_up, "limit", "left").select("limit", F.coalesce(F.col("u.truncated_total") - F.col("u.docs_at_least") * (F.col("u.length") - F.col("limit")), F.lit(whole)).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q in (0, 1]: the smallest length that at least q of the documents do not exceed."""
    want = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    n = sums.agg(F.sum("n_docs")).first()[0] or 0
    return sums.join(F.broadcast(want), F.col("docs_at_most") >= F.ceil(F.col("share") * n)).groupBy("share").agg(F.min("length").alias("length"))


def report(docs: DataFrame, limits: list[int], shares: list[float], vocabulary: str | None = None) -> DataFrame:
    """The histogram with its sums (kind `length`), and what they answer: totals at context limits (kind `limit`) and quantiles
    (kind `quantile`). The texts are encoded once; the rest works on the histogram."""
    sums = stored(with_sums(stored(histogram(docs, vocabulary), "lengths")), "length-sums")
    columns = [c for c in sums.columns if c != "length"]
    rows = sums.select(F.lit("length").alias("kind"), "length", F.lit(None).cast("double").alias("share"), *columns)
    none = lambda *but: [F.lit(None).cast("long").alias(c) for c in columns if c not in but]
    at = at_limits(sums, limits).select(F.lit("limit").alias("kind"), F.col("limit").alias("length"), F.lit(None).cast("double").alias("share"), *none("truncated_total"), "truncated_total")
    return rows.unionByName(at).unionByName(quantiles(sums, shares).select(F.lit("quantile").alias("kind"), "length", "share", *none()))
