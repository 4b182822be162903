"""Best-row and first-row choices with total orders, and version numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; Spark cuts each task's rows to n before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def best_slot(slots: DataFrame) -> DataFrame:
    """Per entity and slot: highest source_rank * confidence (defaults 0.5 and 1), then newest."""
    weight = F.coalesce("source_rank", F.lit(0.5)) * F.coalesce("confidence", F.lit(1.0))
    return top(slots, ["entity_id", "slot_name"], [weight.desc(), F.col("valid_from").desc_nulls_last(), F.col("value").desc()])


def resolved_slots(slots: DataFrame) -> DataFrame:
    """Per entity and slot: source_rank, confidence, valid_from, value, each the largest; missing ones last."""
    return top(slots, ["entity_id", "slot_name"], [F.coalesce("source_rank", F.lit(-1.0)).desc(), F.coalesce("confidence", F.lit(-1.0)).desc(), F.col("valid_from").desc_nulls_last(), F.col("value").desc()])


def top_influences(trace: DataFrame, k: int) -> DataFrame:
    """The k strongest influences on each fact, numbered."""
    return top(trace, ["case_id", "fact_id"], [F.col("magnitude").desc(), F.col("source_id")], k, rank="place")


def top_sources(trace: DataFrame, n: int = 3) -> DataFrame:
    """Per fact the n strongest sources by abs(delta_t), each by its best entry."""
    strongest = top(trace, ["case_id", "fact_id", "source_id"], [F.abs("delta_t").desc(), F.col("step")])
    return top(strongest, ["case_id", "fact_id"], [F.abs("delta_t").desc(), F.col("source_id")], n, rank="place")


def first_wins(df: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """The first row of each key in input order."""
    return top(df, keys, [F.col(c) for c in position])


def best_run(runs: DataFrame, key: str) -> DataFrame:
    """proved before not_proved before others, then the newest."""
    priority = F.when(F.col("result") == "proved", 0).when(F.col("result") == "not_proved", 1).otherwise(2)
    return top(runs, [key], [priority, F.col("created_at").desc(), F.col("proof_id")])


def appended_versions(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows numbered on from the largest version of their key."""
    last = old.groupBy(*keys).agg(F.max("version").alias("__last"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return new.withColumn("__nth", nth).join(last, keys, "left").withColumn("version", F.coalesce("__last", F.lit(0)) + F.col("__nth")).drop("__last", "__nth")


#: A self-training round goes through these in order.
ROUND_STATUS = ("draft", "collected", "imported", "promoted")


def advanced(rounds: DataFrame) -> DataFrame:
    """status becomes wanted where that is the next status; else it stays."""
    place = lambda c: F.array_position(F.array(*map(F.lit, ROUND_STATUS)), F.col(c))
    return rounds.withColumn("status", F.when(place("wanted") == place("status") + 1, F.col("wanted")).otherwise(F.col("status")))
