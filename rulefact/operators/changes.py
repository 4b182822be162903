"""Set-oriented changes: each takes a snapshot and a change and returns the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of new replace the listed columns of old rows with their key (all of new's columns by default) or are added."""
    replaced = set(columns if columns is not None else [c for c in new.columns if c not in keys])
    there = old.withColumn("__old", F.lit(True))
    fresh = new.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in new.columns if c not in keys), F.lit(True).alias("__new"))
    x = there.join(fresh, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys or c not in new.columns:
            return F.col(c)
        if c in replaced:
            return F.when(F.col("__new"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__new_{c}")).alias(c)

    return x.select(*(value(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Children of touched parents (those of new by default) are replaced by new ones."""
    gone = (touched if touched is not None else new).select(*parent).distinct()
    return old.join(gone, parent, "left_anti").unionByName(new)


def promote(labels: DataFrame, round_id: Column) -> DataFrame:
    """Accepted labels of a round become promoted."""
    return labels.withColumn("promoted", F.col("promoted") | ((F.col("round_id") == round_id) & F.col("accepted")))


def assign_split(cases: DataFrame, test: Column, split: str) -> DataFrame:
    return cases.withColumn("dataset_split", F.when(test, F.lit(split)).otherwise(F.col("dataset_split")))


def attach(rows: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column of updates where a row has one, else the row's own."""
    x = rows.join(updates.select(*keys, F.col(column).alias("__update")), keys, "left")
    return x.withColumn(column, F.coalesce("__update", column)).drop("__update").select(*rows.columns)


def reset_derived(facts: DataFrame, cases: Column | None = None) -> DataFrame:
    """Derived facts go and observed ones return to T, 1.0, no logits; in the given cases or all."""
    inside = F.lit(True) if cases is None else cases
    kept = facts.where(~inside | (F.col("status") == "observed"))
    return kept.withColumns({"value": F.when(inside, F.lit("T")).otherwise(F.col("value")), "confidence": F.when(inside, F.lit(1.0)).otherwise(F.col("confidence"))})


def pruned_states(states: DataFrame, cases: Column | None = None) -> DataFrame:
    """States without those that nothing clamps; in the given cases or all."""
    inside = F.lit(True) if cases is None else cases
    return states.where(~inside | F.col("is_clamped"))


def reset_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """status, n_before, n_after."""
    b = before.groupBy("status").agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy("status").agg(F.count(F.lit(1)).alias("n_after"))
    return b.join(a, "status", "left").na.fill(0)


def backfill(rows: DataFrame, lookup: DataFrame, key: str, column: str, found: str, patterns: dict[str, str]) -> DataFrame:
    """Fills nulls of column: from lookup by key, then by the first LIKE pattern the key matches."""
    x = rows.join(lookup.select(key, F.col(found).alias("__found")), key, "left")
    by_pattern = F.coalesce(*(F.when(F.col(key).like(p), F.lit(v)) for p, v in patterns.items()), F.lit(None))
    return x.withColumn(column, F.coalesce(column, "__found", by_pattern)).drop("__found").select(*rows.columns)
