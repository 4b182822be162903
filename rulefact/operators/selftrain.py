"""Self-training: collecting pseudo-labels, checking imports, overlaying accepted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.functions.scalars import top_and_margin
from rulefact.operators.picks import first_wins, top

FACT = ["case_id", "fact_key"]
STATE = ["case_id", "entity_id", "cluster"]


def pseudo_facts(facts: DataFrame, gold: DataFrame, least: float = 0.95) -> DataFrame:
    """Proved true facts, sure enough, that are not gold."""
    sure = facts.where((F.col("status") == "proved") & (F.col("value") == "T") & (F.col("confidence") >= least))
    return sure.join(gold.select(*FACT), FACT, "left_anti").select(*FACT, "value", "confidence")


def blocked_negatives(facts: DataFrame, feedback: DataFrame, gold: DataFrame, least: float = 0.95) -> DataFrame:
    """Rejected false facts whose candidate was blocked, sure enough, that are not gold."""
    f = facts.where((F.col("status") == "rejected") & (F.col("value") == "F") & (F.col("confidence") >= least))
    f = f.join(feedback.where("outcome = 'blocked'").select("case_id", "fact_id"), ["case_id", "fact_id"], "left_semi")
    return f.join(gold.select(*FACT), FACT, "left_anti").select(*FACT, "value", "confidence")


def pseudo_states(states: DataFrame, gold: DataFrame, least: float = 0.95, margin: float = 0.8) -> DataFrame:
    """Sure states that neither they nor gold clamp hard by text or hand; kept as soft memory clamps."""
    t, m = top_and_margin(F.col("logits"))
    x = states.withColumns({"top1": t, "margin": m}).where((F.col("top1") >= least) & (F.col("margin") >= margin))
    fixed = lambda df: df.where("clamp_hard AND clamp_source IN ('text', 'manual')").select(*STATE)
    x = x.join(fixed(states), STATE, "left_anti").join(fixed(gold), STATE, "left_anti")
    return x.select(*STATE, "logits", "top1", "margin", F.lit(False).alias("clamp_hard"), F.lit("memory").alias("clamp_source"))


def imported(labels: DataFrame, cases: DataFrame, gold: DataFrame, clamps: DataFrame) -> DataFrame:
    """labels(case_id, fact_key, entity_id, cluster, value) with accepted and the reason against: unknown_case,
    duplicates_gold_fact, duplicates_text_clamp, conflicts_text_clamp."""
    x = labels.join(cases.select("case_id", F.lit(True).alias("__case")), "case_id", "left")
    x = x.join(gold.select(*FACT, F.lit(True).alias("__gold")).distinct(), FACT, "left")
    x = x.join(clamps.select(*STATE, F.col("value").alias("__clamp")), STATE, "left")
    reason = F.when(F.col("__case").isNull(), "unknown_case").when(F.col("__gold"), "duplicates_gold_fact").when(F.col("__clamp") == F.col("value"), "duplicates_text_clamp").when(F.col("__clamp").isNotNull(), "conflicts_text_clamp")
    return x.withColumn("rejection_reason", reason).withColumn("accepted", F.col("rejection_reason").isNull()).select(*labels.columns, "accepted", "rejection_reason")


def imported_queries(new: DataFrame, stored: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries to add, errors with their reason) of new(case_id, ord, query, expected): exact repeats are skipped, a stored or
    earlier query with another expectation is a conflict, an unknown case an error."""
    first = first_wins(new, ["case_id", "query", "expected"], ["ord"])
    unknown = first.join(cases, "case_id", "left_anti").withColumn("reason", F.lit("unknown_case"))
    rest = first.join(cases, "case_id", "left_semi")
    seen = stored.select("case_id", "query", F.col("expected").alias("__stored"))
    x = rest.join(seen, ["case_id", "query"], "left")
    by_query = first_wins(x.where("__stored IS NULL").drop("__stored"), ["case_id", "query"], ["ord"])
    clash = x.where("__stored IS NULL").drop("__stored").join(by_query.select("case_id", "query", F.col("ord").alias("__first")), ["case_id", "query"]).where("ord <> __first").drop("__first")
    errors = unknown.unionByName(x.where("__stored <> expected").drop("__stored").withColumn("reason", F.lit("conflict"))).unionByName(clash.withColumn("reason", F.lit("conflict")))
    return by_query, errors


def overlaid_facts(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Facts of a case and the accepted pseudo facts it lacks, the most confident of each key."""
    best = top(labels.where("accepted"), FACT, [F.desc("confidence"), F.desc("round_id")])
    return facts.select(*FACT, "value", "confidence").unionByName(best.join(facts, FACT, "left_anti").select(*FACT, "value", "confidence"))


def overlaid_states(states: DataFrame, labels: DataFrame) -> DataFrame:
    """States of a case; accepted pseudo states replace those that are not hard-clamped or are added."""
    best = top(labels.where("accepted"), STATE, [F.desc("margin"), F.desc("top1"), F.desc("round_id")]).select(*STATE, F.col("value").alias("__new"))
    x = states.select(*STATE, "value", "clamp_hard").join(best, STATE, "full_outer")
    return x.select(*STATE, F.when(F.coalesce("clamp_hard", F.lit(False)) | F.col("__new").isNull(), F.col("value")).otherwise(F.col("__new")).alias("value"))


def training_cases(gold: DataFrame, pseudo: DataFrame, source: str) -> DataFrame:
    """case_id, origin: cases by label source gold, pseudo or both; a case of both counts as gold."""
    g, p = gold.select("case_id", F.lit("gold").alias("origin")), pseudo.select("case_id", F.lit("pseudo").alias("origin"))
    x = g if source == "gold" else p if source == "pseudo" else g.unionByName(p)
    return x.groupBy("case_id").agg(F.min("origin").alias("origin"))
