"""Row filters over facts, rules, states, labels and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefact.functions.scalars import logit_margin

#: Predicates that only serve the evaluation of rules.
HELPERS = ("before", "within_14_days", "same_day", "same_week", "same_month", "same_year", "paid_within_48h", "coupon_not_expired", "meets_min_basket")


def observed(facts: DataFrame, every_status: bool = False) -> DataFrame:
    return facts if every_status else facts.where(F.col("status") == "observed")


def enabled_rules(rules: DataFrame, modules: list[str]) -> DataFrame:
    """Enabled rules; learned ones only of the listed modules; in order of stratum and id."""
    return rules.where(F.col("enabled") & (~F.col("learned") | F.col("module").isin(modules))).orderBy("stratum", "rule_id")


def select_cases(cases: DataFrame, split: str | None = None, ids: list[str] | None = None, like: str | None = None, name: str = "case_id") -> DataFrame:
    """Cases of a split, with listed ids, or with a name like a pattern; all if nothing is asked."""
    tests = [t for t in (F.col("dataset_split") == split if split else None, F.col("case_id").isin(ids) if ids else None, F.col(name).like(like) if like else None) if t is not None]
    wanted = F.lit(not tests)
    for t in tests:
        wanted = wanted | t
    return cases.where(wanted)


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def is_true(value: Column, confidence: Column, least: float = 0.5) -> Column:
    return (value == "T") & (confidence.isNull() | (confidence >= least))


def is_decided(logits: Column, clamped: Column, lead: float = 1.0) -> Column:
    """A state counts if it is clamped or its first logit leads clearly; empty logits never count."""
    return (F.size(logits) > 0) & (clamped | (logit_margin(logits) >= lead))


def complete_facts(args: DataFrame, roles: DataFrame) -> DataFrame:
    """fact_id, predicate, filled: facts of known predicates whose every role has an argument. Roles are few, as an ontology names
    them: they are broadcast, so that arguments are not dealt by so few keys."""
    arity = roles.groupBy("predicate").agg(F.count(F.lit(1)).alias("arity"))
    found = args.join(F.broadcast(roles), ["predicate", "role"]).groupBy("fact_id", "predicate").agg(F.countDistinct("role").alias("filled"))
    return found.join(F.broadcast(arity), "predicate").where("filled = arity")


def is_visible(predicate: Column) -> Column:
    return ~(predicate.rlike(r"^(_sv_|ab_)") | predicate.isin(*HELPERS) | predicate.rlike(r"^within_\d+_days_after$"))


def in_domain(states: DataFrame, schemas: DataFrame, value: str) -> DataFrame:
    """States of known clusters whose value lies in the cluster's domain."""
    allowed = schemas.select("cluster", F.explode("domain").alias(value))
    return states.join(allowed, ["cluster", value], "left_semi")


def rounds(labels: DataFrame, explicit: list[str], promoted_only: bool) -> DataFrame:
    """Labels of the listed rounds; without a list, the promoted ones or all."""
    if explicit:
        return labels.where(F.col("round_id").isin(explicit))
    return labels.where("promoted") if promoted_only else labels
