"""Candidate facts: from decided attributes, and from rule heads whose positive bodies hold with enough confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.functions.scalars import argmax_value, atom_key, name_uuid, softmax
from rulefact.operators.filters import is_visible
from rulefact.operators.picks import top


def from_clusters(states: DataFrame, present: DataFrame, least: float = 0.7) -> DataFrame:
    """CLUSTER(entity, value) for states that are not hard-clamped and sure enough, unless present(case_id, atom)."""
    p = F.array_max(softmax(F.col("logits")))
    value = F.lower(argmax_value(F.col("logits"), F.col("domain")))
    atom = F.concat(F.lower("cluster"), F.lit("(ENTITY="), F.col("entity_id").cast("string"), F.lit(",VALUE="), value, F.lit(")"))
    x = states.where(~F.coalesce(F.col("clamp_hard"), F.lit(False))).select("case_id", F.upper("cluster").alias("predicate"), atom.alias("atom"), p.alias("confidence")).where(F.col("confidence") >= least)
    fresh = x.join(present.select("case_id", "atom").distinct(), ["case_id", "atom"], "left_anti")
    return fresh.select("case_id", name_uuid(F.concat_ws("/", F.col("case_id").cast("string"), "atom")).alias("fact_id"), "predicate", "atom", F.lit("candidate").alias("status"), "confidence")


def from_rules(rules: list, frames: dict[str, DataFrame], present: DataFrame, least: float = 0.7, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Heads of rules whose positive bodies hold, negation ignored; confidence is the smallest of the supporting facts'.

    frames have a `confidence` column; per atom the most confident grounding stays, ties by rule order and substitution.
    """
    from rulefact.plans.rules import _literal_frame, _substitution, _var

    out = None
    for order, r in enumerate(rules):
        body, bound = None, set()
        for n, x in enumerate(r.positives):
            f = frames[x.predicate]
            part = _literal_frame(_with_confidence(x, n), f)
            shared = [_var(v) for v in x.variables if v in bound]
            body = part if body is None else body.join(part, ["case_id", *shared])
            bound |= set(x.variables)
        from rulefact.operators.temporal import HELPER_TESTS

        for x in r.helpers:
            a, b = (F.col(_var(t)) for _, t in x.args)
            body = body.where(HELPER_TESTS[x.predicate](a, b))
        scores = [F.col(_var(f"CONF{n}")) for n in range(len(r.positives))]
        confidence = F.least(*scores) if len(scores) > 1 else scores[0]
        negatives = {v for x in r.negatives for v in x.variables} - bound
        head = atom_key(F.lit(r.head.predicate), {role: F.col(_var(t)) for role, t in r.head.args})
        part = body.select("case_id", F.lit(r.head.predicate).alias("predicate"), head.alias("atom"), confidence.alias("confidence"), F.lit(r.rule_id).alias("rule_id"), F.lit(order).alias("rule_order"), (_substitution(r) if not negatives else head).alias("substitution"))
        out = part if out is None else out.unionByName(part)
    return _proposed(out, present, least, hidden)


def _proposed(heads: DataFrame, present: DataFrame, least: float, hidden: tuple[str, ...]) -> DataFrame:
    """The most confident head of each atom, if it is sure enough, visible and not present."""
    out = heads.where((F.col("confidence") >= least) & is_visible(F.col("predicate")) & ~F.col("predicate").isin(*hidden, ""))
    best = top(out, ["case_id", "atom"], [F.desc("confidence"), F.col("rule_order"), F.col("substitution")])
    return best.join(present.select("case_id", "atom").distinct(), ["case_id", "atom"], "left_anti").select("case_id", name_uuid(F.concat_ws("/", F.col("case_id").cast("string"), "atom")).alias("fact_id"), "predicate", "atom", F.lit("candidate").alias("status"), "confidence", "rule_id")


def from_bodies(rules: list, bodies: dict[str, DataFrame], present: DataFrame, least: float = 0.7, hidden: tuple[str, ...] = ()) -> DataFrame:
    """As from_rules, from groundings that are at hand, per rule id, with the confidences they rest on in columns v_CONF0 and so on;
    groundings without any are certain."""
    from rulefact.plans.rules import Const, _substitution, _var

    parts = []
    for order, r in enumerate(rules):
        if r.rule_id not in bodies:
            continue
        body = bodies[r.rule_id]
        scores = [F.col(c) for c in body.columns if c.startswith("v_CONF")]
        head = atom_key(F.lit(r.head.predicate), {role: F.lit(str(t.value)) if isinstance(t, Const) else F.col(_var(t)) for role, t in r.head.args})
        parts.append(body.select("case_id", F.lit(r.head.predicate).alias("predicate"), head.alias("atom"), F.least(F.lit(1.0), F.lit(1.0), *scores).alias("confidence"), F.lit(r.rule_id).alias("rule_id"), F.lit(order).alias("rule_order"), _substitution(r).alias("substitution")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _proposed(out, present, least, hidden)


def _with_confidence(x: object, n: int) -> object:
    from rulefact.plans.rules import Literal

    return Literal(x.predicate, (*x.args, ("confidence", f"CONF{n}")), x.negated)


def evidence(candidates: DataFrame, supports: DataFrame) -> DataFrame:
    """Candidates with their supporting items: supports(case_id, atom, item, kind, confidence), an ordered array per candidate."""
    e = supports.groupBy("case_id", "atom").agg(F.array_sort(F.collect_set(F.struct("item", "kind", "confidence"))).alias("evidence"))
    return candidates.join(e, ["case_id", "atom"], "left")
