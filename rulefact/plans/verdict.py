"""Verdicts, proofs, feedback and status changes from a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulefact.functions.scalars import argmax_value, atom_key, name_uuid
from rulefact.operators.filters import is_decided, is_true, is_visible
from rulefact.operators.paths import reached
from rulefact.plans.rules import CASE, Model, violations
from rulefact.sources.durable import durable


def asked_predicates(rows: DataFrame) -> set[str]:
    """The predicates of rows(atom): as many as an ontology names."""
    return {r[0] for r in rows.where("atom IS NOT NULL").select(F.substring_index("atom", "(", 1)).distinct().collect()}


def verdicts(model: Model, queries: DataFrame) -> DataFrame:
    """queries(case_id, query_id, predicate, atom) with verdict, violated, rule_ids and the proving rule.

    proved: the atom is in the model; blocked: a rule's positive body holds but a negated literal does too; not_proved: some rule
    has the predicate as its head; unknown: none has.
    """
    atoms = model.atoms(asked_predicates(queries)).select(CASE, "atom", F.lit(True).alias("holds"), F.col("proof.rule_id").alias("proved_by"))
    heads = sorted({r.head.predicate for r in model.rules})
    out = queries.join(atoms, [CASE, "atom"], "left")
    broken = violations(model)
    if broken is not None:
        broken = broken.join(queries.select(CASE, "atom").distinct(), [CASE, "atom"], "left_semi")
        broken = broken.groupBy(CASE, "atom").agg(F.array_sort(F.collect_set("violated")).alias("violated"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.max(F.lit(True)).alias("broken"))  # who needs verdicts only, collects no sets
        out = out.join(broken, [CASE, "atom"], "left")
    else:
        out = out.withColumns({"violated": F.lit(None).cast("array<string>"), "rule_ids": F.lit(None).cast("array<string>"), "broken": F.lit(None).cast("boolean")})
    blocked = F.col("holds").isNull() & F.col("broken").isNotNull()
    verdict = F.when(F.col("holds"), "proved").when(blocked, "blocked").when(F.col("predicate").isin(heads), "not_proved").otherwise("unknown")
    return out.select(CASE, "query_id", "predicate", "atom", verdict.alias("verdict"), F.when(blocked, F.col("violated")).alias("violated"), F.when(blocked, F.col("rule_ids")).alias("rule_ids"), "proved_by")


def feedback(model: Model, candidates: DataFrame) -> DataFrame:
    """One row per candidate fact(case_id, fact_id, predicate, atom): outcome and reasons; no atom: unknown."""
    v = verdicts(model, candidates.withColumnRenamed("fact_id", "query_id"))
    outcome = F.when(F.col("atom").isNull(), "unknown").otherwise(F.col("verdict"))
    return v.select(CASE, F.col("query_id").alias("fact_id"), "predicate", outcome.alias("outcome"), "atom", F.col("violated").alias("violated_naf"), F.col("rule_ids").alias("supporting_rule_ids"))


def updated_statuses(model: Model, facts: DataFrame) -> DataFrame:
    """facts(case_id, fact_id, atom, status): candidates in the model become proved, with a proof id if a rule derived them."""
    atoms = model.atoms(asked_predicates(facts)).select(CASE, "atom", F.lit(True).alias("holds"), F.col("proof").isNotNull().alias("by_rule"))
    now = F.col("holds") & (F.col("status") == "candidate")
    out = facts.join(atoms, [CASE, "atom"], "left")
    proof_id = F.when(now & F.col("by_rule"), name_uuid(F.concat_ws("/", F.col(CASE).cast("string"), "atom")))
    return out.select(CASE, "fact_id", "atom", F.when(now, "proved").otherwise(F.col("status")).alias("status"), proof_id.alias("proof_id"))


def new_facts(model: Model, facts: DataFrame) -> DataFrame:
    """Rule-derived atoms of visible predicates that no fact states yet, as proved facts with ids made from their names."""
    derived = model.atoms().where(F.col("proof").isNotNull() & is_visible(F.col("predicate")))
    fresh = derived.join(facts.select(CASE, "atom").distinct(), [CASE, "atom"], "left_anti")
    seed = F.concat_ws("/", F.col(CASE).cast("string"), "atom")
    return fresh.select(CASE, name_uuid(seed).alias("fact_id"), F.upper("predicate").alias("predicate"), "atom", F.lit("proved").alias("status"), F.lit("T").alias("value"), F.lit(1.0).alias("confidence"))


def proof_edges(model: Model) -> DataFrame:
    """case_id, atom, rule_id, kind (pos or naf), depends_on."""
    p = model.atoms().where("proof is not null")
    edge = lambda kind, c: p.select(CASE, "atom", "proof.rule_id", F.lit(kind).alias("kind"), F.explode(f"proof.{c}").alias("depends_on"))
    return edge("pos", "pos_atoms").unionByName(edge("naf", "naf_atoms"))


def proof_table(model: Model) -> DataFrame:
    """case_id, atom, kind (base or derived), rule_id, substitution, rests_on: what a stored proof run holds of each atom; rests_on
    is JSON with the atoms of the positive and the negated literals."""
    p = model.atoms()
    rests = F.when(F.col("proof").isNotNull(), F.to_json(F.struct(F.col("proof.pos_atoms").alias("pos"), F.col("proof.naf_atoms").alias("naf"))))
    return p.select(CASE, "atom", F.when(F.col("proof").isNull(), "base").otherwise("derived").alias("kind"), "proof.rule_id", "proof.substitution", rests.alias("rests_on"))


def proof_steps(model: Model, queries: DataFrame) -> DataFrame:
    """case_id, query_atom, atom, depth, rule_id, step: what the proofs of the asked atoms rest on, dependencies first.

    The closure runs over positive edges from the asked atoms, in strides; depth is the longest way down, so dependencies come
    first. It ends, as a proof rests on atoms of earlier rounds only.
    """
    nodes = durable(model.atoms(), "proof-nodes")
    edges = nodes.where("proof is not null").select(CASE, F.col("atom").alias("s_atom"), F.explode("proof.pos_atoms").alias("t_atom"))
    asked = queries.select(CASE, F.col("atom").alias("query_atom"), "atom", F.lit(0).alias("d")).distinct().join(nodes.select(CASE, "atom"), [CASE, "atom"], "left_semi")
    deepest = reached(asked, edges, [CASE], ["atom"], longest=True).withColumnRenamed("d", "depth")
    w = Window.partitionBy(CASE, "query_atom").orderBy(F.desc("depth"), "atom")
    return deepest.join(nodes.select(CASE, "atom", "proof.rule_id"), [CASE, "atom"], "left").withColumn("step", F.row_number().over(w))


def run_results(model: Model, verdict_rows: DataFrame) -> DataFrame:
    """Per case: proved if any asked atom was proved by a rule, not_proved if one was refused, else unknown; and the counts."""
    proved = F.max((F.col("verdict") == "proved") & F.col("proved_by").isNotNull())
    refused = F.max(F.col("verdict").isin("not_proved", "blocked"))
    return verdict_rows.groupBy(CASE).agg(
        F.when(proved, "proved").when(refused, "not_proved").otherwise("unknown").alias("result"),
        *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("proved", "blocked", "not_proved", "unknown")),
    )


#: Statuses whose true facts enter the base; strictly, only the first two.
KEPT = ("observed", "proved", "rejected", "retracted")


def base_facts(facts: DataFrame, strict: bool = False) -> DataFrame:
    """Facts that rules may rest on: kept statuses and true with enough confidence; candidates never."""
    return facts.where(F.col("status").isin(*KEPT[: 2 if strict else 4]) & is_true(F.col("value"), F.col("confidence")))


def cluster_atoms(states: DataFrame) -> DataFrame:
    """cluster(entity, value) for every decided state; values in lower case."""
    value = F.lower(argmax_value(F.col("logits"), F.col("domain")))
    atom = F.concat(F.lower("cluster"), F.lit("("), F.col("entity_role"), F.lit("="), F.col("entity_id").cast("string"), F.lit(","), F.col("value_role"), F.lit("="), value, F.lit(")"))
    return states.where(is_decided(F.col("logits"), F.col("is_clamped"))).select(CASE, F.lower("cluster").alias("predicate"), atom.alias("atom"), "entity_id", value.alias("value"))


def unit_clauses(cases: DataFrame, predicate: str, rows: list[dict[str, object]]) -> DataFrame:
    """Clauses without a body hold in every case."""
    names = sorted(rows[0])
    clauses = cases.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], names)
    return cases.crossJoin(F.broadcast(clauses)).select(CASE, *names, atom_key(F.lit(predicate), {n: F.col(n) for n in names}).alias("atom"))
