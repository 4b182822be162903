"""Propose and verify in rounds, over all cases at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.operators import candidates as L
from rulefact.plans import verdict as V
from rulefact.plans.incremental import Maintained
from rulefact.plans.rules import CASE, Model, Rule, _union, atoms_of
from rulefact.sources.durable import durable

FACT = "case_id long, fact_id string, predicate string, atom string, status string, value string, confidence double"
COLUMNS = [c.split()[0] for c in FACT.split(", ")]


def refine(rules: list[Rule], base: dict[str, DataFrame], told_of: Callable[[DataFrame], dict[str, DataFrame]], facts: DataFrame, rounds: int = 2) -> tuple[DataFrame, Model]:
    """Facts after up to `rounds` rounds, and the last model.

    A round proposes heads of rules whose positive bodies hold, verifies candidates, and feeds the verdicts back: proved
    candidates become facts, blocked ones are rejected and false, derived atoms that no fact states are added. It ends early
    when no fact changes. `base` has the predicate frames, with a confidence column, that no fact changes; told_of gives, fact
    by fact, the rows of those that facts make.

    The first round evaluates everything. A later one takes up only what the round before has changed: the model is maintained
    under the changed rows, rules without a changed predicate and cases without a changed fact are left alone, and only
    candidates whose atom was decided anew are judged again.
    """
    facts = durable(facts.select(*COLUMNS), "facts")
    told = told_of(facts)
    state: Maintained | None = None
    before = after = None  # the changed facts as they were and as they are
    for _ in range(rounds):
        if state is None:
            state = Maintained(base | told, rules)
            again = facts.where("status = 'candidate'")
        else:
            gone = {p: f.join(told[p].select(f.columns), f.columns, "left_anti") for p, f in told_of(before).items()} if before is not None else {}
            changes = state.update(told_of(after), gone)
            if not changes:
                break
            decided = atoms_of(state.decided | {p: _union([c.plus, c.minus]).drop("confidence") for p, c in changes.items() if p not in state.decided})
            again = facts.where("status = 'candidate'").join(decided.select(CASE, "atom").distinct(), [CASE, "atom"], "left_semi")
        model = state.model()
        if any(r.rule_id in state.grown for r in rules):
            proposed = L.from_bodies(rules, state.grown, facts).withColumn("value", F.lit("T")).select(*COLUMNS)
            again = again.unionByName(proposed)
        again = durable(again, "judged")
        outcome = V.feedback(model, again.select(CASE, "fact_id", "predicate", "atom")).select(CASE, "fact_id", "outcome")
        status = F.when(F.col("outcome") == "proved", "proved").when(F.col("outcome") == "blocked", "rejected").otherwise(F.col("status"))
        value = F.when(F.col("outcome") == "blocked", "F").otherwise(F.col("value"))
        judged = again.join(outcome, [CASE, "fact_id"], "left").withColumns({"status": status, "value": value}).select(*COLUMNS)
        held = {p: f.join(state.decided[p], state.decided[p].columns, "left_semi") for p, f in state.derived.items() if p in state.decided}
        new = V.new_facts(Model(rules, {}, held), facts.unionByName(again)).select(*COLUMNS) if held else judged.limit(0)
        known = facts.select(CASE, "fact_id", F.col("status").alias("was"), F.col("value").alias("was_value"))
        differs = F.col("was").isNull() | (F.col("was") != F.col("status")) | ~F.col("was_value").eqNullSafe(F.col("value"))
        changed = durable(judged.unionByName(new).join(known, [CASE, "fact_id"], "left").where(differs), "changed")
        if changed.isEmpty():
            break
        after, old = changed.select(*COLUMNS), changed.where("was IS NOT NULL")
        before = None if old.isEmpty() else old.withColumns({"status": F.col("was"), "value": F.col("was_value")}).select(*COLUMNS)
        facts = (facts.join(after, [CASE, "fact_id"], "left_anti") if before is not None else facts).unionByName(after)
        told = told_of(facts)
    return facts, state.model()
