"""Stored proof runs: their steps with the facts, original ids and texts they rest on, and the view that pairs steps with atoms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.functions.scalars import name_uuid
from rulefact.operators.paths import reached
from rulefact.plans.rules import CASE, PROOF, Model
from rulefact.plans.verdict import asked_predicates
from rulefact.sources.durable import durable

#: Types of which equal values have equal texts.
PLAIN = ("tinyint", "smallint", "int", "bigint", "date", "boolean", "string")


def fact_index(facts: DataFrame) -> DataFrame:
    """case_id, atom, fact_id, source_id, span: the fact that states an atom (the first by id) of facts(case_id, fact_id, atom, source_id,
    spans), with its source and first span."""
    first = F.min(F.struct("fact_id", "source_id", F.try_element_at("spans", F.lit(1)).alias("span")))
    return facts.where("atom IS NOT NULL AND fact_id IS NOT NULL").groupBy(CASE, "atom").agg(first.alias("fact")).select(CASE, "atom", "fact.*")


def span_texts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows(source_id, span, ..) with text: the piece of its source that a span marks; rows without source or span, or whose source
    is not known, are left out, and without bounds it is null. Bounds count characters from 0, the end is not part of the text;
    beyond the source there is nothing. sources(source_id, content).
    """
    x = rows.where("source_id IS NOT NULL AND span IS NOT NULL").join(sources.select("source_id", "content"), "source_id")
    length = F.greatest(F.col("span.end") - F.col("span.start"), F.lit(0))
    return x.withColumn("text", F.substring(F.col("content"), F.col("span.start") + 1, length)).drop("content")


def original_values(rows: DataFrame, key: list[str], originals: DataFrame) -> DataFrame:
    """key, substitution (`v=value` joined by commas, as proofs have it) with each value that originals(normalized, original) knows
    replaced by its original. Other values stay; the order of the variables stays."""
    parts = rows.select(*key, F.posexplode(F.split("substitution", ",(?=[A-Za-z_][A-Za-z_0-9]*=)")).alias("k", "part"))
    parts = parts.select(*key, "k", F.substring_index("part", "=", 1).alias("v"), F.regexp_replace("part", "^[^=]*=", "").alias("normalized"))
    parts = parts.join(originals.groupBy("normalized").agg(F.min("original").alias("original")), "normalized", "left")
    text = F.struct("k", F.concat("v", F.lit("="), F.coalesce("original", "normalized")).alias("t"))
    return parts.groupBy(*key).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(text)), lambda x: x["t"])).alias("substitution"))


def _whole(model: Model) -> bool:
    """Whether what proofs rest on is in the model by construction, text by text: positive literals give every role of their predicate
    a variable, and a variable has one type throughout a body, whose text tells the value."""
    frames = model.frames()
    for r in model.rules:
        kinds: dict[str, str] = {}
        for x in r.positives:
            if x.predicate not in frames or {role for role, _ in x.args} != set(frames[x.predicate].columns) - {CASE}:
                return False
            for role, term in x.args:
                kind = frames[x.predicate].schema[role].dataType.simpleString()
                if not isinstance(term, str) or term == "_" or kind not in PLAIN or kinds.setdefault(term, kind) != kind:
                    return False
    return True


def _deepest(model: Model, asked: DataFrame) -> DataFrame:
    """case_id, atom, proof, d: the asked atoms of the model and all that their proofs rest on; d is the longest way down.

    Rules that do not recurse from the asked predicates are followed level by level, each with the predicates that it can have:
    base atoms that a level names are not looked up again where they must be there. Recursion goes in strides.
    """
    heads: dict[str, set[str]] = {}
    for r in model.rules:
        heads.setdefault(r.head.predicate, set()).update(x.predicate for x in r.positives)
    levels = [asked_predicates(asked)]
    while (below := set().union(*(heads.get(p, set()) for p in levels[-1]))) and len(levels) <= len(heads):
        levels.append(below)
    if below:
        nodes = durable(model.atoms(set().union(levels[0], heads, *heads.values())), "proof-nodes")
        edges = nodes.where("proof IS NOT NULL").select(CASE, F.col("atom").alias("s_atom"), F.explode("proof.pos_atoms").alias("t_atom"))
        start = asked.join(nodes.where(F.col("predicate").isin(*levels[0])).select(CASE, "atom"), [CASE, "atom"], "left_semi").withColumn("d", F.lit(0))
        return reached(start, edges, [CASE], ["atom"], longest=True).join(nodes.select(CASE, "atom", "proof"), [CASE, "atom"])
    whole, found = _whole(model), []
    for d, here in enumerate(levels):
        ruled = here & heads.keys()
        if d == 0:
            rows = asked.join(model.atoms(here).select(CASE, "atom", "proof"), [CASE, "atom"])
        else:
            rows = rows.where("proof IS NOT NULL").select(CASE, F.explode("proof.pos_atoms").alias("atom")).distinct()
            if not whole:
                rows = rows.join(model.atoms(here).select(CASE, "atom", "proof"), [CASE, "atom"])
            elif ruled:
                rows = rows.join(Model(model.rules, {}, model.derived).atoms(ruled).select(CASE, "atom", "proof"), [CASE, "atom"], "left")
            else:
                rows = rows.withColumn("proof", F.lit(None).cast(PROOF))
        rows = durable(rows, "proof-level") if ruled else rows
        found.append(rows.select(CASE, "atom", "proof", F.lit(d).alias("d")))
    out = reduce(lambda a, b: a.unionByName(b), found)
    if len(set().union(*levels)) == sum(map(len, levels)):
        return out  # no predicate is on two levels
    return out.groupBy(CASE, "atom").agg(F.max("proof").alias("proof"), F.max("d").alias("d"))


def _proof_id() -> Column:
    return name_uuid(F.concat_ws("/", F.lit("proof"), F.col(CASE).cast("string")))


def _runs(asked: DataFrame, steps: DataFrame) -> DataFrame:
    sizes = steps.groupBy(CASE).agg(F.count(F.lit(1)).alias("n_steps"))
    runs = asked.groupBy(CASE).agg(F.count(F.lit(1)).alias("n_queries")).join(sizes, CASE, "left")
    return runs.select(CASE, _proof_id().alias("proof_id"), F.when(F.col("n_steps").isNull(), "not_proved").otherwise("proved").alias("result"), "n_queries", F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


def proof_runs(model: Model, queries: DataFrame) -> DataFrame:
    """The runs of proof_store alone: steps are counted, neither put in order nor written."""
    asked = queries.select(CASE, "atom").distinct()
    return _runs(asked, _deepest(model, asked).select(CASE))


def proof_store(model: Model, queries: DataFrame, facts: DataFrame, sources: DataFrame, rule_texts: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, steps) of one proof run per case of queries(case_id, atom).

    runs: case_id, proof_id, result (proved if the model has an asked atom, else not_proved), n_queries, n_steps.
    steps: case_id, proof_id, step_order (from 0, what a step rests on comes first), atom, status (base or derived), rule_id,
    substitution with original values, used_fact_ids (of the positive literals in order; empty where no fact states one),
    depends_on, naf_checked, source_span_text (a rule's own text, or what a base fact's first span marks).

    facts(case_id, fact_id, atom, source_id, spans), sources(source_id, content), rule_texts(rule_id, source_span_text),
    originals(normalized, original). An atom that several asked ones rest on is one step: its place is that of its longest way
    down from any of them, then by its text.
    """
    asked = queries.select(CASE, "atom").distinct()
    order = F.row_number().over(Window.partitionBy(CASE).orderBy(F.desc("d"), "atom")) - 1
    steps = durable(_deepest(model, asked).select(CASE, "atom", "proof", order.alias("step_order")), "proof-steps")

    base = F.col("proof").isNull()
    named = steps.select(CASE, "step_order", base.alias("base"), F.posexplode(F.when(base, F.array("atom")).otherwise(F.col("proof.pos_atoms"))).alias("k", "atom"))
    named = durable(named.join(fact_index(facts), [CASE, "atom"], "left").drop("atom"), "proof-facts")
    used = named.where("NOT base").groupBy(CASE, "step_order").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("fact_id", F.lit("")).alias("f")))), lambda x: x["f"]).alias("used_fact_ids"))
    bound = original_values(steps.where("proof IS NOT NULL").select(CASE, "step_order", "proof.substitution"), [CASE, "step_order"], originals)
    told = span_texts(named.where("base"), sources).select(CASE, "step_order", F.col("text").alias("fact_text"))

    none = F.array().cast("array<string>")
    out = steps.withColumn("rule_id", F.col("proof.rule_id"))
    for other in (used, bound, told):
        out = out.join(other, [CASE, "step_order"], "left")
    out = out.join(F.broadcast(rule_texts.select("rule_id", "source_span_text")), "rule_id", "left")  # as many as there are rules
    out = out.select(
        CASE, _proof_id().alias("proof_id"), "step_order", "atom", F.when(F.col("proof").isNull(), "base").otherwise("derived").alias("status"), "rule_id", "substitution", F.coalesce("used_fact_ids", none).alias("used_fact_ids"),
        F.coalesce("proof.pos_atoms", none).alias("depends_on"), F.coalesce("proof.naf_atoms", none).alias("naf_checked"), F.coalesce("source_span_text", "fact_text").alias("source_span_text"),
    )
    return _runs(asked, steps), out


def paired_steps(steps: DataFrame, dag: DataFrame) -> DataFrame:
    """steps(proof_id, step_order, rule_id, substitution, ..) with atom, status and source_span_text of dag(proof_id, ord, atom, rule_id,
    substitution, status, source_span_text): the k-th step of a rule and substitution goes with the k-th atom of that pair.

    Substitutions are compared as sorted JSON objects would be: by their sorted `v=value` parts. Steps beyond the atoms of their
    pair keep nulls; null rules and substitutions are a pair like others.
    """
    key = F.concat_ws("\x1f", F.coalesce("rule_id", F.lit("")), F.array_join(F.array_sort(F.split(F.coalesce("substitution", F.lit("")), ",")), ","))
    nth = lambda by: F.row_number().over(Window.partitionBy("proof_id", "pair").orderBy(by))
    a = steps.withColumn("pair", key).withColumn("nth", nth("step_order"))
    b = dag.withColumn("pair", key).withColumn("nth", nth("ord")).select("proof_id", "pair", "nth", "atom", "status", "source_span_text")
    return a.join(b, ["proof_id", "pair", "nth"], "left").drop("pair", "nth")


def run_view(runs: DataFrame, steps: DataFrame, dag: DataFrame, facts: DataFrame, feedback: DataFrame) -> DataFrame:
    """proof_id, section (1 run, 2 facts, 3 feedback, 4 steps), place (from 1), line: a proof run as it is shown.

    runs(proof_id, case_id, query, result); facts linked by proof_id (fact_id, predicate, status); feedback(proof_id, fact_id,
    predicate, outcome, atom, violated, missing, supporting) with arrays; steps and dag as paired_steps takes them, steps with
    used_fact_ids. Sections without rows show `-`.
    """
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
    listed = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f" {c}="), F.array_join(c, ";"))).otherwise("")
    place = lambda *by: F.row_number().over(Window.partitionBy("proof_id").orderBy(*by))
    many = lambda rows, name: rows.groupBy("proof_id").agg(F.count(F.lit(1)).alias(name))
    linked = facts.join(runs.select("proof_id"), "proof_id", "left_semi")
    said = feedback.join(runs.select("proof_id"), "proof_id", "left_semi")
    counts = {"steps": many(steps, "steps"), "linked_facts": many(linked, "linked_facts"), "feedback": many(said, "feedback")}
    head = runs
    for rows in counts.values():
        head = head.join(rows, "proof_id", "left")
    head = durable(head.na.fill(0, list(counts)), "proof-head")
    first = head.select("proof_id", F.lit(1).alias("section"), F.lit(1).alias("place"), F.concat(F.lit("case="), F.col("case_id").cast("string"), F.lit(" query="), dash("query"), F.lit(" result="), dash("result"), *(x for n in counts for x in (F.lit(f" {n}="), F.col(n).cast("string")))).alias("line"))
    second = linked.select("proof_id", F.lit(2).alias("section"), place("fact_id").alias("place"), F.concat_ws(" ", F.col("fact_id").cast("string"), "predicate", "status").alias("line"))
    third = said.select("proof_id", F.lit(3).alias("section"), place("fact_id", "outcome", "atom").alias("place"), F.concat(F.concat_ws(" ", F.col("fact_id").cast("string"), "predicate", "outcome"), F.lit(" atom="), dash("atom"), *map(listed, ("violated", "missing", "supporting"))).alias("line"))
    whole = paired_steps(steps, dag)
    line = F.concat(F.lit("atom="), dash("atom"), F.lit(" status="), dash("status"), F.lit(" rule="), dash("rule_id"), F.lit(" sub="), dash("substitution"), F.lit(" used_facts="), F.when(F.size("used_fact_ids") > 0, F.array_join("used_fact_ids", ";")).otherwise("-"), F.when(F.col("source_span_text").isNotNull(), F.concat(F.lit(" text="), "source_span_text")).otherwise(""))
    fourth = whole.select("proof_id", F.lit(4).alias("section"), place("step_order").alias("place"), line.alias("line"))
    empty = lambda n, name: head.where(F.col(name) == 0).select("proof_id", F.lit(n).alias("section"), F.lit(1).alias("place"), F.lit("-").alias("line"))
    out = first
    for part in (second, third, fourth, empty(2, "linked_facts"), empty(3, "feedback"), empty(4, "steps")):
        out = out.unionByName(part)
    return out
