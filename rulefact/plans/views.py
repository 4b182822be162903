"""Evaluation of stored queries and lineage views: catalogues, proofs and networks as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.functions.scalars import softmax
from rulefact.operators import aggregates as A
from rulefact.plans.rules import CASE, Model
from rulefact.plans.verdict import proof_edges, verdicts


def evaluated(model: Model, queries: DataFrame) -> DataFrame:
    """queries(case_id, query_id, predicate, atom, expected) with verdict, correct (blocked answers not_proved too) and has_proof."""
    v = verdicts(model, queries.drop("expected")).join(queries.select(CASE, "query_id", "expected"), [CASE, "query_id"])
    correct = (F.col("verdict") == F.col("expected")) | ((F.col("verdict") == "blocked") & (F.col("expected") == "not_proved"))
    return v.select(CASE, "query_id", "expected", "verdict", correct.alias("correct"), F.col("proved_by").isNotNull().alias("has_proof"))


def case_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy(CASE).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_queries"))


def calibration_pairs(candidates: DataFrame, verdict_rows: DataFrame) -> DataFrame:
    """Confidence of true candidates against whether they were proved."""
    v = verdict_rows.select(CASE, F.col("query_id").alias("fact_id"), (F.col("verdict") == "proved").alias("proved"))
    return candidates.where("value = 'T'").join(v, [CASE, "fact_id"]).select(CASE, "fact_id", "confidence", "proved")


#: Targets a metric is held against: at least, or at most.
GATES = {"accuracy": (">=", 0.9), "macro_f1": (">=", 0.85), "answer_coverage": (">=", 0.95), "proof_coverage": (">=", 0.98), "ece": ("<=", 0.08), "latency_p95": ("<=", 2000.0), "replay_rate": (">=", 1.0)}


def _judged(metrics: DataFrame) -> DataFrame:
    """metric, value with passed: whether the metric's gate is met; null where it has none, or no value."""
    passed = F.coalesce(*(F.when(F.col("metric") == m, F.col("value") >= g if op == ">=" else F.col("value") <= g) for m, (op, g) in GATES.items()))
    return metrics.withColumn("passed", passed)


def report(rows: DataFrame) -> DataFrame:
    """metric, value, passed: one row per metric of evaluated queries(expected, verdict, correct, has_proof)."""
    x = rows.select("expected", F.col("verdict").alias("got"), "correct", "has_proof")
    one = x.agg(A.share(F.col("correct")).alias("accuracy"), A.share(F.col("got") != "unknown").alias("answer_coverage"), F.avg(F.when(F.col("got") == "proved", F.col("has_proof").cast("double"))).alias("proof_coverage"))
    both = one.crossJoin(A.macro(A.per_label(x)).select("macro_f1"))
    return _judged(both.unpivot([], list(both.columns), "metric", "value"))


def full_report(rows: DataFrame, pairs: DataFrame, timings: DataFrame, runs: DataFrame, errors: DataFrame) -> DataFrame:
    """report() with ece and brier of calibration pairs(confidence, proved), latency_p50, latency_p95 and latency_mean of
    timings(ms), replay_rate of runs(case_id, replay, line), and n_errors of the cases that could not be evaluated.

    A metric without rows is null, and its gate is neither met nor missed."""
    frames = [
        A.calibration_error(pairs, "confidence", "proved").select("ece"),
        pairs.agg(A.brier(F.col("confidence"), F.col("proved")).alias("brier")),
        A.latency(timings, "ms").select(F.col("p50").alias("latency_p50"), F.col("p95").alias("latency_p95"), F.col("mean").alias("latency_mean")),
        A.replay_rate(runs).select("replay_rate"),
        errors.agg(F.count(F.lit(1)).cast("double").alias("n_errors")),
    ]
    out = report(rows).select("metric", "value")
    for f in frames:
        out = out.unionByName(f.select(*(F.col(c).cast("double").alias(c) for c in f.columns)).unpivot([], f.columns, "metric", "value"))
    return _judged(out)


def unanswered(cases: DataFrame, queries: DataFrame) -> DataFrame:
    """Holdout cases without a stored query."""
    return cases.join(queries.select(CASE).distinct(), CASE, "left_anti")


def fact_catalogue(facts: DataFrame, args: DataFrame, traces: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their arguments in order, trace count and source."""
    a = args.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws("=", "role", "value").alias("t")))).alias("x"), F.count(F.lit(1)).alias("n_args")).select("fact_id", F.concat_ws(", ", "x.t").alias("args"), "n_args")
    n = traces.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n_traces"))
    return facts.join(a, "fact_id", "left").join(n, "fact_id", "left").join(sources, "source_id", "left").na.fill(0, ["n_args", "n_traces"])


def _counted(rows: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """rows with, for each other table, the number of its rows of the same key (0 if none)."""
    for name, other in others.items():
        rows = rows.join(other.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return rows.na.fill(0, list(others))


def entity_catalogue(entities: DataFrame, args: DataFrame, states: DataFrame) -> DataFrame:
    """entities(entity_id, type, canonical_name) with the facts that name each and its states."""
    return _counted(entities, {"n_facts": args.select("entity_id", "fact_id").distinct(), "n_states": states}, "entity_id")


def case_catalogue(cases: DataFrame, facts: DataFrame, queries: DataFrame, sources: DataFrame) -> DataFrame:
    return _counted(cases, {"n_facts": facts, "n_queries": queries, "n_sources": sources}, CASE)


def source_catalogue(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """sources(source_id, name) with their facts and the cases those belong to."""
    cases = facts.select("source_id", CASE).distinct()
    return _counted(sources, {"n_facts": facts, "n_cases": cases}, "source_id")


def type_catalogue(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("n_entities"))


def predicate_catalogue(frames: dict[str, DataFrame], rules: list) -> DataFrame:
    """predicate, arity, n_facts, n_rules (that use it) of every predicate frame."""
    out = None
    for p, f in frames.items():
        used = sum(any(x.predicate == p for x in (r.head, *r.body)) for r in rules)
        part = f.agg(F.lit(p).alias("predicate"), F.lit(len(f.columns) - 1).cast("long").alias("arity"), F.count(F.lit(1)).alias("n_facts"), F.lit(used).cast("long").alias("n_rules"))
        out = part if out is None else out.unionByName(part)
    return out


def rule_catalogue(model: Model) -> DataFrame:
    """rule_id, head, stratum, n_pos, n_naf of the rules, and how many atoms each proves."""
    rows = [(r.rule_id, r.head.predicate, r.stratum or 0, len(r.positives), len(r.negatives)) for r in model.rules]
    atoms = model.atoms()
    rules = atoms.sparkSession.createDataFrame(rows, "rule_id string, head string, stratum long, n_pos long, n_naf long")
    return _counted(rules, {"n_proved": atoms.where("proof IS NOT NULL").select("proof.rule_id")}, "rule_id")


def cluster_catalogue(schemas: DataFrame, states: DataFrame) -> DataFrame:
    """schemas(cluster, entity_type, domain) with the size of the domain, states, clamped ones and values seen."""
    seen = states.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_states"), F.count_if("is_clamped").alias("n_clamped"), F.count_distinct("value").alias("n_values"))
    return schemas.select("cluster", "entity_type", F.size("domain").cast("long").alias("n_domain")).join(seen, "cluster", "left").na.fill(0, ["n_states", "n_clamped", "n_values"])


def module_catalogue(rules: DataFrame) -> DataFrame:
    """module, n_rules, n_enabled, strata (the lowest and the highest) of rules(rule_id, module, stratum, enabled)."""
    return rules.groupBy("module").agg(F.count(F.lit(1)).alias("n_rules"), F.count_if("enabled").alias("n_enabled"), F.min("stratum").alias("lowest"), F.max("stratum").alias("highest"))


def proof_view(model: Model) -> DataFrame:
    """case_id, atom, rule_id, substitution, n_pos, n_naf of every derived atom."""
    p = model.atoms().where("proof is not null")
    return p.select(CASE, "atom", "proof.rule_id", "proof.substitution", F.size("proof.pos_atoms").alias("n_pos"), F.size("proof.naf_atoms").alias("n_naf"))


def proof_graph(model: Model) -> tuple[DataFrame, DataFrame]:
    """(nodes with kind base, derived or external, edges): external are atoms that edges name and the model lacks."""
    atoms = model.atoms()
    edges = proof_edges(model)
    nodes = atoms.select(CASE, "atom", F.when(F.col("proof").isNull(), "base").otherwise("derived").alias("kind"))
    named = edges.select(CASE, F.col("depends_on").alias("atom")).distinct()
    known = model.atoms({x.predicate for r in model.rules for x in r.body})  # no other predicate's atoms are named
    return nodes.unionByName(named.join(known.select(CASE, "atom"), [CASE, "atom"], "left_anti").withColumn("kind", F.lit("external"))), edges


def case_network(nodes: DataFrame, args: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: entity, fact, cluster; edges: state, role) from belief nodes and fact arguments."""
    fact = nodes.where("node_type = 'fact'").select(CASE, F.concat(F.lit("fact:"), F.col("node_id").cast("string")).alias("id"), F.lit("fact").alias("kind"))
    cluster = nodes.where("node_type <> 'fact'").select(CASE, F.concat_ws(":", "node_type", F.col("node_id").cast("string")).alias("id"), F.lit("cluster").alias("kind"), "node_id")
    entity_id = lambda c: F.concat(F.lit("entity:"), F.col(c).cast("string"))
    entity = cluster.select(CASE, entity_id("node_id").alias("id")).unionByName(args.select(CASE, entity_id("entity_id").alias("id"))).distinct().withColumn("kind", F.lit("entity"))
    state = cluster.select(CASE, entity_id("node_id").alias("src"), F.col("id").alias("dst"), F.lit("state").alias("kind"))
    role = args.select(CASE, F.concat(F.lit("fact:"), F.col("fact_id").cast("string")).alias("src"), entity_id("entity_id").alias("dst"), F.lower("role").alias("kind"))
    return fact.unionByName(cluster.drop("node_id")).unionByName(entity), state.unionByName(role)


def labelled_network(nodes: DataFrame, facts: DataFrame, args: DataFrame, edges: DataFrame, schemas: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: case_id, id, kind, label; edges: case_id, src, dst, kind, label) of a belief graph as it is drawn.

    Facts show their predicate and status (`-` where no row of facts(case_id, fact_id, predicate, status) tells), clusters their
    top value with its probability (the first of equal ones) and whether states(case_id, cluster, entity_id, is_clamped,
    clamp_hard) clamp them. Edges: an entity to its cluster (state), to the facts that name it (role), and every edge of the graph
    between nodes (relation).
    """
    plain = case_network(nodes, args)[0]
    entity = plain.where("kind = 'entity'").select(CASE, "id", "kind", F.substring_index("id", ":", -1).alias("label"))
    f = nodes.where("node_type = 'fact'").select(CASE, F.col("node_id").alias("fact_id")).join(facts.select(CASE, "fact_id", "predicate", "status"), [CASE, "fact_id"], "left")
    fact = f.select(CASE, F.concat(F.lit("fact:"), F.col("fact_id").cast("string")).alias("id"), F.lit("fact").alias("kind"), F.concat(F.coalesce("predicate", F.lit("-")), F.lit(" status="), F.coalesce("status", F.lit("-"))).alias("label"))
    c = nodes.where("node_type <> 'fact'").withColumn("cluster", F.regexp_replace("node_type", "^c_", "")).join(schemas.select("cluster", "domain"), "cluster", "left")
    c = c.join(states.select(CASE, "cluster", F.col("entity_id").alias("node_id"), "is_clamped", "clamp_hard"), [CASE, "cluster", "node_id"], "left")
    p = softmax(F.col("logits"))
    at = F.array_position(p, F.array_max(p)).cast("int")
    top = F.concat(F.coalesce(F.try_element_at("domain", at), (at - 1).cast("string")), F.lit(" ("), F.format_number(F.array_max(p), 2), F.lit(")"))
    clamped = F.concat(F.when(F.col("is_clamped"), " clamped=yes").otherwise(" clamped=no"), F.when(F.col("clamp_hard"), " hard").otherwise(""))
    key = lambda kind, node: F.when(F.col(kind) == "fact", F.concat(F.lit("fact:"), F.col(node).cast("string"))).otherwise(F.concat_ws(":", kind, F.col(node).cast("string")))
    cluster = c.select(CASE, key("node_type", "node_id").alias("id"), F.lit("cluster").alias("kind"), F.concat(F.lit("top="), top, clamped).alias("label"))

    named = lambda e: F.concat(F.lit("entity:"), F.col(e).cast("string"))
    state = c.select(CASE, named("node_id").alias("src"), key("node_type", "node_id").alias("dst"), F.lit("state").alias("kind"), F.lit("state").alias("label"))
    role = args.where("entity_id IS NOT NULL").select(CASE, named("entity_id").alias("src"), F.concat(F.lit("fact:"), F.col("fact_id").cast("string")).alias("dst"), F.lit("role").alias("kind"), F.col("role").alias("label"))
    relation = edges.select(CASE, key("src_type", "src_id").alias("src"), key("dst_type", "dst_id").alias("dst"), F.lit("relation").alias("kind"), F.col("relation").alias("label"))
    return entity.unionByName(fact).unionByName(cluster), state.unionByName(role).unionByName(relation)


def case_brief(lines: DataFrame, most: int = 20) -> DataFrame:
    """case_id, section, brief: at most `most` rendered lines(case_id, section, ord, line) of each section, in order."""
    from rulefact.operators.picks import top

    x = top(lines, [CASE, "section"], [F.col("ord"), F.col("line")], most, rank="place")
    return x.groupBy(CASE, "section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x")).select(CASE, "section", F.concat_ws("\n", "x.line").alias("brief"))


def grounded_brief(states: DataFrame, facts: DataFrame, steps: DataFrame, influences: DataFrame, names: DataFrame, most_facts: int = 20, most_influences: int = 2) -> DataFrame:
    """case_id, place, title, brief: the sections of a case brief that rests on stored rows only; a section without rows is left out.

    1 properties: states(case_id, entity_id, cluster, value, confidence), a line for each, by entity and cluster.
    2 facts: facts(case_id, fact_id, predicate, status, args array<struct<role, entity_id, value>> (one of the two), source_id), proved ones first, then
      observed ones, by fact_id, at most `most_facts`; the title counts all of both. Other statuses are left out.
    3 conclusions: steps(case_id, step_order, atom, rule_id, depends_on, naf_checked) of rules, in order.
    4 influences: influences(case_id, fact_id, source_id, relation, magnitude), the `most_influences` largest of each fact shown.
    Entities are shown by names(entity_id, name); those without a name by their id.
    """
    from rulefact.operators.picks import top

    number = lambda c: F.format_number(c, 2)
    named = names.groupBy("entity_id").agg(F.min("name").alias("name"))
    s = states.join(named, "entity_id", "left").select(CASE, F.struct(F.col("entity_id").cast("string").alias("a"), F.col("cluster").alias("b")).alias("ord"), F.concat(F.lit("- "), F.coalesce("name", F.col("entity_id").cast("string")), F.lit(": "), F.lower("cluster"), F.lit(" = "), "value", F.lit(" ("), number(F.col("confidence")), F.lit(")")).alias("line"))

    shown = facts.where("status IN ('proved', 'observed')")
    counts = shown.groupBy(CASE).agg(F.concat(F.lit("Facts ("), F.count_if(F.col("status") == "proved").cast("string"), F.lit(" proved, "), F.count_if(F.col("status") == "observed").cast("string"), F.lit(" observed)")).alias("title"))
    picked = top(shown, [CASE], [F.when(F.col("status") == "proved", 0).otherwise(1), F.col("fact_id")], most_facts, rank="nth")
    args = picked.select(CASE, "fact_id", F.posexplode("args").alias("k", "arg")).join(named, F.col("arg.entity_id") == F.col("entity_id"), "left")
    args = args.groupBy(CASE, "fact_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat(F.lower(F.col("arg.role")), F.lit(" "), F.coalesce("name", F.col("arg.entity_id"), F.col("arg.value"), F.lit("-"))).alias("t")))), lambda x: x["t"]), ", ").alias("args"))
    f = picked.drop("args").join(args, [CASE, "fact_id"], "left").select(CASE, "nth", "fact_id", F.concat(F.lit("- ["), "status", F.lit("] "), F.lower("predicate"), F.lit("("), F.coalesce("args", F.lit("")), F.lit(")"), F.when(F.col("source_id").isNotNull(), F.concat(F.lit(" from "), F.col("source_id").cast("string"))).otherwise("")).alias("line"))

    told = lambda c, word: F.when(F.size(c) > 0, F.concat(F.lit(word), F.array_join(c, "; "))).otherwise("")
    p = steps.where("rule_id IS NOT NULL").select(CASE, "step_order", F.concat(F.lit("- "), "atom", F.lit(" by "), "rule_id", told("depends_on", " from "), told("naf_checked", " without ")).alias("line"))

    i = top(influences.join(picked.select(CASE, "fact_id", F.col("nth").alias("of")), [CASE, "fact_id"]), [CASE, "fact_id"], [F.desc("magnitude"), F.col("source_id"), F.col("relation")], most_influences, rank="nth")
    i = i.select(CASE, F.struct("of", "nth").alias("ord"), F.concat(F.lit("- "), F.col("fact_id").cast("string"), F.lit(" <- "), F.col("source_id").cast("string"), F.lit(" via "), "relation", F.lit(" ("), number(F.col("magnitude")), F.lit(")")).alias("line"))

    def section(place: int, title: object, rows: DataFrame, order: str) -> DataFrame:
        text = rows.groupBy(CASE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "line"))), lambda x: x["line"]), "\n").alias("brief"))
        return text.select(CASE, F.lit(place).alias("place"), F.lit(title).alias("title"), "brief")

    out = section(1, "Properties", s, "ord")
    out = out.unionByName(section(2, "", f, "nth").drop("title").join(counts, CASE).select(CASE, "place", "title", "brief"))
    return out.unionByName(section(3, "Conclusions", p, "step_order")).unionByName(section(4, "Influences", i, "ord"))


def stratification_problems(heads: DataFrame, body: DataFrame) -> DataFrame:
    """rule_id, problem over rule tables: heads(rule_id, predicate, stratum), body(rule_id, negated, predicate).

    A head predicate has one stratum (the smallest counts if it has several); positive bodies lie not above the head, negated
    ones below; predicates without rules are free.
    """
    of = heads.groupBy("predicate").agg(F.min("stratum").alias("s"), F.count_distinct("stratum").alias("n"))
    several = heads.join(of, "predicate").where("n > 1").select("rule_id", F.lit("several_strata").alias("problem"))
    x = body.join(of.select("predicate", "s"), "predicate").join(heads.select("rule_id", "stratum"), "rule_id")
    below = x.where("negated AND s >= stratum").select("rule_id", F.lit("negated_not_below").alias("problem"))
    above = x.where("NOT negated AND s > stratum").select("rule_id", F.lit("body_above").alias("problem"))
    return several.unionByName(below).unionByName(above)
