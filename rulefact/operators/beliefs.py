"""Belief propagation over a typed graph of entity attributes and facts.

Nodes: (case_id, node_type, node_id, logits, frozen). Edges: (case_id, src_type, src_id, relation, dst_type, dst_id).
Weights: (src_type, relation, dst_type, i, j, w_pos, w_neg_raw). A step joins edges with the softmax of their sources, multiplies
by the weights and sums per destination; Spark does the sums, no vector passes through Python.
Schemas, rules, relations and gates are few, as types of nodes are: they are broadcast, so that edges are not dealt by so few keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.functions.scalars import argmax_value, sigmoid, softmax, softplus
from rulefact.sources.durable import durable

HARD, SOFT = 10.0, 3.0
NODE = ["case_id", "node_type", "node_id"]
TRUTH = ["T", "F", "U"]


def fitted(logits: Column, size: Column) -> Column:
    """logits cut or filled with zeros to `size` entries; none: zeros."""
    l = F.coalesce(logits, F.array().cast("array<double>"))  # noqa: E741
    return F.slice(F.concat(l, F.array_repeat(F.lit(0.0), F.greatest(size - F.size(l), F.lit(0)))), F.lit(1), size)


def hard(size: Column, at: Column) -> Column:
    """+10 at position `at` (from 0), -10 elsewhere."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.when(k == at, F.lit(HARD)).otherwise(F.lit(-HARD)))


def clamped(logits: Column, mode: Column) -> Column:
    """mode hard: +-10 by the largest; soft: the largest plus 3; else as is."""
    at = F.array_position(logits, F.array_max(logits)) - 1
    soft = F.transform(logits, lambda x, k: F.when(k == at, x + SOFT).otherwise(x))
    return F.when(mode == "hard", hard(F.size(logits), at)).when(mode == "soft", soft).otherwise(logits)


def cluster_nodes(entities: DataFrame, states: DataFrame, schemas: DataFrame) -> DataFrame:
    """A node for each entity of a cluster's type and for each state; a state gives the logits, else zeros."""
    s = schemas.select("cluster", "entity_type", F.size("domain").alias("dim"))
    by_type = entities.join(F.broadcast(s), "entity_type").select("case_id", "cluster", "entity_id")
    ids = by_type.unionByName(states.select("case_id", "cluster", "entity_id")).distinct()
    x = ids.join(states, ["case_id", "cluster", "entity_id"], "left").join(F.broadcast(s.select("cluster", "dim")), "cluster")
    is_hard = F.coalesce(F.col("clamp_hard"), F.lit(False))
    logits = fitted(F.col("logits"), F.col("dim"))
    return x.select("case_id", F.concat(F.lit("c_"), "cluster").alias("node_type"), F.col("entity_id").alias("node_id"), F.when(is_hard, clamped(logits, F.lit("hard"))).otherwise(logits).alias("logits"), is_hard.alias("frozen"))


def fact_nodes(facts: DataFrame) -> DataFrame:
    """Logits given: clamped by them; a value given: clamped to it; else zeros and free."""
    at = F.array_position(F.array(*map(F.lit, TRUTH)), F.col("value")) - 1
    logits = F.when(F.col("logits").isNotNull(), clamped(F.col("logits"), F.lit("hard"))).when(F.col("value").isNotNull(), hard(F.lit(3), at)).otherwise(F.array(*[F.lit(0.0)] * 3))
    return facts.select("case_id", F.lit("fact").alias("node_type"), F.col("fact_id").alias("node_id"), logits.alias("logits"), (F.col("logits").isNotNull() | F.col("value").isNotNull()).alias("frozen"))


def role_edges(args: DataFrame, nodes: DataFrame) -> DataFrame:
    """fact -> cluster node of each argument's entity; an entity in two roles gives two edges."""
    n = nodes.where("node_type <> 'fact'").select("case_id", F.col("node_id").alias("entity_id"), F.col("node_type").alias("dst_type"))
    return args.join(n, ["case_id", "entity_id"]).select("case_id", F.lit("fact").alias("src_type"), F.col("fact_id").alias("src_id"), F.lit("role_of").alias("relation"), "dst_type", F.col("entity_id").alias("dst_id"))


def implication_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Between two cluster nodes of one entity, for each (src_type, dst_type) of a learned rule, once."""
    a = nodes.select("case_id", F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"))
    b = nodes.select("case_id", F.col("node_type").alias("dst_type"), F.col("node_id").alias("src_id"))
    return a.join(pairs.distinct(), "src_type").join(b, ["case_id", "src_id", "dst_type"]).select("case_id", "src_type", "src_id", F.lit("implies").alias("relation"), "dst_type", F.col("src_id").alias("dst_id")).distinct()


def support_edges(rules: DataFrame, args: DataFrame) -> DataFrame:
    """fact -> cluster node under supports:<pred>:<ROLE>: rules(predicate, role, cluster), args(case_id, fact_id, predicate, role, entity_id)."""
    x = args.join(F.broadcast(rules), ["predicate", "role"])
    relation = F.concat(F.lit("supports:"), F.lower("predicate"), F.lit(":"), F.upper("role"))
    return x.select("case_id", F.lit("fact").alias("src_type"), F.col("fact_id").alias("src_id"), relation.alias("relation"), F.concat(F.lit("c_"), "cluster").alias("dst_type"), F.col("entity_id").alias("dst_id")).distinct()


def with_memory(nodes: DataFrame, slots: DataFrame, schemas: DataFrame) -> DataFrame:
    """Free cluster nodes whose entity remembers a value of the domain: 3 * confidence is added there; slots are the best ones."""
    s = schemas.select(F.concat(F.lit("c_"), "cluster").alias("node_type"), F.col("cluster").alias("slot_name"), "domain")
    m = slots.select(F.col("entity_id").alias("node_id"), "slot_name", "value", F.coalesce("confidence", F.lit(1.0)).alias("__confidence"))
    x = nodes.join(s, "node_type", "left").join(m, ["node_id", "slot_name"], "left")
    at = F.array_position("domain", F.col("value")) - 1
    biased = F.transform("logits", lambda v, k: F.when(k == at, v + SOFT * F.col("__confidence")).otherwise(v))
    return x.withColumn("logits", F.when(~F.col("frozen") & (at >= 0), biased).otherwise(F.col("logits"))).select(*nodes.columns)


def rule_weights(rules: DataFrame) -> DataFrame:
    """rules(src_type, relation, dst_type, i, j, weight): the largest weight per cell, as w_pos; relations without rules weigh 0."""
    return rules.groupBy("src_type", "relation", "dst_type", "i", "j").agg(F.max("weight").alias("w_pos")).withColumn("w_neg_raw", F.lit(None).cast("double"))


def edge_messages(nodes: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """case_id, src, relation, dst, j, delta: what each edge sends to each value of its destination.

    A relation's weights are one row that holds its matrix, so an edge meets one row for its source and one for its relation, and
    the product of probabilities and matrix is computed in place. An edge with a column n counts n times.
    """
    times = F.col("n") if "n" in edges.columns else F.lit(1)
    p = nodes.select("case_id", F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"), softmax(F.col("logits")).alias("p"))
    w = F.coalesce("w_pos", F.lit(0.0)) - F.coalesce(softplus(F.col("w_neg_raw")), F.lit(0.0))
    m = weights.groupBy("src_type", "relation", "dst_type").agg(F.sort_array(F.collect_list(F.struct("j", "i", w.alias("w")))).alias("cells"))
    x = edges.join(p, ["case_id", "src_type", "src_id"]).join(F.broadcast(m), ["src_type", "relation", "dst_type"])
    x = x.withColumn("cells", F.filter("cells", lambda c: c["i"] < F.size("p")))
    total = lambda j: F.aggregate(F.filter("cells", lambda c: c["j"] == j), F.lit(0.0), lambda s, c: s + F.get("p", c["i"]) * c["w"])
    sent = F.transform(F.array_distinct(F.transform("cells", lambda c: c["j"])), lambda j: F.struct(j.alias("j"), (times * total(j)).alias("delta")))
    return x.select("case_id", "src_type", "src_id", "relation", "dst_type", "dst_id", F.inline(sent))


def gate_factors(nodes: DataFrame, gates: DataFrame, edges: DataFrame) -> DataFrame:
    """case_id, node_type, node_id, gate: 1 - sigmoid(sum p * u) of exception clusters; gates(exc_type, dst_type, i, u).

    A destination takes the mean over the exception nodes it has a role edge to, else those of its own entity, else all of its case.
    """
    p = nodes.select("case_id", F.col("node_type").alias("exc_type"), F.col("node_id").alias("exc_id"), F.posexplode(softmax(F.col("logits"))).alias("i", "p"))
    score = p.join(F.broadcast(gates), ["exc_type", "i"]).groupBy("case_id", "exc_type", "exc_id", "dst_type").agg(sigmoid(F.sum(F.col("p") * F.col("u"))).alias("s"))
    dst = nodes.select("case_id", F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_id"))
    by_role = edges.where("relation = 'role_of'").select("case_id", F.col("src_type").alias("dst_type"), F.col("src_id").alias("dst_id"), F.col("dst_type").alias("exc_type"), F.col("dst_id").alias("exc_id")).join(score, ["case_id", "exc_type", "exc_id", "dst_type"]).groupBy("case_id", "dst_type", "dst_id").agg(F.avg("s").alias("by_role"))
    own = score.select("case_id", "dst_type", F.col("exc_id").alias("dst_id"), "s").groupBy("case_id", "dst_type", "dst_id").agg(F.avg("s").alias("own"))
    every = score.groupBy("case_id", "dst_type").agg(F.avg("s").alias("every"))
    keys = ["case_id", "dst_type", "dst_id"]
    x = dst.join(by_role, keys, "left").join(own, keys, "left").join(every, ["case_id", "dst_type"], "left")
    return x.select("case_id", F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), (1 - F.coalesce("by_role", "own", "every", F.lit(0.0))).alias("gate"))


def step(nodes: DataFrame, messages: DataFrame, bias: DataFrame | None = None, gates: DataFrame | None = None) -> DataFrame:
    """One update: summed messages, times the gate, plus the type's bias for types that got any message in the case.
    Frozen nodes keep their logits and still send. bias(node_type, j, b)."""
    delta = messages.groupBy("case_id", F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), "j").agg(F.sum("delta").alias("d"))
    if gates is not None:
        delta = delta.join(gates, NODE, "left").withColumn("d", F.col("d") * F.coalesce("gate", F.lit(1.0))).drop("gate")
    if bias is not None:
        touched = delta.select("case_id", "node_type").distinct()
        b = nodes.select(*NODE).join(touched, ["case_id", "node_type"], "left_semi").join(bias, "node_type").select(*NODE, "j", F.col("b").alias("d"))
        delta = delta.unionByName(b).groupBy(*NODE, "j").agg(F.sum("d").alias("d"))
    packed = delta.groupBy(*NODE).agg(F.map_from_entries(F.collect_list(F.struct("j", "d"))).alias("m"))
    x = nodes.join(packed, NODE, "left")
    moved = F.transform("logits", lambda v, k: v + F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return x.withColumn("logits", F.when(F.col("frozen") | F.col("m").isNull(), F.col("logits")).otherwise(moved)).select(*nodes.columns)


def influences(messages: DataFrame, number: int) -> DataFrame:
    """Trace entries of one step: every edge into a fact with its change per truth value and its magnitude."""
    d = messages.where("dst_type = 'fact'").groupBy("case_id", F.col("dst_id").alias("fact_id"), "src_type", "src_id", "relation").agg(*(F.sum(F.when(F.col("j") == k, F.col("delta")).otherwise(0.0)).alias(f"delta_{x.lower()}") for k, x in enumerate(TRUTH)))
    source = F.concat(F.regexp_replace("src_type", "^c_", ""), F.lit(":"), F.col("src_id").cast("string"))
    magnitude = F.sqrt(F.col("delta_t") ** 2 + F.col("delta_f") ** 2 + F.col("delta_u") ** 2)
    return d.select("case_id", "fact_id", source.alias("source_id"), "relation", F.lit(number).alias("step"), "delta_t", "delta_f", "delta_u", magnitude.alias("magnitude"))


def propagate(nodes: DataFrame, edges: DataFrame, weights: DataFrame, steps: int = 5, bias: DataFrame | None = None, gate_weights: DataFrame | None = None, top_k: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Nodes after `steps` updates and, if top_k is given, the top_k influences on each fact over all steps.

    Edges, where several steps read them, and each step's nodes are written to the shared folder, so lineage stays short and a lost
    executor costs one step. Influences are measured after a step's update.
    """
    trace = None
    edges = durable(edges, "edges") if steps > 1 else edges
    for k in range(steps):
        gates = gate_factors(nodes, gate_weights, edges) if gate_weights is not None else None
        nodes = durable(step(nodes, edge_messages(nodes, edges, weights), bias, gates), "beliefs")
        if top_k:
            part = influences(edge_messages(nodes, edges, weights), k)
            trace = part if trace is None else trace.unionByName(part)
    if trace is not None:
        order = Window.partitionBy("case_id", "fact_id").orderBy(F.desc("magnitude"), "step", "source_id", "relation")
        trace = trace.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
    return nodes, trace


def decoded_facts(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """value, confidence and probabilities of every fact; candidates but for kept statuses."""
    p = nodes.where("node_type = 'fact'").select("case_id", F.col("node_id").alias("fact_id"), softmax(F.col("logits")).alias("p"), argmax_value(F.col("logits"), F.array(*map(F.lit, TRUTH))).alias("value"))
    status = F.when(F.col("status").isin("observed", "proved", "rejected", "retracted"), F.col("status")).otherwise("candidate")
    return facts.select("case_id", "fact_id", "status").join(p, ["case_id", "fact_id"]).select("case_id", "fact_id", status.alias("status"), "value", F.array_max("p").alias("confidence"), F.map_from_arrays(F.array(*map(F.lit, TRUTH)), "p").alias("probabilities"))


def decoded_states(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Logits back to states; clamp flags stay, a missing source is `manual`."""
    x = nodes.where("node_type <> 'fact'").select("case_id", F.regexp_replace("node_type", "^c_", "").alias("cluster"), F.col("node_id").alias("entity_id"), "logits", "frozen")
    s = states.select("case_id", "cluster", "entity_id", "is_clamped", "clamp_source")
    return x.join(s, ["case_id", "cluster", "entity_id"], "left").select("case_id", "cluster", "entity_id", "logits", F.coalesce("is_clamped", "frozen").alias("is_clamped"), F.coalesce("clamp_source", F.lit("manual")).alias("clamp_source"))
