"""Masks, losses, learned weights and the rules read from them, as grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.functions.scalars import entropy, softmax


def masked(nodes: DataFrame, share: float = 0.15, seed: int = 0) -> DataFrame:
    """Marks a share of the clamped nodes of each (case_id, node_type), one at least, by hash; the same rows on every run."""
    group = ["case_id", "node_type"]
    clamped = nodes.where("frozen")
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), F.col("node_id").cast("string")), "node_id"))
    return clamped.withColumn("masked", place <= F.greatest(F.lit(1), F.floor(n * share)))


def cross_entropy(logits: Column, target: Column) -> Column:
    return -F.log(F.greatest(F.get(softmax(logits), target.cast("int")), F.lit(1e-9)))


def weighted_loss(rows: DataFrame) -> DataFrame:
    """Weighted mean of -log p(target) over rows with a target (>= 0); 0 without any."""
    x = rows.where("target >= 0")
    return x.agg(F.coalesce(F.sum(F.col("weight") * cross_entropy(F.col("logits"), F.col("target"))) / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("n"))


def pair_penalties(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind, penalty: mean of max(0, pA - pB) for implications and of pA * pB for incompatibilities, over entities that have both.

    states(case_id, entity_id, cluster, logits); pairs(kind, cluster_a, i, cluster_b, j).
    """
    p = states.select("case_id", "entity_id", "cluster", softmax(F.col("logits")).alias("p"))
    a = p.join(pairs, F.col("cluster") == F.col("cluster_a")).select("case_id", "entity_id", "kind", "cluster_a", "i", "cluster_b", "j", F.get("p", F.col("i")).alias("pa"))
    b = p.select("case_id", "entity_id", F.col("cluster").alias("cluster_b"), F.col("p").alias("q"))
    x = a.join(b, ["case_id", "entity_id", "cluster_b"]).withColumn("pb", F.get("q", F.col("j")))
    value = F.when(F.col("kind") == "implies", F.greatest(F.col("pa") - F.col("pb"), F.lit(0.0))).otherwise(F.col("pa") * F.col("pb"))
    return x.groupBy("kind").agg(F.avg(value).alias("penalty"), F.count(F.lit(1)).alias("n"))


def free_entropy(nodes: DataFrame) -> DataFrame:
    """Mean over types of the mean entropy of free nodes."""
    per_type = nodes.where("NOT frozen").groupBy("node_type").agg(F.avg(entropy(softmax(F.col("logits")))).alias("h"))
    return per_type.agg(F.coalesce(F.avg("h"), F.lit(0.0)).alias("entropy"))


#: Weight and target (position in T, F, U) of a verdict in the feedback loss.
FEEDBACK = {"blocked": (1.0, 1), "proved": (0.8, 0)}


def feedback_rows(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fact nodes with the target and weight their verdict asks for."""
    outcome = F.col("outcome")
    pick = lambda k: F.coalesce(*(F.when(outcome == name, F.lit(v[k])) for name, v in FEEDBACK.items()))
    v = verdicts.where(outcome.isin(*FEEDBACK)).select("case_id", F.col("fact_id").alias("node_id"), pick(0).alias("weight"), pick(1).alias("target"))
    return nodes.where("node_type = 'fact'").join(v, ["case_id", "node_id"])


def total_loss(components: DataFrame, weights: dict[str, float]) -> DataFrame:
    """epoch, loss: mean over cases of the weighted sum of components(epoch, case_id, component, value)."""
    w = F.coalesce(*(F.when(F.col("component") == k, F.lit(v)) for k, v in weights.items()), F.lit(0.0))
    per_case = components.groupBy("epoch", "case_id").agg(F.sum(w * F.col("value")).alias("loss"))
    return per_case.groupBy("epoch").agg(F.avg("loss").alias("loss"))


def cooccurrence_weights(pairs: DataFrame, smooth: float = 1.0) -> DataFrame:
    """src_type, relation, dst_type, i, j, weight: positive log-odds of destination value j given source value i over chance,
    from pairs(src_type, relation, dst_type, i, j) of decided nodes joined by an edge."""
    rel = ["src_type", "relation", "dst_type"]
    n = pairs.groupBy(*rel, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    all_ = n.groupBy(*rel).agg(F.sum("n").alias("all"), F.count_distinct("j").alias("values"))
    by_i, by_j = n.groupBy(*rel, "i").agg(F.sum("n").alias("ni")), n.groupBy(*rel, "j").agg(F.sum("n").alias("nj"))
    x = n.join(by_i, [*rel, "i"]).join(by_j, [*rel, "j"]).join(all_, rel)
    given = (F.col("n") + smooth) / (F.col("ni") + smooth * F.col("values"))
    chance = (F.col("nj") + smooth) / (F.col("all") + smooth * F.col("values"))
    return x.select(*rel, "i", "j", F.greatest(F.log(given / chance), F.lit(0.0)).alias("weight"))


def extracted_rules(weights: DataFrame, domains: DataFrame, k: int = 1, least: float = 0.5) -> DataFrame:
    """rule_id, head and body text of the k strongest destination values per source value, of `least` weight.

    domains(node_type, position, value). Cluster to cluster: dst(E,b) :- src(E,a). Fact to cluster, from T alone, with relation
    supports:<pred>:<ROLE>: dst(E,b) :- pred(ROLE=E).
    """
    w = weights.where(F.col("weight") >= least).where("src_type <> 'fact' OR i = 0")
    order = Window.partitionBy("src_type", "relation", "dst_type", "i").orderBy(F.desc("weight"), "j")
    w = w.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    d = lambda side, at, name: domains.select(F.col("node_type").alias(side), F.col("position").alias(at), F.col("value").alias(name))
    x = w.join(d("dst_type", "j", "b"), ["dst_type", "j"]).join(d("src_type", "i", "a"), ["src_type", "i"], "left")
    name = lambda c: F.regexp_replace(c, "^c_", "")
    head = F.concat(name("dst_type"), F.lit("(E,"), F.lower("b"), F.lit(")"))
    from_fact = F.concat(F.regexp_extract("relation", "^supports:([^:]+):", 1), F.lit("("), F.regexp_extract("relation", ":([^:]+)$", 1), F.lit("=E)"))
    body = F.when(F.col("src_type") == "fact", from_fact).otherwise(F.concat(name("src_type"), F.lit("(E,"), F.lower("a"), F.lit(")")))
    rule_id = F.concat(F.lit("learned_"), F.left(F.sha1(F.concat(head, F.lit(":-"), body)), F.lit(12)))
    return x.select(rule_id.alias("rule_id"), head.alias("head"), body.alias("body"), "src_type", "relation", "dst_type", "i", "j", "weight")


def with_edges_only(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """Rules whose source, relation and destination occur among the edges."""
    return rules.join(edges.select("src_type", "relation", "dst_type").distinct(), ["src_type", "relation", "dst_type"], "left_semi")


def support_and_precision(bodies: DataFrame, heads: DataFrame) -> DataFrame:
    """rule_id, support (body groundings) and precision (share whose head atom holds): bodies(rule_id, case_id, atom)."""
    holds = heads.select("case_id", "atom", F.lit(1.0).alias("holds")).distinct()
    return bodies.join(holds, ["case_id", "atom"], "left").groupBy("rule_id").agg(F.count(F.lit(1)).alias("support"), F.avg(F.coalesce("holds", F.lit(0.0))).alias("precision"))


def supervision(facts: DataFrame, weight: float = 0.5) -> DataFrame:
    """target, weight and unclamped flag of proved (T) and rejected (F) facts; others are not targets (-1)."""
    t = F.when((F.col("status") == "proved") & (F.col("value") == "T"), 0).when((F.col("status") == "rejected") & (F.col("value") == "F"), 1).otherwise(-1)
    x = facts.withColumn("target", t)
    return x.withColumns({"weight": F.when(F.col("target") >= 0, F.lit(weight) * F.coalesce("confidence", F.lit(1.0))).otherwise(F.lit(0.0)), "unclamped": F.col("target") >= 0})


def training_facts(base: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """case_id, fact_id for the verifier during training: base facts, and nodes that are true with p >= least."""
    sure = nodes.where("node_type = 'fact'").where(F.get(softmax(F.col("logits")), F.lit(0)) >= least).select("case_id", F.col("node_id").alias("fact_id"))
    return base.select("case_id", "fact_id").unionByName(sure).distinct()
