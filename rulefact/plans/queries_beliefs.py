"""Queries of belief propagation (K), candidates (L) and learning (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulefact.functions.scalars import softmax
from rulefact.operators import beliefs as B
from rulefact.operators import candidates as L
from rulefact.operators import learning as M
from rulefact.operators.training import train
from rulefact.plans import rules as R
from rulefact.plans import world as W
from rulefact.plans.registry import Tables, query

DOMAIN = ["low", "mid", "high"]

#: Nodes, edges and weights in SQL: tiers of customers (a third has a state, a ninth is clamped) and facts of orders.
_SQL = """WITH cl AS (SELECT c_nationkey AS case_id, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN [c_acctbal / 1000, (c_custkey % 7) - 3.0, (c_custkey % 11) / 2.0] ELSE [0.0, 0.0, 0.0] END AS l0, c_custkey % 9 = 0 AS frozen FROM customer),
c AS (SELECT case_id, id, frozen, CASE WHEN frozen THEN list_transform([1, 2, 3], lambda k: CASE WHEN k = list_position(l0, list_max(l0)) THEN 10.0 ELSE -10.0 END) ELSE l0 END AS l FROM cl),
f AS (SELECT c_nationkey AS case_id, o_orderkey AS id, o_custkey AS cust, o_orderstatus <> 'O' AS frozen, CASE o_orderstatus WHEN 'F' THEN [10.0, -10.0, -10.0] WHEN 'P' THEN [-10.0, 10.0, -10.0] ELSE [0.0, 0.0, 0.0] END AS l FROM orders JOIN customer ON o_custkey = c_custkey),
w(i, j, w) AS (VALUES (1, 1, 0.9), (1, 3, 0.2), (2, 2, 0.5), (3, 1, 0.1 - ln(1 + exp(-1.0)))),
r(i, j, w) AS (VALUES (1, 1, 0.3), (3, 1, 0.6), (3, 2, 0.25)),
fp AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM f),
fi AS (SELECT case_id, id, cust, unnest([1, 2, 3]) AS i, unnest(list_transform(e, lambda v: v / list_sum(e))) AS p FROM fp),
md AS (SELECT case_id, cust AS id, j, sum(p * w) AS d FROM fi JOIN w USING (i) GROUP BY ALL),
c1 AS (SELECT case_id, id, frozen, CASE WHEN frozen OR n = 0 THEN l ELSE [l[1] + d1, l[2] + d2, l[3] + d3] END AS l FROM c
JOIN (SELECT c.case_id, c.id, count(d) AS n, coalesce(sum(d) FILTER (j = 1), 0) AS d1, coalesce(sum(d) FILTER (j = 2), 0) AS d2, coalesce(sum(d) FILTER (j = 3), 0) AS d3 FROM c LEFT JOIN md USING (case_id, id) GROUP BY ALL) USING (case_id, id))
"""


def _logits():
    return F.array(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 7) - 3.0, (F.col("c_custkey") % 11) / 2.0)


def _schemas(t: Tables):
    return t.spark.createDataFrame([("tier", "CUSTOMER", DOMAIN)], "cluster string, entity_type string, domain array<string>")


def _states(t: Tables):
    c = F.col("c_custkey")
    return t.customer.where(c % 3 == 0).select(F.col("c_nationkey").alias("case_id"), F.lit("tier").alias("cluster"), c.alias("entity_id"), _logits().alias("logits"), (c % 9 == 0).alias("is_clamped"), (c % 9 == 0).alias("clamp_hard"), F.when(c % 9 == 0, "text").alias("clamp_source"))


def _clusters(t: Tables):
    entities = t.customer.select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("entity_id"), F.lit("CUSTOMER").alias("entity_type"))
    return B.cluster_nodes(entities, _states(t), _schemas(t))


def _facts(t: Tables):
    o = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    s = F.col("o_orderstatus")
    return o.select(F.col("c_nationkey").alias("case_id"), F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("entity_id"), F.when(s == "F", "T").when(s == "P", "F").alias("value"), F.lit(None).cast("array<double>").alias("logits"), F.when(s == "F", "observed").otherwise("candidate").alias("status"))


def _fact_nodes(t: Tables):
    return B.fact_nodes(_facts(t))


def _args(t: Tables):
    return _facts(t).select("case_id", "fact_id", F.lit("ORDER_PLACED").alias("predicate"), F.lit("CUSTOMER").alias("role"), "entity_id")


def _graph(t: Tables):
    nodes = _clusters(t).unionByName(_fact_nodes(t))
    rules = t.spark.createDataFrame([("ORDER_PLACED", "CUSTOMER", "tier")], "predicate string, role string, cluster string")
    edges = B.support_edges(rules, _args(t))
    rel = ("fact", "supports:order_placed:CUSTOMER", "c_tier")
    weights = t.spark.createDataFrame([(*rel, 0, 0, 0.9, None), (*rel, 0, 2, 0.2, None), (*rel, 1, 1, 0.5, None), (*rel, 2, 0, 0.1, -1.0)], "src_type string, relation string, dst_type string, i int, j int, w_pos double, w_neg_raw double")
    return nodes, edges, weights


def _three(c: str = "logits"):
    return [F.round(F.get(c, F.lit(k)), 6).alias(f"l{k}") for k in range(3)]


_L3 = "round(l[1], 6) AS l0, round(l[2], 6) AS l1, round(l[3], 6) AS l2"


@query(_SQL + f"SELECT case_id, id AS node_id, frozen, {_L3} FROM c")
def k1_cluster_nodes(t: Tables):
    return _clusters(t).select("case_id", "node_id", "frozen", *_three())


@query(_SQL + f"SELECT case_id, id AS node_id, frozen, {_L3} FROM f")
def k2_fact_nodes(t: Tables):
    return B.fact_nodes(_facts(t)).select("case_id", "node_id", "frozen", *_three())


@query("SELECT c_nationkey AS case_id, o_orderkey AS src_id, 'c_tier' AS dst_type, o_custkey AS dst_id, 2 AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def k3_role_edges(t: Tables):
    twice = _args(t).unionByName(_args(t).withColumn("role", F.lit("PAYER")))
    e = B.role_edges(twice, _clusters(t))
    return e.groupBy("case_id", "src_id", "dst_type", "dst_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS case_id, c_custkey AS src_id, 'c_tier' AS src_type, 'c_risk' AS dst_type FROM customer WHERE c_custkey % 2 = 0")
def k4_implication_edges(t: Tables):
    nodes = _clusters(t).select("case_id", "node_type", "node_id")
    both = nodes.unionByName(nodes.where("node_id % 2 = 0").withColumn("node_type", F.lit("c_risk")))
    pairs = t.spark.createDataFrame([("c_tier", "c_risk"), ("c_tier", "c_risk"), ("c_none", "c_risk")], "src_type string, dst_type string")
    return B.implication_edges(pairs, both).select("case_id", "src_id", "src_type", "dst_type")


@query("SELECT DISTINCT c_nationkey AS case_id, o_orderkey AS src_id, 'supports:order_placed:CUSTOMER' AS relation, o_custkey AS dst_id FROM orders JOIN customer ON o_custkey = c_custkey")
def k5_support_edges(t: Tables):
    return _graph(t)[1].select("case_id", "src_id", "relation", "dst_id")


@query("""WITH l AS (SELECT c_custkey, [c_acctbal / 1000, (c_custkey % 7) - 3.0, (c_custkey % 11) / 2.0] AS l FROM customer), p AS (SELECT *, list_position(l, list_max(l)) AS k FROM l)
SELECT c_custkey, round(CASE c_custkey % 3 WHEN 0 THEN CASE WHEN k = 1 THEN 10 ELSE -10 END WHEN 1 THEN l[1] + CASE WHEN k = 1 THEN 3 ELSE 0 END ELSE l[1] END, 6) AS l0 FROM p""")
def k7_clamp(t: Tables):
    mode = F.when(F.col("c_custkey") % 3 == 0, "hard").when(F.col("c_custkey") % 3 == 1, "soft").otherwise("none")
    return t.customer.select("c_custkey", F.round(F.get(B.clamped(_logits(), mode), F.lit(0)), 6).alias("l0"))


@query(_SQL + "SELECT case_id, id AS node_id, round(l[2] + CASE WHEN NOT frozen AND id % 4 = 0 THEN 3 * 0.5 ELSE 0 END, 6) AS l1 FROM c")
def k8_memory_bias(t: Tables):
    slots = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity_id"), F.lit("tier").alias("slot_name"), F.when(F.col("c_custkey") % 4 == 0, "mid").otherwise("unheard").alias("value"), F.lit(0.5).alias("confidence"))
    return B.with_memory(_clusters(t), slots, _schemas(t)).select("case_id", "node_id", F.round(F.get("logits", F.lit(1)), 6).alias("l1"))


@query(_SQL + f"SELECT case_id, id AS node_id, {_L3} FROM c1")
def k9_one_step(t: Tables):
    nodes, edges, weights = _graph(t)
    return B.step(nodes, B.edge_messages(nodes, edges, weights)).where("node_type = 'c_tier'").select("case_id", "node_id", *_three())


@query(_SQL + f""", back AS (SELECT f.case_id, f.id, f.frozen, f.l AS fl, c.l AS cl FROM f JOIN c1 c ON c.case_id = f.case_id AND c.id = f.cust),
pb AS (SELECT *, list_transform(cl, lambda v: exp(v - list_max(cl))) AS e FROM back),
g AS (SELECT case_id, id, frozen, fl, list_transform(e, lambda v: v / list_sum(e)) AS p FROM pb),
l2 AS (SELECT case_id, id, CASE WHEN frozen THEN fl ELSE [fl[1] + p[1] * 0.3 + p[3] * 0.6, fl[2] + p[3] * 0.25, fl[3]] END AS l FROM g)
SELECT case_id, id AS node_id, {_L3} FROM l2""")
def k10_two_steps(t: Tables):
    """Facts move tiers in the first step, tiers move facts in the second."""
    nodes, edges, weights = _graph(t)
    back = edges.select("case_id", F.col("dst_type").alias("src_type"), F.col("dst_id").alias("src_id"), F.lit("role_of").alias("relation"), F.col("src_type").alias("dst_type"), F.col("src_id").alias("dst_id"))
    rel = ("c_tier", "role_of", "fact")
    w = t.spark.createDataFrame([(*rel, 0, 0, 0.3, None), (*rel, 2, 0, 0.6, None), (*rel, 2, 1, 0.25, None)], weights.schema)
    nodes, _ = B.propagate(nodes, edges, weights, steps=1)
    nodes, _ = B.propagate(nodes, back, w, steps=1)
    return nodes.where("node_type = 'fact'").select("case_id", "node_id", *_three())


@query(_SQL + f""", far AS (SELECT c.case_id, 'c_tier' AS node_type, c.id, list_transform(range(1, 4), lambda k: c.l[k] + 5 * (c1.l[k] - c.l[k])) AS l FROM c JOIN c1 ON c1.case_id = c.case_id AND c1.id = c.id UNION ALL SELECT case_id, 'fact', id, l FROM f)
SELECT case_id, node_type, id AS node_id, {_L3} FROM far""")
def k10_five_steps(t: Tables):
    """No message reaches a fact, so each of the five steps moves a tier by the same amount."""
    nodes, edges, weights = _graph(t)
    return B.propagate(nodes, edges, weights, steps=5)[0].select("case_id", "node_type", "node_id", *_three())


@query(_SQL + """, s AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM c), x AS (SELECT case_id, id, 1 / (1 + exp(-(1.5 * e[1] + 0.5 * e[3]) / list_sum(e))) AS s FROM s)
SELECT f.case_id, f.id AS node_id, round(1 - x.s, 6) AS gate FROM f JOIN x ON x.case_id = f.case_id AND x.id = f.cust""")
def k12_gates(t: Tables):
    nodes, _, _ = _graph(t)
    gates = t.spark.createDataFrame([("c_tier", "fact", 0, 1.5), ("c_tier", "fact", 2, 0.5)], "exc_type string, dst_type string, i int, u double")
    return B.gate_factors(nodes, gates, B.role_edges(_args(t), _clusters(t))).where("node_type = 'fact'").select("case_id", "node_id", F.round("gate", 6).alias("gate"))


@query("SELECT 'c_' || lower(p_brand) AS src_type, p_size % 3 AS i, p_size % 2 AS j, max(p_retailprice) AS w_pos FROM part GROUP BY ALL")
def k13_rule_weights(t: Tables):
    rules = t.part.select(F.concat(F.lit("c_"), F.lower("p_brand")).alias("src_type"), F.lit("implies").alias("relation"), F.lit("c_size").alias("dst_type"), (F.col("p_size") % 3).alias("i"), (F.col("p_size") % 2).alias("j"), F.col("p_retailprice").alias("weight"))
    return B.rule_weights(rules).select("src_type", "i", "j", "w_pos")


@query("SELECT DISTINCT 'c_' || lower(c_mktsegment) AS src_type, 'implies' AS relation, 'c_' || lower(o_orderpriority) AS dst_type FROM orders JOIN customer ON o_custkey = c_custkey")
def k14_edge_types(t: Tables):
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return x.select(F.concat(F.lit("c_"), F.lower("c_mktsegment")).alias("src_type"), F.lit("implies").alias("relation"), F.concat(F.lit("c_"), F.lower("o_orderpriority")).alias("dst_type")).distinct()


@query(_SQL + """, s AS (SELECT f.case_id, f.id AS fact_id, c.id AS cust, c.l, list_transform(c.l, lambda v: exp(v - list_max(c.l))) AS e FROM f JOIN c ON c.case_id = f.case_id AND c.id = f.cust)
SELECT case_id, fact_id, 'tier:' || cust AS source_id, round((e[1] * 0.3 + e[3] * 0.6) / list_sum(e), 6) AS delta_t, round(e[3] * 0.25 / list_sum(e), 6) AS delta_f FROM s""")
def k15_influences(t: Tables):
    nodes, edges, weights = _graph(t)
    back = edges.select("case_id", F.col("dst_type").alias("src_type"), F.col("dst_id").alias("src_id"), F.lit("role_of").alias("relation"), F.col("src_type").alias("dst_type"), F.col("src_id").alias("dst_id"))
    rel = ("c_tier", "role_of", "fact")
    w = t.spark.createDataFrame([(*rel, 0, 0, 0.3, None), (*rel, 2, 0, 0.6, None), (*rel, 2, 1, 0.25, None)], weights.schema)
    return B.influences(B.edge_messages(nodes, back, w), 0).select("case_id", "fact_id", "source_id", F.round("delta_t", 6).alias("delta_t"), F.round("delta_f", 6).alias("delta_f"))


@query(_SQL + """, e AS (SELECT f.*, list_transform(f.l, lambda v: exp(v - list_max(f.l))) AS e FROM f)
SELECT e.case_id, id AS fact_id, CASE WHEN o_orderstatus = 'F' THEN 'observed' ELSE 'candidate' END AS status, ['T', 'F', 'U'][list_position(l, list_max(l))] AS value, round(list_max(e) / list_sum(e), 6) AS confidence FROM e JOIN orders ON o_orderkey = id""")
def k16_decode_facts(t: Tables):
    return B.decoded_facts(_graph(t)[0], _facts(t)).select("case_id", "fact_id", "status", "value", F.round("confidence", 6).alias("confidence"))


@query(_SQL + "SELECT case_id, id AS entity_id, 'tier' AS cluster, frozen AS is_clamped, CASE WHEN frozen THEN 'text' ELSE 'manual' END AS clamp_source FROM c")
def k17_decode_states(t: Tables):
    return B.decoded_states(_graph(t)[0], _states(t)).select("case_id", "entity_id", "cluster", "is_clamped", "clamp_source")


# Group L


@query(_SQL + """, e AS (SELECT c.*, l0, list_transform(l0, lambda v: exp(v - list_max(l0))) AS e FROM c JOIN cl USING (case_id, id))
SELECT case_id, 'tier(ENTITY=' || id || ',VALUE=' || ['low', 'mid', 'high'][list_position(l0, list_max(l0))] || ')' AS atom, round(list_max(e) / list_sum(e), 6) AS confidence FROM e WHERE id % 3 = 0 AND NOT frozen AND list_max(e) / list_sum(e) >= 0.7 AND id % 5 <> 0""")
def l1_cluster_candidates(t: Tables):
    states = _states(t).withColumn("domain", F.array(*map(F.lit, DOMAIN)))
    present = L.from_clusters(states.where("entity_id % 5 = 0"), t.spark.createDataFrame([], "case_id int, atom string"), 0.0)
    return L.from_clusters(states, present).select("case_id", "atom", F.round("confidence", 6).alias("confidence"))


@query(W.SQL + """, g AS (SELECT case_id, ord, least(1 - (ord % 5) / 10, 1 - (part % 4) / 10) AS c FROM lateb)
SELECT case_id, 'late_return(CUSTOMER=' || case_id || ',ORDER=' || ord || ')' AS atom, round(max(c), 6) AS confidence FROM g GROUP BY ALL HAVING max(c) >= 0.7""")
def l2_rule_candidates(t: Tables):
    f = W.frames(t)
    f["order_placed"] = f["order_placed"].withColumn("confidence", 1 - (F.col("ORDER") % 5) / 10)
    f["line_returned"] = f["line_returned"].withColumn("confidence", 1 - (F.col("PART") % 4) / 10)
    none = f["order_open"].limit(0).select("case_id", F.lit("").alias("atom"))
    return L.from_rules([W.LATE], f, none).select("case_id", "atom", F.round("confidence", 6).alias("confidence"))


@query(W.SQL + "SELECT case_id, 'late_return(CUSTOMER=' || case_id || ',ORDER=' || ord || ')' AS atom, count(DISTINCT part) AS n_items FROM lateb WHERE ord NOT IN (SELECT ord FROM oo) GROUP BY ALL")
def l3_evidence(t: Tables):
    f = W.frames(t)
    body = R.without_violations(W.LATE, R.body_frame(W.LATE, f), f)
    atom = F.concat(F.lit("late_return(CUSTOMER="), F.col("v_C").cast("string"), F.lit(",ORDER="), F.col("v_O").cast("string"), F.lit(")"))
    supports = body.select("case_id", atom.alias("atom"), F.col("v_P").cast("string").alias("item"), F.lit("fact").alias("kind"), F.lit(1.0).alias("confidence"))
    return L.evidence(supports.select("case_id", "atom").distinct(), supports).select("case_id", "atom", F.size("evidence").cast("long").alias("n_items"))


# Group M


@query("SELECT c_nationkey AS case_id, greatest(1, CAST(floor(count(*) * 0.15) AS BIGINT)) AS n_masked FROM customer WHERE c_custkey % 9 = 0 GROUP BY 1")
def m1_masked_nodes(t: Tables):
    return M.masked(_clusters(t)).where("masked").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_masked"))


_LOSS = _SQL + ", e AS (SELECT cl.*, list_transform(l0, lambda v: exp(v - list_max(l0))) AS e FROM cl) "


@query(_LOSS + "SELECT round(sum(0.5 * -ln(greatest(e[id % 3 + 1] / list_sum(e), 1e-9))) / sum(0.5), 6) AS loss, count(*) AS n FROM e WHERE id % 4 <> 0")
def m2_masked_loss(t: Tables):
    c = F.col("c_custkey")
    logits = F.when(c % 3 == 0, _logits()).otherwise(F.array(*[F.lit(0.0)] * 3))
    rows = t.customer.select(logits.alias("logits"), F.when(c % 4 == 0, -1).otherwise(c % 3).alias("target"), F.lit(0.5).alias("weight"))
    return M.weighted_loss(rows).select(F.round("loss", 6).alias("loss"), "n")


@query(_LOSS + ", p AS (SELECT case_id, id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e WHERE id % 3 = 0) SELECT 'implies' AS kind, round(avg(greatest(p[1] - p[3], 0)), 6) AS penalty, count(*) AS n FROM p UNION ALL SELECT 'excludes', round(avg(p[1] * p[2]), 6), count(*) FROM p")
def m4_pair_penalties(t: Tables):
    s = _states(t).select("case_id", "entity_id", "cluster", "logits")
    both = s.unionByName(s.withColumn("cluster", F.lit("twin")))
    pairs = t.spark.createDataFrame([("implies", "tier", 0, "twin", 2), ("excludes", "tier", 0, "twin", 1)], "kind string, cluster_a string, i int, cluster_b string, j int")
    return M.pair_penalties(both, pairs).select("kind", F.round("penalty", 6).alias("penalty"), "n")


@query(_LOSS + ", h AS (SELECT 1 AS k, -list_sum(list_transform(e, lambda v: v / list_sum(e) * ln(greatest(v / list_sum(e), 1e-9)))) AS h FROM e WHERE NOT frozen), u AS (SELECT ln(3) AS h WHERE (SELECT count(*) FROM f WHERE NOT frozen) > 0) SELECT round(((SELECT avg(h) FROM h) + (SELECT h FROM u)) / 2, 6) AS entropy")
def m5_free_entropy(t: Tables):
    return M.free_entropy(_graph(t)[0]).select(F.round("entropy", 6).alias("entropy"))


@query(_SQL + """, x AS (SELECT f.id, CASE WHEN f.id % 3 = 0 THEN 2 ELSE 1 END AS k, CASE WHEN f.id % 3 = 0 THEN 1.0 ELSE 0.8 END AS w, list_transform(f.l, lambda v: exp(v - list_max(f.l))) AS e FROM f WHERE f.id % 3 < 2)
SELECT round(sum(w * -ln(greatest(e[k] / list_sum(e), 1e-9))) / sum(w), 6) AS loss, count(*) AS n FROM x""")
def m6_feedback_loss(t: Tables):
    verdicts = _facts(t).select("case_id", "fact_id", F.when(F.col("fact_id") % 3 == 0, "blocked").when(F.col("fact_id") % 3 == 1, "proved").otherwise("unknown").alias("outcome"))
    return M.weighted_loss(M.feedback_rows(_graph(t)[0], verdicts)).select(F.round("loss", 6).alias("loss"), "n")


@query("WITH c AS (SELECT l_linenumber AS epoch, l_suppkey AS case_id, sum(l_discount * 1.0) + sum(l_tax * 0.1) AS loss FROM lineitem GROUP BY ALL) SELECT epoch, round(avg(loss), 6) AS loss FROM c GROUP BY 1")
def m7_total_loss(t: Tables):
    x = t.lineitem.select(F.col("l_linenumber").alias("epoch"), F.col("l_suppkey").alias("case_id"), F.explode(F.create_map(F.lit("masked"), F.col("l_discount"), F.lit("entropy"), F.col("l_tax"))).alias("component", "value"))
    return M.total_loss(x, {"masked": 1.0, "entropy": 0.1}).select("epoch", F.round("loss", 6).alias("loss"))


_PAIRS = """WITH p AS (SELECT c_mktsegment AS i, o_orderpriority AS j FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT i, j, count(*) AS n FROM p GROUP BY ALL),
ni AS (SELECT i, sum(n) AS ni FROM n GROUP BY 1), nj AS (SELECT j, sum(n) AS nj FROM n GROUP BY 1), a AS (SELECT sum(n) AS a, count(DISTINCT j) AS v FROM n),
w AS (SELECT i, j, greatest(ln(((n + 1) / (ni + v)) / ((nj + 1) / (a + v))), 0) AS w FROM n JOIN ni USING (i) JOIN nj USING (j) CROSS JOIN a)"""


def _learned(t: Tables):
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    pairs = x.select(F.lit("c_segment").alias("src_type"), F.lit("implies").alias("relation"), F.lit("c_priority").alias("dst_type"), F.col("c_mktsegment").alias("i"), F.col("o_orderpriority").alias("j"))
    return M.cooccurrence_weights(pairs)


@query(_PAIRS + " SELECT i, j, round(w, 6) AS weight FROM w")
def m8_learned_weights(t: Tables):
    return _learned(t).select("i", "j", F.round("weight", 6).alias("weight"))


_ORDER_TIERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _trained(t: Tables):
    """Priorities of orders from the segments of their customers; nations divisible by 5 are held out."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    nation = F.col("c_nationkey").alias("case_id")
    at = lambda c, values: (F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1).cast("int")
    segments = t.customer.select(nation, F.lit("c_segment").alias("node_type"), F.col("c_custkey").alias("node_id"), B.hard(F.lit(5), at("c_mktsegment", _SEGMENTS)).alias("logits"), F.lit(True).alias("frozen"))
    orders = o.select(nation, F.lit("c_priority").alias("node_type"), F.col("o_orderkey").alias("node_id"), F.array(*[F.lit(0.0)] * 5).alias("logits"), F.lit(False).alias("frozen"))
    edges = o.select(nation, F.lit("c_segment").alias("src_type"), F.col("o_custkey").alias("src_id"), F.lit("implies").alias("relation"), F.lit("c_priority").alias("dst_type"), F.col("o_orderkey").alias("dst_id"))
    targets = o.select(nation, F.lit("c_priority").alias("node_type"), F.col("o_orderkey").alias("node_id"), F.lit("masked").alias("component"), at("o_orderpriority", _ORDER_TIERS).alias("target"), F.lit(1.0).alias("weight"))
    start = t.spark.createDataFrame([("c_segment", "implies", "c_priority", i, j, 0.0) for i in range(5) for j in range(5)], "src_type string, relation string, dst_type string, i int, j int, weight double")
    return train(segments.unionByName(orders), edges, start, targets, {"masked": 1.0}, F.col("case_id") % 5 == 0, epochs=8)


@query(f"""WITH x AS (SELECT c_mktsegment AS i, o_orderpriority AS j, 1.0 / count(*) OVER (PARTITION BY c_nationkey) AS share FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 0)
SELECT i AS segment, j AS priority, round(sum(share) / sum(sum(share)) OVER (PARTITION BY i), 6) AS p, TRUE AS learned FROM x GROUP BY i, j""")
def m8_trained_weights(t: Tables):
    """The least training loss gives each segment the frequencies of its priorities (every nation counting alike): p, and whether
    the trained weights say it to 0.01."""
    w = _trained(t).last.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "weight"))).alias("w")).select(F.get(F.array(*map(F.lit, _SEGMENTS)), F.col("i")).alias("segment"), F.posexplode(softmax(F.transform("w", lambda x: x["weight"]))).alias("j", "says"))
    w = w.select("segment", F.get(F.array(*map(F.lit, _ORDER_TIERS)), F.col("j")).alias("priority"), "says")
    o = t.orders.join(t.customer.where("c_nationkey % 5 <> 0"), F.col("o_custkey") == F.col("c_custkey"))
    share = o.groupBy("c_nationkey").agg((1 / F.count(F.lit(1))).alias("share"))
    x = o.groupBy("c_nationkey", F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n")).join(share, "c_nationkey").groupBy("segment", "priority").agg(F.sum(F.col("n") * F.col("share")).alias("share"))
    whole = x.groupBy("segment").agg(F.sum("share").alias("whole"))
    p = F.col("share") / F.col("whole")
    return x.join(whole, "segment").join(w, ["segment", "priority"], "left").select("segment", "priority", F.round(p, 6).alias("p"), F.coalesce(F.abs(p - F.col("says")) < 0.01, F.lit(False)).alias("learned"))


@query()
def m8_training_history(t: Tables):
    """Training and held-out loss after each step of the same run; iterative, so without SQL: held against NumPy in the tests."""
    return _trained(t).history.select("epoch", F.round("train", 6).alias("train"), F.round("held_out", 6).alias("held_out"))


@query(_PAIRS + " SELECT 'priority(E,' || lower(j) || ')' AS head, 'segment(E,' || lower(i) || ')' AS body, round(w, 6) AS weight FROM w WHERE w >= 0.001 QUALIFY row_number() OVER (PARTITION BY i ORDER BY w DESC, j) <= 1")
def m9_cluster_rules(t: Tables):
    segments = t.customer.select(F.lit("c_segment").alias("node_type"), F.col("c_mktsegment").alias("position"), F.col("c_mktsegment").alias("value")).distinct()
    priorities = t.orders.select(F.lit("c_priority").alias("node_type"), F.col("o_orderpriority").alias("position"), F.col("o_orderpriority").alias("value")).distinct()
    return M.extracted_rules(_learned(t), segments.unionByName(priorities), 1, 0.001).select("head", "body", F.round("weight", 6).alias("weight"))


@query("WITH w AS (SELECT o_orderpriority AS j, avg(o_totalprice) AS w FROM orders GROUP BY 1) SELECT 'priority(E,' || lower(j) || ')' AS head, 'ordered_by(CUSTOMER=E)' AS body FROM w QUALIFY row_number() OVER (ORDER BY w DESC, j) <= 2")
def m10_fact_rules(t: Tables):
    w = t.orders.groupBy(F.col("o_orderpriority").alias("value")).agg(F.avg("o_totalprice").alias("weight"))
    w = w.select(F.lit("fact").alias("src_type"), F.lit("supports:ordered_by:CUSTOMER").alias("relation"), F.lit("c_priority").alias("dst_type"), F.lit("0").alias("i"), F.col("value").alias("j"), "weight")
    d = t.orders.select(F.lit("c_priority").alias("node_type"), F.col("o_orderpriority").alias("position"), F.col("o_orderpriority").alias("value")).distinct()
    return M.extracted_rules(w, d, 2, 0.0).select("head", "body")


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50)")
def m11_rules_with_edges(t: Tables):
    rules = t.part.select("p_partkey", F.col("p_brand").alias("src_type"), F.lit("implies").alias("relation"), F.lit("c_x").alias("dst_type"))
    edges = t.part.join(t.lineitem.where("l_quantity >= 50"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("src_type"), F.lit("implies").alias("relation"), F.lit("c_x").alias("dst_type"))
    return M.with_edges_only(rules, edges).select("p_partkey")


@query(W.SQL + "SELECT 'r_late' AS rule_id, count(*) AS support, round(avg(CAST(ord IN (SELECT ord FROM late) AS DOUBLE)), 6) AS \"precision\" FROM (SELECT DISTINCT case_id, ord FROM lateb)")
def m12_rule_support(t: Tables):
    f = W.frames(t)
    atom = F.concat(F.lit("late_return(CUSTOMER="), F.col("v_C").cast("string"), F.lit(",ORDER="), F.col("v_O").cast("string"), F.lit(")"))
    bodies = R.body_frame(W.LATE, f).select(F.lit("r_late").alias("rule_id"), "case_id", atom.alias("atom")).distinct()
    return M.support_and_precision(bodies, R.evaluate(f, [W.LATE]).atoms({W.LATE.head.predicate})).select("rule_id", "support", F.round("precision", 6).alias("precision"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE -1 END AS target, CASE WHEN o_orderstatus IN ('F', 'P') THEN 0.5 * (o_orderkey % 10) / 10 ELSE 0 END AS weight FROM orders")
def m13_supervision(t: Tables):
    s = F.col("o_orderstatus")
    facts = t.orders.select("o_orderkey", F.when(s == "F", "proved").when(s == "P", "rejected").otherwise("candidate").alias("status"), F.when(s == "P", "F").otherwise("T").alias("value"), ((F.col("o_orderkey") % 10) / 10).alias("confidence"))
    return M.supervision(facts).select("o_orderkey", "target", "weight")


@query(_SQL + "SELECT case_id, id AS fact_id FROM f WHERE l[1] = 10 OR id % 7 = 0")
def m14_training_facts(t: Tables):
    f = _facts(t)
    return M.training_facts(f.where("fact_id % 7 = 0"), B.fact_nodes(f), 0.9)
