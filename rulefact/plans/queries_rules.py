"""Queries of the rule engine (I), its joins (D7-D9, D15) and the temporal operators (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulefact.operators import temporal
from rulefact.plans import loop
from rulefact.plans import rules as R
from rulefact.plans import verdict as V
from rulefact.plans import world as W
from rulefact.plans.registry import Tables, query


@query(W.SQL + "SELECT case_id, ord AS \"order\", count(*) AS n FROM lateb GROUP BY ALL")
def d7_rule_body_join(t: Tables):
    return R.body_frame(W.LATE, W.frames(t)).groupBy("case_id", F.col("v_O").alias("order")).agg(F.count(F.lit(1)).alias("n"))


@query(W.SQL + "SELECT case_id, ord AS \"order\", part FROM lateb WHERE ord NOT IN (SELECT ord FROM oo)")
def d8_naf_anti_join(t: Tables):
    f = W.frames(t)
    return R.without_violations(W.LATE, R.body_frame(W.LATE, f), f).select("case_id", F.col("v_O").alias("order"), F.col("v_P").alias("part"))


@query("""WITH d AS (SELECT DISTINCT s_nationkey AS case_id, CAST(s_suppkey AS VARCHAR) AS v FROM supplier UNION SELECT s_nationkey, CAST(s_nationkey AS VARCHAR) FROM supplier)
SELECT a.case_id, CAST(s.s_suppkey AS VARCHAR) AS a, a.v AS b FROM d a JOIN supplier s ON s.s_nationkey = a.case_id WHERE NOT EXISTS (SELECT 1 FROM supplier x WHERE x.s_nationkey = a.case_id AND CAST(x.s_suppkey AS VARCHAR) = a.v)""")
def d9_domain_join(t: Tables):
    s = t.supplier.select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").cast("string").alias("SUPPLIER"), F.col("s_nationkey").cast("string").alias("NATION"))
    frames = {"sells": s}
    rule = R.Rule("r_other", R.lit("other", A="X", B="Y"), (R.lit("sells", SUPPLIER="X", NATION="_"), R.naf("sells", SUPPLIER="Y", NATION="_")))
    return R.without_violations(rule, R.body_frame(rule, frames), frames).select("case_id", F.col("v_X").alias("a"), F.col("v_Y").alias("b"))


@query("""WITH RECURSIVE r(case_id, t, s) AS (SELECT DISTINCT conv_id, turn, turn - 1 FROM conversations WHERE turn > 0),
a(case_id, t, s) AS (SELECT * FROM r UNION SELECT a.case_id, a.t, r.s FROM a JOIN r ON r.case_id = a.case_id AND r.t = a.s)
SELECT case_id, t AS turn, s AS "to" FROM a""")
def i2_recursive_rules(t: Tables):
    m = R.evaluate(W.reply_frames(t), W.ANCESTOR)
    return m.derived["ancestor"].select("case_id", F.col("TURN").alias("turn"), F.col("TO").alias("to"))


@query(W.SQL + """SELECT 'late_return' AS predicate, case_id, 'late_return(CUSTOMER=' || case_id || ',ORDER=' || ord || ')' AS atom FROM late
UNION ALL SELECT 'suspect', case_id, 'suspect(CUSTOMER=' || case_id || ')' FROM suspect
UNION ALL SELECT 'clean', case_id, 'clean(CUSTOMER=' || case_id || ',ORDER=' || ord || ')' FROM clean""")
def i2_stratified_model(t: Tables):
    return R.evaluate(W.frames(t), W.RULES).atoms().where("proof is not null").select("predicate", "case_id", "atom")



@query("""SELECT DISTINCT o_custkey AS case_id, o_orderkey AS "order" FROM orders WHERE (o_orderstatus IN ('F', 'O') AND o_orderkey % 3 <> 0) OR o_orderstatus = 'P'""")
def i3_base_atoms(t: Tables):
    facts = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("order"), F.when(F.col("o_orderstatus") == "P", "proved").when(F.col("o_orderkey") % 3 == 0, "candidate").otherwise("observed").alias("status"), F.lit("T").alias("value"), F.lit(0.9).alias("confidence"))
    return V.base_facts(facts).select("case_id", "order").distinct()


@query("""WITH l AS (SELECT c_custkey, [c_acctbal / 1000, (c_custkey % 7) - 3.0, (c_custkey % 11) / 2.0] AS l FROM customer)
SELECT c_custkey AS case_id, 'tier(CUSTOMER=' || c_custkey || ',VALUE=' || ['low', 'mid', 'high'][list_position(l, list_max(l))] || ')' AS atom FROM l WHERE list_reverse_sort(l)[1] - list_reverse_sort(l)[2] >= 1.0""")
def i4_cluster_atoms(t: Tables):
    states = t.customer.select(F.col("c_custkey").alias("case_id"), F.col("c_custkey").alias("entity_id"), F.lit("tier").alias("cluster"), F.array(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 7) - 3.0, (F.col("c_custkey") % 11) / 2.0).alias("logits"), F.lit(False).alias("is_clamped"), F.array(F.lit("LOW"), F.lit("Mid"), F.lit("high")).alias("domain"), F.lit("CUSTOMER").alias("entity_role"), F.lit("VALUE").alias("value_role"))
    return V.cluster_atoms(states).select("case_id", "atom")


@query("SELECT o_custkey AS case_id, 'policy(NAME=' || CASE WHEN k = 0 THEN 'returns' ELSE 'refunds' END || ')' AS atom FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN range(2) r(k)")
def i5_unit_clauses(t: Tables):
    f = W.frames(t)
    cases = f["order_placed"].select("case_id").distinct()
    return V.unit_clauses(cases, "policy", [{"NAME": "returns"}, {"NAME": "refunds"}]).select("case_id", "atom")


@query(W.SQL + """, s AS (SELECT case_id, ord, 'C=' || case_id || ',D1=' || d1 || ',D2=' || d2 || ',O=' || ord || ',P=' || part AS sub FROM lateb WHERE ord NOT IN (SELECT ord FROM oo))
SELECT case_id, ord AS "order", 'r_late' AS rule_id, min(sub) AS substitution FROM s GROUP BY case_id, ord""")
def i6_chosen_proof(t: Tables):
    d = R.evaluate(W.frames(t), [W.LATE]).derived["late_return"]
    return d.select("case_id", F.col("ORDER").alias("order"), "proof.rule_id", "proof.substitution")


@query("""WITH q AS (SELECT conv_id AS case_id, max(turn) AS t FROM conversations GROUP BY 1 HAVING max(turn) > 0),
s AS (SELECT case_id, t, k FROM q CROSS JOIN range(1, 10) r(k) WHERE k <= t)
SELECT case_id, 'ancestor(TO=' || (t - k) || ',TURN=' || t || ')' AS atom, t - k AS depth FROM s
UNION ALL SELECT case_id, 'reply_to(TO=' || (t - k) || ',TURN=' || (t - k + 1) || ')', CASE WHEN k = 1 THEN t ELSE t - k + 1 END FROM s""")
def i7_proof_steps(t: Tables):
    m = R.evaluate(W.reply_frames(t), W.ANCESTOR)
    last = t.conversations.groupBy(F.col("conv_id").alias("case_id")).agg(F.max("turn").alias("t")).where("t > 0")
    asked = last.select("case_id", F.concat(F.lit("ancestor(TO=0,TURN="), F.col("t").cast("string"), F.lit(")")).alias("atom"))
    return V.proof_steps(m, asked).select("case_id", "atom", F.col("depth").cast("long").alias("depth"))


@query("""WITH q AS (SELECT conv_id AS case_id, max(turn) AS t FROM conversations GROUP BY 1 HAVING max(turn) > 0) SELECT case_id, 2 * t AS n_steps, t AS n_base FROM q""")
def d15_proof_closure(t: Tables):
    m = R.evaluate(W.reply_frames(t), W.ANCESTOR)
    last = t.conversations.groupBy(F.col("conv_id").alias("case_id")).agg(F.max("turn").alias("t")).where("t > 0")
    asked = last.select("case_id", F.concat(F.lit("ancestor(TO=0,TURN="), F.col("t").cast("string"), F.lit(")")).alias("atom"))
    return V.proof_steps(m, asked).groupBy("case_id").agg(F.max("step").cast("long").alias("n_steps"), F.count_if(F.col("rule_id").isNull()).alias("n_base"))


_CHOSEN = """, s AS (SELECT case_id, ord, d1, d2, part, 'C=' || case_id || ',D1=' || d1 || ',D2=' || d2 || ',O=' || ord || ',P=' || part AS sub FROM lateb WHERE ord NOT IN (SELECT ord FROM oo)),
m AS (SELECT case_id, ord, min(sub) AS sub, arg_min(d1, sub) AS d1, arg_min(d2, sub) AS d2, arg_min(part, sub) AS part, 'late_return(CUSTOMER=' || case_id || ',ORDER=' || ord || ')' AS atom FROM s GROUP BY 1, 2),
w AS (SELECT case_id, arg_min(ord, CAST(ord AS VARCHAR)) AS o, 'suspect(CUSTOMER=' || case_id || ')' AS atom FROM late WHERE ord IN (SELECT ord FROM od) GROUP BY 1)
"""


@query(W.SQL + _CHOSEN + """SELECT case_id, atom, 'r_late' AS rule_id, 'naf' AS kind, 'order_open(ORDER=' || ord || ')' AS depends_on FROM m
UNION ALL SELECT case_id, atom, 'r_late', 'pos', 'order_placed(CUSTOMER=' || case_id || ',DATE=' || d1 || ',ORDER=' || ord || ')' FROM m UNION ALL SELECT case_id, atom, 'r_late', 'pos', 'line_returned(DATE=' || d2 || ',ORDER=' || ord || ',PART=' || part || ')' FROM m
UNION ALL SELECT case_id, atom, 'r_suspect', 'pos', 'late_return(CUSTOMER=' || case_id || ',ORDER=' || o || ')' FROM w UNION ALL SELECT case_id, atom, 'r_suspect', 'pos', 'order_done(ORDER=' || o || ')' FROM w""")
def i8_proof_edges(t: Tables):
    return V.proof_edges(R.evaluate(W.frames(t), [W.LATE, W.SUSPECT])).select("case_id", "atom", "rule_id", "kind", "depends_on")


@query(W.SQL + _CHOSEN + """SELECT case_id, atom, 'derived' AS kind, 'r_late' AS rule_id, sub AS substitution, '{"pos":["order_placed(CUSTOMER=' || case_id || ',DATE=' || d1 || ',ORDER=' || ord || ')","line_returned(DATE=' || d2 || ',ORDER=' || ord || ',PART=' || part || ')"],"naf":["order_open(ORDER=' || ord || ')"]}' AS rests_on FROM m
UNION ALL SELECT case_id, 'order_placed(CUSTOMER=' || case_id || ',DATE=' || d || ',ORDER=' || ord || ')', 'base', NULL, NULL, NULL FROM op UNION ALL SELECT case_id, 'line_returned(DATE=' || d || ',ORDER=' || ord || ',PART=' || part || ')', 'base', NULL, NULL, NULL FROM lr
UNION ALL SELECT o_custkey, 'order_open(ORDER=' || ord || ')', 'base', NULL, NULL, NULL FROM oo JOIN orders ON o_orderkey = ord""")
def i8_proof_table(t: Tables):
    """What is stored of a run: base and derived atoms, the substitution, and what each rests on as JSON."""
    f = W.frames(t)
    return V.proof_table(R.evaluate({p: f[p] for p in ("order_placed", "line_returned", "order_open")}, [W.LATE]))


@query(W.SQL + "SELECT case_id, query_id, verdict FROM v")
def i9_verdicts(t: Tables):
    return V.verdicts(R.evaluate(W.frames(t), W.RULES), W.asked(t)).select("case_id", "query_id", "verdict")


@query(W.SQL + "SELECT case_id, query_id, violated FROM v WHERE verdict = 'blocked'")
def i10_verdict_details(t: Tables):
    v = V.verdicts(R.evaluate(W.frames(t), W.RULES), W.asked(t))
    return v.where("verdict = 'blocked'").select("case_id", "query_id", F.concat_ws(";", "violated").alias("violated"))


@query(W.SQL + "SELECT case_id, 'late_return(CUSTOMER=' || case_id || ',ORDER=' || query_id || ')' AS atom, 'line_returned' AS missing FROM v WHERE predicate = 'late_return' AND verdict = 'not_proved' AND query_id NOT IN (SELECT ord FROM lr)")
def i10_missing_positives(t: Tables):
    """For asked atoms that are not proved: the positive literals of the rule that no fact matches."""
    f = W.frames(t)
    refused = V.verdicts(R.evaluate(f, W.RULES), W.asked(t)).where("verdict = 'not_proved' AND predicate = 'late_return'")
    asked = refused.select("case_id", "atom", F.col("case_id").alias("CUSTOMER"), F.col("query_id").alias("ORDER"))
    return R.explain_missing(W.LATE, f, asked)


@query(W.SQL + "SELECT case_id, query_id AS fact_id, CASE WHEN query_id % 10 = 0 THEN 'unknown' ELSE verdict END AS outcome FROM v WHERE predicate <> 'recalled'")
def i11_feedback(t: Tables):
    candidates = W.asked(t).withColumnRenamed("query_id", "fact_id").where("predicate <> 'recalled'").withColumn("atom", F.when(F.col("fact_id") % 10 != 0, F.col("atom")))
    return V.feedback(R.evaluate(W.frames(t), W.RULES), candidates).select("case_id", "fact_id", "outcome")


@query(W.SQL + "SELECT case_id, query_id AS fact_id, CASE WHEN query_id % 5 = 0 THEN 'rejected' WHEN verdict = 'proved' THEN 'proved' ELSE 'candidate' END AS status FROM v")
def i12_status_update(t: Tables):
    facts = W.asked(t).select("case_id", F.col("query_id").alias("fact_id"), "atom", F.when(F.col("query_id") % 5 == 0, "rejected").otherwise("candidate").alias("status"))
    return V.updated_statuses(R.evaluate(W.frames(t), W.RULES), facts).select("case_id", "fact_id", "status")


@query(W.SQL + "SELECT case_id, 'LATE_RETURN' AS predicate, 'late_return(CUSTOMER=' || case_id || ',ORDER=' || ord || ')' AS atom FROM late WHERE ord % 2 = 1")
def i13_new_facts(t: Tables):
    m = R.evaluate(W.frames(t), [W.LATE])
    known = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("late_return(CUSTOMER="), F.col("o_custkey").cast("string"), F.lit(",ORDER="), F.col("o_orderkey").cast("string"), F.lit(")")).alias("atom"))
    return V.new_facts(m, known).select("case_id", "predicate", "atom")


@query(W.SQL + """SELECT case_id, CASE WHEN count_if(verdict = 'proved') > 0 THEN 'proved' WHEN count_if(verdict IN ('blocked', 'not_proved')) > 0 THEN 'not_proved' ELSE 'unknown' END AS result, count_if(verdict = 'blocked') AS n_blocked FROM v GROUP BY 1""")
def i14_run_results(t: Tables):
    v = V.verdicts(R.evaluate(W.frames(t), W.RULES), W.asked(t))
    return V.run_results(R.Model(W.RULES, {}), v).select("case_id", "result", "n_blocked")


_PAIRS = "WITH p AS (SELECT o_custkey AS case_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _broken(t: Tables, **how: object):
    c = temporal.Constraint("c", how.pop("kind"), ("order_placed", "ORDER", "DATE"), ("line_shipped", "ORDER", "DATE"), **how)
    return temporal.violations(W.frames(t), [c]).select("case_id", F.col("key").alias("order"))


@query(_PAIRS + " SELECT DISTINCT case_id, k AS \"order\" FROM p WHERE b < a")
def j1_order_constraint(t: Tables):
    return _broken(t, kind="order")


@query(_PAIRS + " SELECT DISTINCT case_id, k AS \"order\" FROM p WHERE NOT (isoyear(a) = isoyear(b) AND weekofyear(a) = weekofyear(b))")
def j2_same_period(t: Tables):
    return _broken(t, kind="same", period="week")


@query(_PAIRS + " SELECT DISTINCT case_id, k AS \"order\" FROM p WHERE NOT (date_diff('day', a, b) BETWEEN 0 AND 30)")
def j3_window_constraint(t: Tables):
    return _broken(t, kind="window", days=30)


def _pairs(t: Tables, test: str):
    f = W.frames(t)
    a = f["order_placed"].select("case_id", "ORDER", F.col("DATE").alias("a"))
    x = a.join(f["line_shipped"].select("case_id", "ORDER", F.col("DATE").alias("b")), ["case_id", "ORDER"])
    holds = F.coalesce(temporal.HELPER_TESTS[test](F.col("a"), F.col("b")), F.lit(False))  # no key of the join, so lines stay where they were dealt
    return x.where(holds).groupBy("case_id").agg(F.count_distinct("ORDER", "b").alias("n"))


def _pairs_sql(test: str) -> str:
    return _PAIRS + f" SELECT case_id, count(DISTINCT (k, b)) AS n FROM p WHERE {test} GROUP BY 1"


@query(_pairs_sql("a < b"))
def j4_before(t: Tables):
    return _pairs(t, "before")


@query(_pairs_sql("abs(date_diff('day', a, b)) <= 14"))
def j5_within_days(t: Tables):
    return _pairs(t, "within_14_days")


@query(_pairs_sql("date_diff('day', a, b) BETWEEN 0 AND 60"))
def j6_within_days_after(t: Tables):
    return _pairs(t, "within_60_days_after")


@query(_pairs_sql("date_trunc('month', a) = date_trunc('month', b)"))
def j7_same_month(t: Tables):
    return _pairs(t, "same_month")


@query(_PAIRS + " SELECT DISTINCT case_id, k AS \"order\" FROM p WHERE date_diff('day', a, b) BETWEEN 0 AND 2")
def j8_paid_in_time(t: Tables):
    f = W.frames(t)
    return temporal.paid_in_time(f["order_placed"], f["line_shipped"]).select("case_id", F.col("ORDER").alias("order"))


@query("""SELECT DISTINCT o_custkey AS case_id, l_partkey AS coupon FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def j9_coupon_not_expired(t: Tables):
    return temporal.not_expired(W.frames(t)["line_shipped"].select("case_id", F.col("PART").alias("COUPON"))).select("case_id", F.col("COUPON").alias("coupon"))


@query("""WITH c AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT c.o_custkey AS case_id, p_partkey AS coupon, count(o_orderkey) AS n_orders FROM c JOIN part ON p_partkey = c.l_partkey LEFT JOIN orders o ON o.o_custkey = c.o_custkey AND o_totalprice >= p_retailprice * 100 GROUP BY ALL""")
def j10_minimum_basket(t: Tables):
    """Coupons of a customer (one per part bought) with the number of orders that reach their minimum."""
    bought = W.frames(t)["line_shipped"].select("case_id", F.col("PART").alias("p_partkey")).distinct()
    coupons = bought.join(t.part, "p_partkey").select("case_id", F.col("p_partkey").alias("id"), (-F.col("p_retailprice") * 100).alias("value"))
    amounts = t.orders.select(F.col("o_custkey").alias("case_id"), (-F.col("o_totalprice")).alias("value"))  # negated: minimum <= amount
    return temporal.reached(coupons, amounts, "case_id").select("case_id", F.col("id").alias("coupon"), F.col("n").alias("n_orders"))


@query(_PAIRS + """ SELECT case_id, 'late' AS "constraint", count(DISTINCT k) AS n_violations FROM p WHERE b < a GROUP BY 1
UNION ALL SELECT case_id, 'month', count(DISTINCT k) FROM p WHERE date_trunc('month', a) <> date_trunc('month', b) GROUP BY 1""")
def j12_violation_report(t: Tables):
    ends = {"earlier": ("order_placed", "ORDER", "DATE"), "later": ("line_shipped", "ORDER", "DATE")}
    return temporal.report(temporal.violations(W.frames(t), [temporal.Constraint("late", "order", **ends), temporal.Constraint("month", "same", period="month", **ends)]))


@query(W.SQL + """SELECT DISTINCT case_id, 'late_return(CUSTOMER=' || case_id || ',ORDER=' || ord || ')' AS atom, CASE WHEN ord IN (SELECT ord FROM oo) THEN 'rejected' ELSE 'proved' END AS status,
CASE WHEN ord IN (SELECT ord FROM oo) THEN 'F' ELSE 'T' END AS value FROM lateb UNION ALL SELECT DISTINCT case_id, 'watch(CUSTOMER=' || case_id || ')', 'proved', 'T' FROM late""")
def i15_refinement_rounds(t: Tables):
    """The second round rests on the first: customers are watched for late returns that are proved facts, which round one makes."""
    base = {p: f.withColumn("confidence", F.lit(1.0)) for p, f in W.frames(t).items() if p in ("order_placed", "line_returned", "order_open")}
    watch = R.Rule("r_watch", R.lit("watch", CUSTOMER="C"), (R.lit("told_late", CUSTOMER="C", ORDER="_"),))

    def told_of(facts):
        told = facts.where("status = 'proved' AND value = 'T' AND atom LIKE 'late_return(%'")
        role = lambda name: F.regexp_extract("atom", name + r"=(\d+)", 1).cast("long").alias(name)
        return {"told_late": told.select("case_id", role("CUSTOMER"), role("ORDER"), "confidence")}

    facts, _ = loop.refine([W.LATE, watch], base, told_of, t.spark.createDataFrame([], loop.FACT), rounds=3)
    return facts.select("case_id", "atom", "status", "value")
