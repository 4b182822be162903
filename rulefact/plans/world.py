"""A fact world over the driver's tables: customers are cases, orders and lines are facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.plans.registry import Tables
from rulefact.plans.rules import Rule, lit, naf
from rulefact.sources.durable import in_parts

#: Lines that one task sorts and joins; tables of more are dealt to more partitions.
LINES_EACH = 500_000


def frames(t: Tables) -> dict[str, DataFrame]:
    orders = t.orders
    n = t.lineitem.count()
    lines = in_parts(t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", F.to_date("l_shipdate").alias("DATE")), n, LINES_EACH, "l_orderkey")
    owned = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_id"), F.col("l_orderkey").alias("ORDER"), F.col("l_partkey").alias("PART"), "DATE", "l_returnflag")
    order = orders.select(F.col("o_custkey").alias("case_id"), F.col("o_custkey").alias("CUSTOMER"), F.col("o_orderkey").alias("ORDER"), F.to_date("o_orderdate").alias("DATE"), "o_orderstatus", "o_totalprice")
    found = {
        "order_placed": order.select("case_id", "CUSTOMER", "ORDER", "DATE"),
        "line_shipped": owned.select("case_id", "ORDER", "PART", "DATE"),
        "line_returned": owned.where("l_returnflag = 'R'").select("case_id", "ORDER", "PART", "DATE"),
        "order_open": order.where("o_orderstatus = 'O'").select("case_id", "ORDER"),
        "order_done": order.where("o_orderstatus = 'F'").select("case_id", "ORDER"),
    }
    dealt = {p: in_parts(f, n, LINES_EACH, "case_id", "ORDER") for p, f in found.items()}
    return dealt | {p: dealt[p].distinct() for p in ("line_shipped", "line_returned")}  # equal rows lie together by now


LATE = Rule("r_late", lit("late_return", CUSTOMER="C", ORDER="O"), (lit("order_placed", CUSTOMER="C", ORDER="O", DATE="D1"), lit("line_returned", ORDER="O", PART="P", DATE="D2"), lit("before", FROM="D1", TO="D2"), naf("order_open", ORDER="O")), stratum=1)
SUSPECT = Rule("r_suspect", lit("suspect", CUSTOMER="C"), (lit("late_return", CUSTOMER="C", ORDER="O"), lit("order_done", ORDER="O")), stratum=1)
CLEAN = Rule("r_clean", lit("clean", CUSTOMER="C", ORDER="O"), (lit("order_placed", CUSTOMER="C", ORDER="O", DATE="_"), naf("suspect", CUSTOMER="C"), naf("line_returned", ORDER="O", PART="_", DATE="_")), stratum=2)
RULES = [LATE, SUSPECT, CLEAN]


def asked(t: Tables) -> DataFrame:
    """One query per order, of four kinds, so that every verdict occurs."""
    o = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("query_id"), "o_custkey", "o_orderkey")
    text = lambda p: F.concat(F.lit(f"{p}(CUSTOMER="), F.col("o_custkey").cast("string"), F.lit(",ORDER="), F.col("o_orderkey").cast("string"), F.lit(")"))
    kind = F.col("o_orderkey") % 4
    predicate = F.when(kind < 2, "late_return").when(kind == 2, "clean").otherwise("recalled")
    atom = F.when(kind < 2, text("late_return")).when(kind == 2, text("clean")).otherwise(text("recalled"))
    return o.select("case_id", "query_id", predicate.alias("predicate"), atom.alias("atom"))


def reply_frames(t: Tables) -> dict[str, DataFrame]:
    """Conversations as cases: each turn replies to the one before."""
    c = t.conversations
    return {"reply_to": c.where("turn > 0").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("TURN"), (F.col("turn") - 1).alias("TO")).distinct()}


ANCESTOR = [
    Rule("r_direct", lit("ancestor", TURN="T", TO="S"), (lit("reply_to", TURN="T", TO="S"),)),
    Rule("r_chain", lit("ancestor", TURN="T", TO="R"), (lit("ancestor", TURN="T", TO="S"), lit("reply_to", TURN="S", TO="R"))),
]

#: The same world in SQL, for the oracles.
SQL = """WITH op AS (SELECT o_custkey AS case_id, o_orderkey AS ord, CAST(o_orderdate AS DATE) AS d FROM orders),
lr AS (SELECT DISTINCT o_custkey AS case_id, l_orderkey AS ord, l_partkey AS part, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
oo AS (SELECT o_orderkey AS ord FROM orders WHERE o_orderstatus = 'O'),
od AS (SELECT o_orderkey AS ord FROM orders WHERE o_orderstatus = 'F'),
lateb AS (SELECT op.case_id, op.ord, lr.part, op.d AS d1, lr.d AS d2 FROM op JOIN lr USING (case_id, ord) WHERE op.d < lr.d),
late AS (SELECT DISTINCT case_id, ord FROM lateb WHERE ord NOT IN (SELECT ord FROM oo)),
suspect AS (SELECT DISTINCT case_id FROM late WHERE ord IN (SELECT ord FROM od)),
clean AS (SELECT case_id, ord FROM op WHERE case_id NOT IN (SELECT case_id FROM suspect) AND ord NOT IN (SELECT ord FROM lr)),
asked AS (SELECT o_custkey AS case_id, o_orderkey AS query_id, CASE WHEN o_orderkey % 4 < 2 THEN 'late_return' WHEN o_orderkey % 4 = 2 THEN 'clean' ELSE 'recalled' END AS predicate FROM orders),
blocked AS (SELECT DISTINCT 'late_return' AS predicate, case_id, ord, 'order_open(ORDER=' || ord || ')' AS v FROM lateb WHERE ord IN (SELECT ord FROM oo)
UNION ALL SELECT 'clean', case_id, ord, 'suspect(CUSTOMER=' || case_id || ')' FROM op WHERE case_id IN (SELECT case_id FROM suspect)
UNION ALL SELECT DISTINCT 'clean', case_id, ord, 'line_returned(DATE=_,ORDER=' || ord || ',PART=_)' FROM op WHERE ord IN (SELECT ord FROM lr)),
holds AS (SELECT 'late_return' AS predicate, * FROM late UNION ALL SELECT 'clean', * FROM clean),
v AS (SELECT a.case_id, a.query_id, a.predicate, CASE WHEN h.ord IS NOT NULL THEN 'proved' WHEN b.vs IS NOT NULL THEN 'blocked' WHEN a.predicate = 'recalled' THEN 'unknown' ELSE 'not_proved' END AS verdict,
CASE WHEN h.ord IS NULL THEN b.vs END AS violated FROM asked a LEFT JOIN holds h ON h.predicate = a.predicate AND h.case_id = a.case_id AND h.ord = a.query_id
LEFT JOIN (SELECT predicate, case_id, ord, string_agg(v, ';' ORDER BY v) AS vs FROM blocked GROUP BY ALL) b ON b.predicate = a.predicate AND b.case_id = a.case_id AND b.ord = a.query_id)
"""
