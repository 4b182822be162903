"""Further queries of groups A, F, I, J, K, M and O."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulefact.functions.scalars import excerpt
from rulefact.operators import beliefs as B
from rulefact.operators import learning as M
from rulefact.operators import picks as P
from rulefact.plans import rules as R
from rulefact.plans import views as V
from rulefact.plans import world as W
from rulefact.plans.queries_sources import _evaluated, _folder
from rulefact.plans.registry import Tables, query
from rulefact.sources import records as S


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS f FROM documents)
SELECT 'd' || doc_id AS case_id, CASE WHEN length(f) <= 80 THEN f ELSE rtrim(left(f, 77), ' ') || '...' END AS excerpt FROM x""")
def a8_annotation_template(t: Tables):
    """Written as JSON lines with blank label columns, and read back."""
    path = _folder(t, "template")
    S.annotation_template(t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("case_id"), excerpt(F.col("text"), 80).alias("excerpt"))).write.json(path)
    return t.spark.read.schema("case_id string, excerpt string, query string, expected_result string").json(path).where("coalesce(query, '') = '' AND coalesce(expected_result, '') = ''").select("case_id", "excerpt")


_EVAL = W.SQL + ", e AS (SELECT verdict, CASE WHEN query_id % 2 = 0 THEN 'not_proved' ELSE 'proved' END AS expected FROM v), ev AS (SELECT *, verdict = expected OR (verdict = 'blocked' AND expected = 'not_proved') AS correct FROM e)"


@query(_EVAL + " SELECT round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(CAST(verdict <> 'unknown' AS DOUBLE)), 6) AS answer_coverage FROM ev")
def a9_report_file(t: Tables):
    """The report as one JSON row, written and read back."""
    path = _folder(t, "report")
    S.report_row(V.report(_evaluated(t))).write.text(path)
    x = t.spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    return x.select(F.round(F.col("m")["accuracy"], 6).alias("accuracy"), F.round(F.col("m")["answer_coverage"], 6).alias("answer_coverage"))


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS f FROM documents)
SELECT 'd' || doc_id AS case_id, CASE WHEN length(f) <= 80 THEN f ELSE rtrim(left(f, 77), ' ') || '...' END AS excerpt FROM x""")
def a8_template_csv(t: Tables):
    """The same template as CSV with a header; quotes are doubled, so that excerpts come back as they are."""
    path, how = _folder(t, "template-csv"), {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    S.annotation_template(t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("case_id"), excerpt(F.col("text"), 80).alias("excerpt"))).write.options(**how).csv(path)
    return t.spark.read.options(**how).schema("case_id string, excerpt string, query string, expected_result string").csv(path).where("coalesce(query, '') = '' AND coalesce(expected_result, '') = ''").select("case_id", F.coalesce("excerpt", F.lit("")).alias("excerpt"))


@query(W.SQL + ", e AS (SELECT case_id, query_id, verdict, CASE WHEN query_id % 2 = 0 THEN 'not_proved' ELSE 'proved' END AS expected FROM v) SELECT case_id, query_id, expected, verdict, verdict = expected OR (verdict = 'blocked' AND expected = 'not_proved') AS correct FROM e")
def a9_query_csv(t: Tables):
    """One line per evaluated query, written as CSV and read back."""
    path = _folder(t, "per-query")
    _evaluated(t).select("case_id", "query_id", "expected", "verdict", "correct").write.option("header", True).csv(path)
    return t.spark.read.option("header", True).schema("case_id long, query_id long, expected string, verdict string, correct boolean").csv(path)


@query("SELECT o_custkey AS proof_id, o_orderkey AS step FROM orders")
def a15_proof_steps_from_json(t: Tables):
    """Proof runs stored as an object of steps or as a list come back as ordered steps."""
    step = F.struct(F.col("o_orderkey").alias("step"), F.lit("a").alias("atom"))
    runs = t.orders.groupBy(F.col("o_custkey").alias("proof_id")).agg(F.sort_array(F.collect_list(step)).alias("x"))
    as_list = F.to_json("x")
    as_object = F.to_json(F.map_from_arrays(F.transform("x", lambda s: s["step"].cast("string")), "x"))
    stored = runs.select("proof_id", F.when(F.col("proof_id") % 2 == 0, as_list).otherwise(as_object).alias("dag"))
    return S.proof_steps_of(stored).select("proof_id", "step")


@query(W.SQL + ", g AS (SELECT case_id, ord, (part % 7) / 7 AS c, part FROM lateb) SELECT case_id, ord AS \"order\", part FROM g QUALIFY row_number() OVER (PARTITION BY case_id, ord ORDER BY c DESC, part) = 1")
def f5_best_candidate(t: Tables):
    body = R.body_frame(W.LATE, W.frames(t)).select("case_id", F.col("v_O").alias("order"), F.col("v_P").alias("part"))
    return P.top(body, ["case_id", "order"], [((F.col("part") % 7) / 7).desc(), F.col("part")])


@query(W.SQL + "SELECT case_id, ord AS \"order\", 'r_any' AS rule_id FROM (SELECT DISTINCT case_id, ord FROM lateb) UNION ALL SELECT case_id, ord, 'r_done' FROM (SELECT o_custkey AS case_id, o_orderkey AS ord FROM orders WHERE o_orderstatus = 'F') x WHERE ord NOT IN (SELECT ord FROM lateb)")
def f6_first_rule(t: Tables):
    """Two rules with one head: the first that proves an atom is its proof."""
    any_ = R.Rule("r_any", R.lit("flagged", ORDER="O"), (R.lit("order_placed", CUSTOMER="_", ORDER="O", DATE="D1"), R.lit("line_returned", ORDER="O", PART="_", DATE="D2"), R.lit("before", FROM="D1", TO="D2")))
    done = R.Rule("r_done", R.lit("flagged", ORDER="O"), (R.lit("order_done", ORDER="O"),))
    return R.evaluate(W.frames(t), [any_, done]).derived["flagged"].select("case_id", F.col("ORDER").alias("order"), "proof.rule_id")


@query("WITH w AS (SELECT l_suppkey AS i, l_linenumber AS j, sum(CAST(round(l_discount * 1000000000) AS BIGINT)) AS s, count(l_discount) AS n FROM lineitem GROUP BY ALL) SELECT i, j FROM w WHERE s >= 50000000 * n AND n > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY (2 * s + n) // (2 * n) DESC, j) <= 2")
def f9_top_destinations(t: Tables):
    """Mean discounts of at least 0.05, the two largest to 9 decimals; in whole numbers, as sums of doubles depend on their order."""
    w = t.lineitem.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum(F.round(F.col("l_discount") * 1000000000).cast("long")).alias("s"), F.count("l_discount").alias("n"))
    return P.top(w.where("s >= 50000000 * n AND n > 0"), ["i"], [F.expr("(2 * s + n) DIV (2 * n)").desc(), F.col("j")], 2).select("i", "j")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS step FROM orders")
def f14_step_numbers(t: Tables):
    return P.top(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 1 << 30, rank="step").select("o_custkey", "o_orderkey", "step")


@query("SELECT p_size % 4 AS stratum, p_partkey AS rule_id FROM part ORDER BY 1, 2")
def f15_stable_listing(t: Tables):
    return t.part.select((F.col("p_size") % 4).alias("stratum"), F.col("p_partkey").alias("rule_id")).orderBy("stratum", "rule_id")


_RULE_ROWS = """WITH h AS (SELECT p_partkey AS id, p_brand AS head, p_size % 4 AS s, p_type AS dep, p_partkey % 3 = 0 AS neg FROM part), one AS (SELECT head, count(DISTINCT s) AS n, min(s) AS s FROM h GROUP BY 1),
d AS (SELECT h.id, h.s, h.neg, o.s AS ds FROM h JOIN h t ON t.id = (h.id * 7) % (SELECT max(p_partkey) FROM part) + 1 JOIN one o ON o.head = t.head)"""


@query(_RULE_ROWS + " SELECT id AS rule_id, 'several_strata' AS problem FROM h JOIN one USING (head) WHERE n > 1 UNION ALL SELECT id, 'negated_not_below' FROM d WHERE neg AND ds >= s UNION ALL SELECT id, 'body_above' FROM d WHERE NOT neg AND ds > s")
def i1_stratification_table(t: Tables):
    """Rule rows made of parts: the head is the brand, the body another part's brand, a third is negated."""
    last = t.part.agg(F.max("p_partkey")).first()[0] or 1
    h = t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("head"), (F.col("p_size") % 4).alias("stratum"), (F.col("p_partkey") % 3 == 0).alias("negated"), ((F.col("p_partkey") * 7) % last + 1).alias("other"))
    body = h.join(t.part.select(F.col("p_partkey").alias("other"), F.col("p_brand").alias("predicate")), "other").select("rule_id", "negated", "predicate")
    return V.stratification_problems(h.select("rule_id", F.col("head").alias("predicate"), "stratum"), body)


@query("SELECT p_partkey AS name, p_brand IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 49) AS bound FROM part")
def j11_constraint_registry(t: Tables):
    """Constraints whose predicate occurs among the facts are bound; the others are listed as skipped."""
    known = t.part.join(t.lineitem.where("l_quantity >= 49"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("predicate")).distinct().withColumn("bound", F.lit(True))
    c = t.part.select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("predicate"))
    return c.join(known, "predicate", "left").select("name", F.coalesce("bound", F.lit(False)).alias("bound"))


@query("""WITH x AS (SELECT c_nationkey AS case_id, 'segment_' || lower(c_mktsegment) AS node_type, c_custkey AS id FROM customer UNION ALL SELECT c_nationkey, 'nation_' || c_nationkey, c_custkey FROM customer
UNION ALL SELECT DISTINCT c_nationkey, 'priority_' || lower(o_orderpriority), c_custkey FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT a.case_id, a.node_type AS src_type, b.node_type AS dst_type, count(*) AS n FROM x a JOIN x b ON a.case_id = b.case_id AND a.id = b.id GROUP BY ALL""")
def k6_template_edges(t: Tables):
    """All cluster pairs of an entity, before any rule is learned: customers have a segment, a nation and the priorities of their orders."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}_"), F.lower(F.col(c).cast("string"))).alias("node_type")
    case, node = F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("node_id")
    priority = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).select(case, named("priority", "o_orderpriority"), node).distinct()
    x = t.customer.select(case, named("segment", "c_mktsegment"), node).unionByName(t.customer.select(case, named("nation", "c_nationkey"), node)).unionByName(priority)
    pairs = x.select("node_id", F.col("node_type").alias("src_type")).join(x.select("node_id", F.col("node_type").alias("dst_type")), "node_id").select("src_type", "dst_type").distinct()
    return B.implication_edges(pairs, x).groupBy("case_id", "src_type", "dst_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT a.p_brand AS rule_head, b.p_type AS exception FROM part a JOIN part b ON a.p_size = b.p_size")
def k11_exception_gates(t: Tables):
    """Rules that negate an exception predicate, joined to the rules that derive it."""
    uses = t.part.select(F.col("p_brand").alias("rule_head"), F.col("p_size").alias("predicate")).distinct()
    gives = t.part.select(F.col("p_type").alias("exception"), F.col("p_size").alias("predicate")).distinct()
    return uses.join(gives, "predicate").select("rule_head", "exception").distinct()


@query("""WITH x AS (SELECT [l_discount * 10, l_tax * 10, 0.5] AS l, l_linenumber % 4 - 1 AS t, l_quantity AS w FROM lineitem), y AS (SELECT l, t, w, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM x WHERE t >= 0)
SELECT round(sum(w * -ln(greatest(e[CAST(t + 1 AS BIGINT)] / list_sum(e), 1e-9))) / sum(w), 6) AS loss, count(*) AS n FROM y""")
def m3_supervision_loss(t: Tables):
    rows = t.lineitem.select(F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5)).alias("logits"), (F.col("l_linenumber") % 4 - 1).alias("target"), F.col("l_quantity").alias("weight"))
    return M.weighted_loss(rows).select(F.round("loss", 6).alias("loss"), "n")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'imported' WHEN p_size % 4 = 1 THEN 'collected' ELSE ['draft', 'collected', 'imported', 'promoted'][1 + p_size % 4] END AS status FROM part")
def o7_round_lifecycle(t: Tables):
    """A change of status is taken only if it is the next step; others keep the old status."""
    steps = F.array(*map(F.lit, P.ROUND_STATUS))
    k = (F.col("p_size") % 4).cast("int")
    old = F.element_at(steps, F.when(k == 3, 3).when(k == 1, 1).otherwise(k + 1))
    wanted = F.when(k == 1, "collected").when(k == 3, "draft").otherwise(old)
    return P.advanced(t.part.select("p_partkey", old.alias("status"), wanted.alias("wanted"))).select("p_partkey", "status")
