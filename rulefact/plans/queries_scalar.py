"""Queries of the column functions (group C) and of row filters and checks (group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulefact.functions import scalars as S
from rulefact.operators import checks, filters
from rulefact.plans.registry import Tables, query
from rulefact.sources.durable import in_parts

_T = f"translate({{}}, '{S.ACCENTED}', '{S.PLAIN}')"
_NORM = "regexp_replace(lower(" + _T + "), '[^a-z0-9_]', '_', 'g')"
_CID = "CASE WHEN {n} = '' OR regexp_matches({n}, '^[0-9]') THEN 'e_' || {n} ELSE {n} END"


@query(f"""WITH x AS (SELECT doc_id, {_NORM.format("text")} AS n FROM documents)
SELECT doc_id, {_CID.format(n="n")} AS cid FROM x""")
def c1_constant_id(t: Tables):
    return t.documents.select("doc_id", S.constant_id(F.col("text")).alias("cid"))


@query(f"""WITH x AS (SELECT doc_id, text AS o, {_NORM.format("text")} AS n FROM documents),
y AS (SELECT doc_id, o, {_CID.format(n="n")} AS cid FROM x)
SELECT cid, arg_min(o, doc_id) AS original, count(*) AS n FROM y GROUP BY cid""")
def c2_reverse_map(t: Tables):
    x = t.documents.select("doc_id", F.col("text").alias("o"))
    return x.groupBy(S.constant_id(F.col("o")).alias("cid")).agg(F.min_by("o", "doc_id").alias("original"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate, 'd_%Y_%m_%d') AS token, CAST(o_orderdate AS DATE) AS day,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def c3_date_tokens(t: Tables):
    token = S.date_token(F.col("o_orderdate"))
    broken = F.when(F.col("o_orderkey") % 7 == 0, F.lit("d_2026_13_45")).otherwise(F.concat(token, F.when(F.col("o_orderkey") % 3 == 0, F.lit("_10_30")).otherwise(F.lit(""))))
    return t.orders.select("o_orderkey", token.alias("token"), S.token_date(token).alias("day"), S.token_date(broken).alias("parsed"))


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) + CAST(lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) / 100 AS amount FROM orders""")
def c4_number_tokens(t: Tables):
    token = F.concat(F.lit("e_"), F.floor("o_totalprice").cast("string"), F.lit("_"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    return t.orders.select("o_orderkey", S.token_number(token).alias("amount"))


@query("""SELECT o_orderkey, 'order_placed' AS predicate, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderkey AS VARCHAR) AS "order", 2 AS n_args FROM orders""")
def c5_parse_atom(t: Tables):
    text = F.concat(F.lit(" Order_Placed("), F.col("o_custkey").cast("string"), F.lit(" , "), F.col("o_orderkey").cast("string"), F.lit(")."))
    args = S.args_of(text)
    return t.orders.select("o_orderkey", S.predicate_of(text).alias("predicate"), F.get(args, F.lit(0)).alias("customer"), F.get(args, F.lit(1)).alias("order"), F.size(args).alias("n_args"))


@query("""SELECT o_orderkey, 'order_placed(CUSTOMER=' || o_custkey || ',ORDER=' || o_orderkey || ')' AS atom FROM orders""")
def c6_atom_text(t: Tables):
    return t.orders.select("o_orderkey", S.atom_key(F.lit("order_placed"), {"ORDER": F.col("o_orderkey"), "CUSTOMER": F.col("o_custkey")}).alias("atom"))


@query("""SELECT o_orderkey, 'ORDER_PLACED|CUSTOMER=C' || o_custkey || '|ORDER=O' || o_orderkey || '|STATUS=$' || o_orderstatus AS fact_key FROM orders""")
def c7_fact_key(t: Tables):
    arg = lambda role, entity, literal: F.struct(F.lit(role).alias("role"), entity.alias("entity_id"), literal.alias("literal_value"))
    none = F.lit(None).cast("string")
    args = F.array(arg("STATUS", none, F.col("o_orderstatus")), arg("ORDER", F.concat(F.lit("O"), F.col("o_orderkey").cast("string")), none), arg("CUSTOMER", F.concat(F.lit("C"), F.col("o_custkey").cast("string")), none))
    return t.orders.select("o_orderkey", S.fact_key(F.lit("ORDER_PLACED"), args).alias("fact_key"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_part, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'LINE|NUMBER=$' || l_linenumber || '|ORDER=' || l_orderkey AS identity, first_part, n FROM x WHERE n > 1""")
def c8_fact_identity(t: Tables):
    arg = lambda role, entity, literal: F.struct(F.lit(role).alias("role"), entity.cast("string").alias("entity_id"), literal.cast("string").alias("literal_value"))
    key = S.fact_key(F.lit("LINE"), F.array(arg("ORDER", F.col("l_orderkey"), F.lit(None)), arg("NUMBER", F.lit(None), F.col("l_linenumber"))))
    x = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("first_part"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return x.select(key.alias("identity"), "first_part", "n")


@query("""WITH x AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM x""")
def c9_name_uuid(t: Tables):
    return t.customer.select("c_custkey", S.name_uuid(F.col("c_name")).alias("id"))


@query("""SELECT c_custkey, TIMESTAMP '2026-01-01' + to_seconds(CAST(('0x' || left(sha256(c_name), 10))::BIGINT % 31536000 AS BIGINT)) AS at FROM customer""")
def c10_stable_time(t: Tables):
    return t.customer.select("c_custkey", S.stable_time(F.col("c_name"), 2026).cast("timestamp_ntz").alias("at"))


_LOGITS = "[c_acctbal / 1000, (c_custkey % 7) - 3.0, (c_custkey % 11) / 2.0]"
_P = f"""WITH l AS (SELECT c_custkey, {_LOGITS} AS l FROM customer), e AS (SELECT c_custkey, l, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM l),
p AS (SELECT c_custkey, l, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)"""


def _logits():
    return F.array(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 7) - 3.0, (F.col("c_custkey") % 11) / 2.0)


@query(_P + " SELECT c_custkey, round(list_max(p), 6) AS top1, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin FROM p")
def c11_softmax(t: Tables):
    top, margin = S.top_and_margin(_logits())
    return t.customer.select("c_custkey", F.round(top, 6).alias("top1"), F.round(margin, 6).alias("margin"))


@query(f"WITH l AS (SELECT c_custkey, {_LOGITS} AS l FROM customer) SELECT c_custkey, ['low', 'mid', 'high'][list_position(l, list_max(l))] AS value FROM l")
def c12_argmax(t: Tables):
    return t.customer.select("c_custkey", S.argmax_value(_logits(), F.array(F.lit("low"), F.lit("mid"), F.lit("high"))).alias("value"))


@query(_P + """ SELECT p.c_custkey, round(ln(1 + exp(c_acctbal / 1000)), 6) AS softplus, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS sigmoid,
round(-list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-9)))), 6) AS entropy, round(sqrt(list_sum(list_transform(l, lambda v: v * v))), 6) AS norm
FROM p JOIN customer USING (c_custkey)""")
def c13_math(t: Tables):
    x = F.col("c_acctbal") / 1000
    return t.customer.select("c_custkey", F.round(S.softplus(x), 6).alias("softplus"), F.round(S.sigmoid(x), 6).alias("sigmoid"), F.round(S.entropy(S.softmax(_logits())), 6).alias("entropy"), F.round(S.norm(_logits()), 6).alias("norm"))


@query("SELECT doc_id, nullif(trim(substr(text, CAST(doc_id % 50 + 1 AS BIGINT), 20), ' '), '') AS span FROM documents")
def c14_span_text(t: Tables):
    start = (F.col("doc_id") % 50).cast("int")
    return t.documents.select("doc_id", S.span_text(F.col("text"), start, start + 20).alias("span"))


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(left(f, 57), ' ') || '...' END AS excerpt FROM x""")
def c15_excerpt(t: Tables):
    return t.documents.select("doc_id", S.excerpt(F.col("text"), 60).alias("excerpt"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'DELIVERY' WHEN event_id % 3 = 1 THEN 'ORDER' ELSE 'THING' END AS type FROM events""")
def c16_type_of_id(t: Tables):
    made = F.concat(F.element_at(F.array(F.lit("DEL_"), F.lit("ORD_"), F.lit("X")), (F.col("event_id") % 3 + 1).cast("int")), F.col("event_id").cast("string"))
    return t.events.select("event_id", S.type_of_id(made, {"DEL_": "DELIVERY", "ORD_": "ORDER", "CUST": "CUSTOMER"}, "THING").alias("type"))


@query("""SELECT event_id, event_id % 5 <> 0 AND props LIKE '{%' AS is_object FROM events""")
def c17_lenient_json(t: Tables):
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props"))
    return t.events.select("event_id", S.object_or_null(text, "map<string,string>").isNotNull().alias("is_object"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, replace(lower(o_orderpriority), '_', ' ') AS priority FROM orders""")
def c18_labels(t: Tables):
    return t.orders.select("o_orderkey", S.label(S.date_token(F.col("o_orderdate"))).alias("day"), S.label(F.lower("o_orderpriority")).alias("priority"))


@query("""SELECT DISTINCT 'supports:' || lower(o_orderpriority) || ':ORDER' AS relation, lower(o_orderpriority) AS predicate, 'ORDER' AS role FROM orders""")
def c20_relation_names(t: Tables):
    made = S.relation_name(F.col("o_orderpriority"), F.lit("order"))
    predicate, role = S.relation_parts(F.col("relation"))
    return t.orders.select(made.alias("relation")).distinct().select("relation", predicate.alias("predicate"), role.alias("role"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(l_discount, l_tax) AS top, coalesce(nullif(l_returnflag, 'N'), 'none') AS flag FROM lineitem""")
def c21_greatest_coalesce(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest("l_discount", "l_tax").alias("top"), F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("none")).alias("flag"))


# Group B


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def b1_observed_only(t: Tables):
    facts = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "observed").otherwise("candidate").alias("status"))
    return filters.observed(facts).select("o_orderkey")


@query("""SELECT p_partkey AS rule_id, p_size % 4 AS stratum, p_brand AS module FROM part WHERE p_size % 5 <> 0 AND (p_partkey % 2 = 0 OR p_brand IN ('Brand#11', 'Brand#12', 'Brand#1'))""")
def b2_enabled_rules(t: Tables):
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") % 4).alias("stratum"), F.col("p_brand").alias("module"), (F.col("p_size") % 5 != 0).alias("enabled"), (F.col("p_partkey") % 2 != 0).alias("learned"))
    return filters.enabled_rules(rules, ["Brand#11", "Brand#12", "Brand#1"]).select("rule_id", "stratum", "module")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (1, 2, 3) OR c_name LIKE '%9'""")
def b3_select_cases(t: Tables):
    cases = t.customer.select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("dataset_split"))
    return filters.select_cases(cases, split="BUILDING", ids=["1", "2", "3"], like="%9", name="c_name").select("c_custkey", "c_name")


@query("""SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'""")
def b4_distinct_from(t: Tables):
    return t.orders.where(filters.differs(F.nullif("o_orderstatus", F.lit("P")), F.lit("F"))).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE event_type = 'purchase' AND (event_id % 10 = 0 OR value / 500 >= 0.5)""")
def b5_truth_gate(t: Tables):
    x = t.events.select("event_id", F.when(F.col("event_type") == "purchase", "T").otherwise("U").alias("value"), F.when(F.col("event_id") % 10 != 0, F.col("value") / 500).alias("confidence"))
    return x.where(filters.is_true(F.col("value"), F.col("confidence"))).select("event_id")


@query(f"""WITH l AS (SELECT c_custkey, {_LOGITS} AS l FROM customer)
SELECT c_custkey, ['low', 'mid', 'high'][list_position(l, list_max(l))] AS value FROM l WHERE c_custkey % 9 = 0 OR list_reverse_sort(l)[1] - list_reverse_sort(l)[2] >= 1.0""")
def b6_cluster_gate(t: Tables):
    x = t.customer.select("c_custkey", _logits().alias("logits"), (F.col("c_custkey") % 9 == 0).alias("is_clamped"))
    return x.where(filters.is_decided(F.col("logits"), F.col("is_clamped"))).select("c_custkey", S.argmax_value(F.col("logits"), F.array(F.lit("low"), F.lit("mid"), F.lit("high"))).alias("value"))


@query("""SELECT l_orderkey AS fact_id, count(*) AS filled FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3) GROUP BY 1 HAVING count(*) = 3""")
def b7_complete_atoms(t: Tables):
    lines = in_parts(t.lineitem.select("l_orderkey", "l_linenumber"), t.lineitem.count(), 500_000, "l_orderkey")
    args = lines.select(F.col("l_orderkey").alias("fact_id"), F.lit("line").alias("predicate"), F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("role")).distinct()
    roles = t.spark.createDataFrame([("line", k, f"R{k}") for k in (1, 2, 3)], "predicate string, position int, role string")
    return filters.complete_facts(args, roles).select("fact_id", "filled")


@query("""SELECT p_partkey FROM part WHERE NOT (p_partkey % 4 IN (0, 1, 2))""")
def b8_hide_helpers(t: Tables):
    made = F.concat(F.element_at(F.array(F.lit("_sv_x"), F.lit("ab_can_return"), F.lit("within_14_days_after"), F.lit("order_placed")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return t.part.select("p_partkey", made.alias("predicate")).where(filters.is_visible(F.col("predicate"))).select("p_partkey")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def b9_in_ontology(t: Tables):
    states = t.customer.select("c_custkey", "c_mktsegment", F.lit("segment").alias("cluster"))
    schemas = t.spark.createDataFrame([("segment", ["BUILDING", "MACHINERY"]), ("other", ["X"])], "cluster string, domain array<string>")
    return filters.in_domain(states, schemas, "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("""WITH l AS (SELECT p_brand AS round_id, p_partkey, p_size % 3 = 0 AS promoted FROM part) SELECT 'promoted' AS asked, round_id, p_partkey FROM l WHERE promoted
UNION ALL SELECT 'all', round_id, p_partkey FROM l UNION ALL SELECT 'listed', round_id, p_partkey FROM l WHERE round_id IN ('Brand#1', 'Brand#11', 'Brand#12')""")
def b10_round_filter(t: Tables):
    labels = t.part.select(F.col("p_brand").alias("round_id"), "p_partkey", (F.col("p_size") % 3 == 0).alias("promoted"))
    asked = {"promoted": ([], True), "all": ([], False), "listed": (["Brand#1", "Brand#11", "Brand#12"], True)}
    found = [filters.rounds(labels, *how).select(F.lit(name).alias("asked"), "round_id", "p_partkey") for name, how in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 1.5 ELSE value / 500 END AS confidence, CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS id, event_id % 17 = 0 AS two FROM events)
SELECT event_id, concat_ws(',', CASE WHEN NOT (confidence BETWEEN 0 AND 1) THEN 'confidence_range' END, CASE WHEN two THEN 'entity_xor_literal' END, CASE WHEN id = '' THEN 'id_not_empty' END) AS failed
FROM x WHERE NOT (confidence BETWEEN 0 AND 1) OR two OR id = ''""")
def b11_row_checks(t: Tables):
    x = t.events.select("event_id", F.when(F.col("event_id") % 11 == 0, 1.5).otherwise(F.col("value") / 500).alias("confidence"), F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("user_id").cast("string")).alias("entity_id"), F.when(F.col("event_id") % 17 == 0, "x").alias("literal_value"))
    bad = checks.validate(x, {"confidence_range": checks.in_range("confidence", 0, 1), "entity_xor_literal": checks.exactly_one("entity_id", "literal_value"), "id_not_empty": checks.not_empty("entity_id")})[1]
    return bad.select("event_id", F.concat_ws(",", "failed").alias("failed"))
