"""Tasks keep a bounded share of the rows: nothing is dealt by the few keys of an ontology, partitions grow with the tables."""

import re

import pytest
from pyspark.sql import functions as F

from rulefact.operators import beliefs, extract, filters
from rulefact.plans import rules as R
from rulefact.plans import catalogue, queries_proofs, verdict, views, world
from rulefact.plans.registry import Tables
from rulefact.sources.durable import in_parts
from tests.test_oracle import SF


def plan(df):
    return df._jdf.queryExecution().toString()


def test_extraction_is_not_dealt_by_cluster_or_role(spark):
    reply = '{"entities": [], "facts": [{"predicate": "p", "args": [{"role": "order", "entity_id": "o1"}]}], "cluster_states": [{"entity_id": "c1", "cluster_name": "tier", "value": "f"}]}'
    rows = spark.createDataFrame([(1, reply)], "case_id long, x string").select("case_id", F.from_json("x", extract.PAYLOAD).alias("reply"))
    schemas = spark.createDataFrame([("tier", "CUSTOMER", ["F", "O"])], "cluster string, entity_type string, domain array<string>")
    facts, states = extract.extracted_facts(rows), extract.extracted_states(rows, schemas)
    entities = extract.extracted_entities(rows, facts, states, spark.createDataFrame([("ORDER", "ORDER")], "role string, entity_type string"))
    assert "hashpartitioning(cluster" not in plan(states) and "hashpartitioning(role" not in plan(entities)
    assert [r["entity_id"] for r in entities.orderBy("entity_id").collect()] == ["CUST1", "STORE1", "c1", "o1"]


def test_complete_facts_are_not_dealt_by_role(spark):
    args = spark.createDataFrame([(1, "p", "A"), (1, "p", "B"), (2, "p", "A")], "fact_id long, predicate string, role string")
    found = filters.complete_facts(args, spark.createDataFrame([("p", "A"), ("p", "B")], "predicate string, role string"))
    assert "BroadcastHashJoin [predicate" in plan(found)
    assert [tuple(r) for r in found.select("fact_id", "filled").collect()] == [(1, 2)]


def test_messages_are_not_dealt_by_relation(spark):
    nodes = spark.createDataFrame([(1, "fact", 1, [0.0, 0.0], False), (1, "c_t", 2, [0.0, 0.0], False)], "case_id long, node_type string, node_id long, logits array<double>, frozen boolean")
    args = spark.createDataFrame([(1, 1, "p", "A", 2)], "case_id long, fact_id long, predicate string, role string, entity_id long")
    edges = beliefs.support_edges(spark.createDataFrame([("p", "A", "t")], "predicate string, role string, cluster string"), args)
    weights = spark.createDataFrame([("fact", "supports:p:A", "c_t", 0, 0, 0.5, None)], "src_type string, relation string, dst_type string, i int, j int, w_pos double, w_neg_raw double")
    sent = beliefs.edge_messages(nodes, edges, weights)
    assert plan(sent).count("BroadcastHashJoin") >= 2
    assert [r["delta"] for r in sent.collect()] == [0.25]


def broken(spark):
    return spark.range(1).select(F.lit(1).cast("long").alias("case_id"), F.raise_error(F.lit("not asked for")).cast("string").alias("X"))


def test_statuses_need_asked_predicates_only(spark):
    p = spark.createDataFrame([(1, "a")], "case_id long, X string")
    facts = spark.createDataFrame([(1, 7, "p(X=a)", "candidate"), (1, 8, "p(X=b)", "candidate"), (1, 9, None, "candidate")], "case_id long, fact_id long, atom string, status string")
    out = verdict.updated_statuses(R.Model([], {"p": p, "q": broken(spark)}), facts)
    assert {r["fact_id"]: r["status"] for r in out.collect()} == {7: "proved", 8: "candidate", 9: "candidate"}


def test_external_atoms_are_sought_among_predicates_of_bodies(spark):
    rule = R.Rule("r", R.lit("h", X="A"), (R.lit("p", X="A"), R.naf("n", X="A")))
    model = R.evaluate({"p": spark.createDataFrame([(1, "a")], "case_id long, X string")}, [rule])
    asked, whole = [], model.atoms
    model.atoms = lambda only=None: asked.append(only) or whole(only)
    nodes, _ = views.proof_graph(model)
    assert {"p", "n"} in asked
    assert sorted((r["atom"], r["kind"]) for r in nodes.collect()) == [("h(X=a)", "derived"), ("n(X=a)", "external"), ("p(X=a)", "base")]


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(10).toDF("k")
    assert in_parts(df, 10, 3, "k").rdd.getNumPartitions() == 4 and in_parts(df, 10, 10, "k") is df
    t = Tables(spark, SF)
    monkeypatch.setattr(world, "LINES_EACH", 1000)
    n = -(-t.lineitem.count() // 1000)
    assert n > 4 and {p: f.rdd.getNumPartitions() for p, f in world.frames(t).items()} == dict.fromkeys(world.frames(t), n)


def test_rule_support_needs_its_heads_only(spark, monkeypatch):
    asked, whole = [], R.Model.atoms
    monkeypatch.setattr(R.Model, "atoms", lambda self, only=None: asked.append(only) or whole(self, only))
    catalogue.queries()["m12_rule_support"](spark, SF)
    assert asked == [{"late_return"}]


def test_lines_are_dealt_once_by_case_and_order(spark, monkeypatch):
    monkeypatch.setattr(world, "LINES_EACH", 1000)
    lines = world.frames(Tables(spark, SF))["line_shipped"]
    assert lines._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(case_id") == 1
    assert lines.count() == lines.distinct().count()


@pytest.mark.parametrize("name", ["j1_order_constraint", "j2_same_period", "j4_before", "j6_within_days_after", "j7_same_month", "j12_violation_report"])
def test_temporal_queries_deal_lines_to_their_own_partitions_only(spark, monkeypatch, name):
    monkeypatch.setattr(world, "LINES_EACH", 1000)
    n = -(-Tables(spark, SF).lineitem.count() // 1000)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        planned = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = re.findall(r"hashpartitioning\((.*), (\d+)\)", planned)
    by_line = {int(k) for keys, k in dealt if re.search("orderkey|ORDER|key#", keys)}
    assert by_line == {n}, dealt


def test_evaluation_collects_no_sets_and_is_written_once(spark, monkeypatch):
    p = spark.createDataFrame([(1, "a"), (1, "b")], "case_id long, X string")
    model = R.evaluate({"p": p, "n": p.where("X = 'b'")}, [R.Rule("r", R.lit("h", X="A"), (R.lit("p", X="A"), R.naf("n", X="A")))])
    asked = spark.createDataFrame([(1, k, "h", f"h(X={x})", "proved") for k, x in enumerate("abc")], "case_id long, query_id long, predicate string, atom string, expected string")
    out = views.evaluated(model, asked)
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["verdict"] for r in out.orderBy("query_id").collect()] == ["proved", "blocked", "not_proved"]
    written, durable = [], queries_proofs.durable
    monkeypatch.setattr(queries_proofs, "durable", lambda df, label: written.append(label) or durable(df, label))
    catalogue.queries()["p4_full_report"](spark, SF)
    assert written == ["evaluated"]
