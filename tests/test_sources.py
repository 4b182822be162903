import pytest

from rulefact.operators import beliefs, changes, checks
from rulefact.sources import records as S


def test_case_texts_skip_blank_files(spark, tmp_path):
    (tmp_path / "TC-001.txt").write_text("Order placed 10 Jan.\nDelivered.")
    (tmp_path / "TC-002.txt").write_text("  \n\t")
    (tmp_path / "note.md").write_text("other")
    assert [tuple(r) for r in S.case_texts(spark, str(tmp_path)).collect()] == [("TC-001", "TC-001-TEXT", "Order placed 10 Jan.\nDelivered.")]


def test_query_csv_needs_its_columns_and_bears_a_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿case_id,query,expected_result\nc1,p(a),proved\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("case_id,query\nc1,p(a)\n")
    assert S.query_csv(spark, str(tmp_path / "a.csv")).collect()[0].case_id == "c1"
    with pytest.raises(ValueError, match="expected_result"):
        S.query_csv(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError):
        S.query_lines(spark, str(tmp_path / "a.csv"))


def test_a_file_without_its_round_is_an_error(spark):
    lines = spark.createDataFrame([('{"record_type": "fact", "payload": {"k": 1}}',), ("  ",), ('{"record_type": "odd"}',)], "value string")
    got, bad = S.read_mixed(lines, {"fact": "k int", "round": "r string"})
    assert [r.k for r in got["fact"].collect()] == [1] and bad.count() == 1 and got["round"].count() == 0
    with pytest.raises(ValueError, match="round"):
        S.read_mixed(lines, {"fact": "k int", "round": "r string"}, needed=("round",))


def test_fenced_and_broken_replies(spark):
    rows = spark.createDataFrame([(1, '```json\n{"a": "x"}\n```'), (2, '{"a": '), (3, "[1]"), (4, None)], "k int, line string")
    ok, bad = S.decoded(rows, "line", "a string")
    assert [(r.k, r.reply.a) for r in ok.collect()] == [(1, "x")] and sorted(r.k for r in bad.collect()) == [2, 3, 4]


def test_row_checks_name_what_failed(spark):
    x = spark.createDataFrame([(1, 0.5, "e", None, ["T", "F"]), (2, 1.5, None, None, ["T", "T"]), (3, None, "e", "l", ["T"])], "k int, c double, e string, l string, d array<string>")
    good, bad = checks.validate(x, {"range": checks.in_range("c", 0, 1), "one": checks.exactly_one("e", "l"), "domain": checks.all_different("d", 2)})
    assert [r.k for r in good.collect()] == [1]
    assert {r.k: r.failed for r in bad.collect()} == {2: ["domain", "one", "range"], 3: ["domain", "one"]}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 3.0)], "k int, s string, v double")
    once = changes.upsert(old, new, ["k"])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(once) == key(changes.upsert(once, new, ["k"]))
    assert {r.k: (r.s, r.v) for r in once.collect()} == {1: ("a", 1.0), 2: (None, 5.0), 3: ("c", 3.0)}
    assert {r.k: (r.s, r.v) for r in changes.upsert(old, new, ["k"], ["v"]).collect()} == {1: ("a", 1.0), 2: ("b", 5.0), 3: ("c", 3.0)}


def test_frozen_nodes_send_and_stay(spark):
    nodes = spark.createDataFrame([("c", "fact", "f", [10.0, -10.0, -10.0], True), ("c", "c_t", "e", [0.0, 0.0], False), ("c", "c_t", "g", [1.0, 0.0], False)], "case_id string, node_type string, node_id string, logits array<double>, frozen boolean")
    edges = spark.createDataFrame([("c", "fact", "f", "r", "c_t", "e")], "case_id string, src_type string, src_id string, relation string, dst_type string, dst_id string")
    weights = spark.createDataFrame([("fact", "r", "c_t", 0, 1, 2.0, None)], "src_type string, relation string, dst_type string, i int, j int, w_pos double, w_neg_raw double")
    bias = spark.createDataFrame([("c_t", 0, 0.5)], "node_type string, j int, b double")
    got = {r.node_id: r.logits for r in beliefs.step(nodes, beliefs.edge_messages(nodes, edges, weights), bias).collect()}
    assert got["f"] == [10.0, -10.0, -10.0]
    assert got["e"] == pytest.approx([0.5, 2.0], abs=1e-6) and got["g"] == pytest.approx([1.5, 0.0])  # the bias reaches all nodes of a touched type
    out, trace = beliefs.propagate(nodes, edges, weights, steps=2, top_k=3)
    assert trace.count() == 0 and out.count() == 3
