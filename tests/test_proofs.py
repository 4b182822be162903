"""Proof runs with fact ids, original values and span texts; pairing of repeated steps."""

from pyspark.sql import functions as F

from rulefact.plans import proofs as P
from rulefact.plans import rules as R


def test_a_run_names_facts_and_texts(spark):
    f = lambda rows, roles: spark.createDataFrame([("c", *r) for r in rows], "case_id string, " + ", ".join(f"{r} string" for r in roles))
    base = {"placed": f([("o1",), ("o2",)], ["ORDER"]), "paid": f([("o1", "d_2026_01_10")], ["ORDER", "DATE"])}
    rules = [R.Rule("r1", R.lit("due", ORDER="O"), (R.lit("placed", ORDER="O"), R.lit("paid", ORDER="O", DATE="D"), R.naf("gone", ORDER="O"))), R.Rule("r2", R.lit("kept", ORDER="O"), (R.lit("due", ORDER="O"), R.lit("placed", ORDER="O")))]
    facts = spark.createDataFrame([("c", "f9", "placed(ORDER=o1)", "s1", [(3, 8)]), ("c", "f1", "placed(ORDER=o1)", "s1", [(0, 2), (5, 6)]), ("c", "f2", "placed(ORDER=o2)", None, None), ("c", "f3", None, "s1", [(0, 1)])], "case_id string, fact_id string, atom string, source_id string, spans array<struct<start:int,end:int>>")
    sources = spark.createDataFrame([("s1", "Żółw idzie")], "source_id string, content string")
    texts = spark.createDataFrame([("r1", "rule one")], "rule_id string, source_span_text string")
    names = spark.createDataFrame([("o1", "O-1"), ("d_2026_01_10", "10 Jan, 2026=")], "normalized string, original string")
    asked = spark.createDataFrame([("c", "kept(ORDER=o1)"), ("c", "kept(ORDER=o2)"), ("c", "placed(ORDER=o1)"), ("z", "kept(ORDER=o1)")], "case_id string, atom string")
    runs, steps = P.proof_store(R.evaluate(base, rules), asked, facts, sources, texts, names)
    assert sorted((r.case_id, r.result, r.n_queries, r.n_steps) for r in runs.collect()) == [("c", "proved", 3, 4), ("z", "not_proved", 1, 0)]
    got = {r.step_order: r for r in steps.collect()}
    assert [got[k].atom for k in range(4)] == ["paid(DATE=d_2026_01_10,ORDER=o1)", "placed(ORDER=o1)", "due(ORDER=o1)", "kept(ORDER=o1)"]
    assert got[1].source_span_text == "Żó" and got[0].source_span_text is None and got[2].source_span_text == "rule one"
    assert got[2].used_fact_ids == ["f1", ""] and got[2].naf_checked == ["gone(ORDER=o1)"] and got[3].used_fact_ids == ["", "f1"]
    assert got[2].substitution == "D=10 Jan, 2026=,O=O-1" and got[0].substitution is None and got[0].status == "base"


def test_repeated_steps_take_atoms_in_turn(spark):
    steps = spark.createDataFrame([("p", 0, "r", "A=1,B=2"), ("p", 1, "r", "B=2,A=1"), ("p", 2, None, None), ("p", 3, "r", "A=1,B=2"), ("q", 0, "r", "A=1,B=2")], "proof_id string, step_order int, rule_id string, substitution string")
    dag = spark.createDataFrame([("p", 5, "x", "r", "A=1,B=2", "derived", None), ("p", 4, "y", "r", "A=1,B=2", "derived", "t"), ("p", 1, "z", None, "", "base", None), ("p", 9, "w", "r", "A=1", "derived", None)], "proof_id string, ord int, atom string, rule_id string, substitution string, status string, source_span_text string")
    got = {(r.proof_id, r.step_order): (r.atom, r.source_span_text) for r in P.paired_steps(steps, dag).collect()}
    assert got == {("p", 0): ("y", "t"), ("p", 1): ("x", None), ("p", 2): ("z", None), ("p", 3): (None, None), ("q", 0): (None, None)}


def stored(spark, base, rules, asked):
    facts = spark.createDataFrame([], "case_id long, fact_id string, atom string, source_id string, spans array<struct<start:int,end:int>>")
    none = spark.createDataFrame([], "source_id string, content string"), spark.createDataFrame([], "rule_id string, source_span_text string"), spark.createDataFrame([], "normalized string, original string")
    _, steps = P.proof_store(R.evaluate(base, rules), spark.createDataFrame([(1, a) for a in asked], "case_id long, atom string"), facts, *none)
    return [(r.atom, r.status) for r in steps.orderBy("step_order").collect()]


def test_a_run_takes_the_atoms_of_asked_predicates_only(spark, monkeypatch):
    frame = lambda rows, roles: spark.createDataFrame([(1, *r) for r in rows], "case_id long, " + roles)
    broken = spark.range(1).select(F.lit(1).cast("long").alias("case_id"), F.raise_error(F.lit("not asked for")).cast("string").alias("X"))
    rules = [R.Rule("r", R.lit("h", X="A"), (R.lit("p", X="A"), R.naf("n", X="A")))]
    taken, whole = [], R.Model.atoms
    monkeypatch.setattr(R.Model, "atoms", lambda self, only=None: taken.append(only) or whole(self, only))
    got = stored(spark, {"p": frame([("a",), ("b",)], "X string"), "q": broken}, rules, ["h(X=a)", "h(X=z)"])
    assert got == [("p(X=a)", "base"), ("h(X=a)", "derived")] and taken == [{"h"}]


def test_a_run_leaves_out_atoms_that_stand_for_several(spark):
    p = spark.createDataFrame([(1, "a", "b")], "case_id long, X string, Y string")
    rules = [R.Rule("r", R.lit("h", X="A"), (R.lit("p", X="A", Y="_"),)), R.Rule("s", R.lit("g", X="A"), (R.lit("h", X="A"), R.lit("p", X="A", Y="B")))]
    assert stored(spark, {"p": p}, rules, ["g(X=a)"]) == [("h(X=a)", "derived"), ("p(X=a,Y=b)", "base"), ("g(X=a)", "derived")]


def test_a_run_follows_recursion(spark):
    e = spark.createDataFrame([(1, k, k + 1) for k in range(5)], "case_id long, F long, T long")
    rules = [R.Rule("r", R.lit("way", F="X", T="Y"), (R.lit("e", F="X", T="Y"),)), R.Rule("s", R.lit("way", F="X", T="Z"), (R.lit("way", F="X", T="Y"), R.lit("e", F="Y", T="Z")))]
    got = stored(spark, {"e": e}, rules, ["way(F=0,T=5)"])
    assert got[-1] == ("way(F=0,T=5)", "derived") and sorted(a for a, _ in got) == sorted([f"e(F={k},T={k + 1})" for k in range(5)] + [f"way(F=0,T={k})" for k in range(1, 6)])
    assert [a for a, s in got if s == "derived"] == [f"way(F=0,T={k})" for k in range(1, 6)]


def test_runs_alone_are_those_of_the_store(spark, monkeypatch):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "case_id long, X string")
    model = R.evaluate({"p": p}, [R.Rule("r", R.lit("h", X="A"), (R.lit("p", X="A"),))])
    asked = spark.createDataFrame([(1, "h(X=a)"), (1, "h(X=b)"), (1, "h(X=b)"), (2, "h(X=z)"), (3, "p(X=a)")], "case_id long, atom string")
    written, durable = [], P.durable
    monkeypatch.setattr(P, "durable", lambda df, label: written.append(label) or durable(df, label))
    got = sorted((r.case_id, r.result, r.n_queries, r.n_steps) for r in P.proof_runs(model, asked).collect())
    assert got == [(1, "proved", 2, 4), (2, "not_proved", 1, 0), (3, "not_proved", 1, 0)] and written == ["proof-level"]
