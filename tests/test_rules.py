"""Rule evaluation, verdicts, proofs and constraints on small cases."""

import datetime
import random

import pytest

from rulefact.operators import temporal
from rulefact.plans import rules as R
from rulefact.plans import verdict as V

ROLES = {"order_placed": ["ORDER"], "ab_can_withdraw": ["CUSTOMER", "ORDER"], "can_withdraw": ["CUSTOMER", "ORDER"]}


def frame(spark, rows, *roles):
    return spark.createDataFrame([("case1", *r) for r in rows], "case_id string, " + ", ".join(f"{r} string" for r in roles))


def withdraw(spark):
    base = {"order_placed": frame(spark, [("o1",), ("o2",)], "ORDER"), "customer": frame(spark, [("c1",)], "CUSTOMER"), "ab_can_withdraw": frame(spark, [("c1", "o1")], "CUSTOMER", "ORDER")}
    rule = R.Rule("r_can_withdraw", R.lit("can_withdraw", CUSTOMER="C", ORDER="O"), (R.lit("customer", CUSTOMER="C"), R.lit("order_placed", ORDER="O"), R.naf("ab_can_withdraw", CUSTOMER="C", ORDER="O")), 1)
    return base, rule


def asked(spark, *atoms):
    return spark.createDataFrame([("case1", k, a.split("(")[0], a) for k, a in enumerate(atoms)], "case_id string, query_id int, predicate string, atom string")


def test_blocked_candidate_names_the_exception(spark):
    base, rule = withdraw(spark)
    m = R.evaluate(base, [rule])
    v = {r.query_id: r for r in V.verdicts(m, asked(spark, "can_withdraw(CUSTOMER=c1,ORDER=o1)", "can_withdraw(CUSTOMER=c1,ORDER=o2)", "can_withdraw(CUSTOMER=c9,ORDER=o2)", "refund(ORDER=o1)", "order_placed(ORDER=o1)")).collect()}
    assert [v[k].verdict for k in range(5)] == ["blocked", "proved", "not_proved", "unknown", "proved"]
    assert v[0].violated == ["ab_can_withdraw(CUSTOMER=c1,ORDER=o1)"] and v[0].rule_ids == ["r_can_withdraw"]
    assert v[1].proved_by == "r_can_withdraw" and v[4].proved_by is None


def test_wildcard_negation_blocks_on_any_value(spark):
    base = {"agreement": frame(spark, [("c1", "p1"), ("c1", "p2")], "CUSTOMER", "PRODUCT"), "returned": frame(spark, [("p1", "c1", "d_2026_01_10")], "PRODUCT", "CUSTOMER", "DATE")}
    rule = R.Rule("r_cost", R.lit("bears_cost", CUSTOMER="C", PRODUCT="P"), (R.lit("agreement", CUSTOMER="C", PRODUCT="P"), R.naf("returned", PRODUCT="P", CUSTOMER="C", DATE="_")))
    assert [r.PRODUCT for r in R.evaluate(base, [rule]).derived["bears_cost"].collect()] == ["p2"]


def test_constants_and_repeated_variables(spark):
    base = {"e": frame(spark, [("a", "a"), ("a", "b"), ("b", "b")], "X", "Y")}
    loop = R.Rule("r1", R.lit("loop", X="A"), (R.lit("e", X="A", Y="A"),))
    from_a = R.Rule("r2", R.lit("from_a", Y="B"), (R.lit("e", X=R.Const("a"), Y="B"),))
    m = R.evaluate(base, [loop, from_a])
    assert sorted(r.X for r in m.derived["loop"].collect()) == ["a", "b"]
    assert sorted(r.Y for r in m.derived["from_a"].collect()) == ["a", "b"]


def test_cycles_reach_a_fixpoint_equal_to_the_closure(spark):
    r = random.Random(5)
    edges = {(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(16)}
    closure = set(edges)
    while more := {(a, d) for a, b in closure for c, d in edges if b == c} - closure:
        closure |= more
    rules = [R.Rule("r1", R.lit("path", X="A", Y="B"), (R.lit("edge", X="A", Y="B"),)), R.Rule("r2", R.lit("path", X="A", Y="C"), (R.lit("path", X="A", Y="B"), R.lit("edge", X="B", Y="C")))]
    got = R.evaluate({"edge": frame(spark, sorted(edges), "X", "Y")}, rules).derived["path"].collect()
    assert {(x.X, x.Y) for x in got} == closure and len(got) == len(closure)


def test_negation_in_a_cycle_is_an_error():
    rules = [R.Rule("a", R.lit("p", X="X"), (R.lit("n", X="X"), R.naf("q", X="X"))), R.Rule("b", R.lit("q", X="X"), (R.lit("p", X="X"),))]
    with pytest.raises(R.RuleError):
        R.evaluation_order(rules)


def test_declared_strata():
    x = R.lit("n", X="X")
    rules = [R.Rule("r_a", R.lit("a", X="X"), (x,), 1), R.Rule("r_b", R.lit("b", X="X"), (x, R.naf("a", X="X")), 1), R.Rule("r_c", R.lit("a", X="X"), (x,), 2), R.Rule("r_d", R.lit("d", X="X"), (R.lit("b", X="X"),), 0)]
    assert R.stratification_violations(rules) == [("r_b", "negated a is not below the head"), ("r_c", "head predicate has several strata"), ("r_d", "b is above the head")]
    assert R.stratification_violations([rules[0], R.Rule("ok", R.lit("c", X="X"), (x, R.naf("a", X="X")), 2)]) == []


def test_large_domains_are_an_error_not_a_cut(spark):
    base = {"n": frame(spark, [(f"v{k}",) for k in range(30)], "X")}
    free = R.Rule("r", R.lit("p", X="X", Y="Y"), (R.lit("n", X="X"),))
    assert R.evaluate(base, [free]).derived["p"].count() == 900
    with pytest.raises(Exception, match="domain of case too large"):
        R.body_frame(free, base, domain_limit=10).collect()


def test_chains_of_more_than_a_hundred_rounds(spark):
    n = 102
    base = {"start": frame(spark, [("n0",)], "X"), "edge": frame(spark, [(f"n{k}", f"n{k + 1}") for k in range(n)], "X", "Y")}
    rules = [R.Rule("r1", R.lit("reach", X="A"), (R.lit("start", X="A"),)), R.Rule("r2", R.lit("reach", X="B"), (R.lit("reach", X="A"), R.lit("edge", X="A", Y="B")))]
    m = R.evaluate(base, rules)
    assert sorted(r.X for r in m.derived["reach"].collect()) == sorted(f"n{k}" for k in range(n + 1))
    steps = {r.atom: r for r in V.proof_steps(m, asked(spark, f"reach(X=n{n})")).collect()}
    assert len(steps) == 2 * n + 2 and steps["start(X=n0)"].depth == n + 1
    assert all(steps[f"reach(X=n{k})"].step < steps[f"reach(X=n{k + 1})"].step for k in range(n))


def test_a_thousand_links_take_few_rounds(spark, monkeypatch):
    from rulefact.operators import paths

    n, rounds, take = 1000, [], paths._squared
    monkeypatch.setattr(paths, "_squared", lambda *x: (rounds.append(1), take(*x))[1])
    base = {"start": frame(spark, [("n0",)], "X"), "edge": frame(spark, [(f"n{k}", f"n{k + 1}") for k in range(n)], "X", "Y")}
    rules = [R.Rule("r1", R.lit("reach", X="A"), (R.lit("start", X="A"),)), R.Rule("r2", R.lit("reach", X="B"), (R.lit("reach", X="A"), R.lit("edge", X="A", Y="B")))]
    m = R.evaluate(base, rules)
    proofs = {r.X: r.proof for r in m.derived["reach"].collect()}
    assert len(rounds) <= 11 and len(proofs) == n + 1
    assert all(proofs[f"n{k + 1}"].pos_atoms == [f"reach(X=n{k})", f"edge(X=n{k},Y=n{k + 1})"] for k in range(n))


def test_strides_equal_the_loop(spark, monkeypatch):
    """Random graphs with branches and cycles, carried roles, two recursive rules, negation and a constant: the same atoms and proofs."""
    r = random.Random(11)
    some = lambda n, k: sorted({tuple(f"n{r.randrange(k)}" for _ in range(2)) for _ in range(n)})
    base = {"edge": frame(spark, some(30, 20), "X", "Y"), "hop": frame(spark, some(8, 20), "X", "Y"), "shut": frame(spark, [("n3",), ("n7",)], "X"), "path": frame(spark, some(2, 20), "X", "Y")}
    rules = [
        R.Rule("r1", R.lit("path", X="A", Y="B"), (R.lit("edge", X="A", Y="B"),)),
        R.Rule("r2", R.lit("path", X="A", Y="C"), (R.lit("path", X="A", Y="B"), R.lit("edge", X="B", Y="C"), R.naf("shut", X="B"))),
        R.Rule("r3", R.lit("path", X="A", Y="C"), (R.lit("hop", X="B", Y="C"), R.lit("path", X="A", Y="B"))),
        R.Rule("r4", R.lit("walk", X="A"), (R.lit("shut", X="A"),)),
        R.Rule("r5", R.lit("walk", X="B"), (R.lit("walk", X="A"), R.lit("path", X="A", Y="B"))),
    ]
    got = lambda m: sorted((p, *x[:-1], x.proof.rule_id, x.proof.substitution, *x.proof.pos_atoms) for p in ("path", "walk") for x in m.derived[p].collect())
    by_strides = got(R.evaluate(base, rules))
    monkeypatch.setattr(R, "_linear", lambda *x: None)
    assert by_strides == got(R.evaluate(base, rules)) and len(by_strides) > 100


def test_longest_ways(spark):
    from rulefact.operators.paths import reached

    r = random.Random(3)
    edges = sorted({(a, b) for _ in range(45) for a, b in [sorted(r.sample(range(22), 2))] if a != b})
    far = {0: 0}
    for a in range(22):
        for x, y in edges:
            if x == a and a in far:
                far[y] = max(far.get(y, 0), far[a] + 1)
    e = spark.createDataFrame([(1, a, b) for a, b in edges] + [(2, 0, 5), (1, None, 3)], "g int, s_n int, t_n int")
    start = spark.createDataFrame([(1, "q", 0, 0), (1, "q", 0, 0), (3, "q", 0, 0)], "g int, of string, n int, d int")
    for dense in (0, 4, 1000):
        got = reached(start, e, ["g"], ["n"], longest=True, dense=dense).collect()
        assert {x.n: x.d for x in got if x.g == 1} == far and len(got) == len(far) + 1 and all(x.of == "q" for x in got)


def test_free_variables_range_over_more_than_a_thousand_constants(spark):
    base = {"n": frame(spark, [(f"v{k}",) for k in range(1100)], "X")}
    free = R.Rule("r", R.lit("p", X="X", Y="Y"), (R.lit("n", X="X"),))
    got = R.body_frame(free, base)
    assert got.count() == got.distinct().count() == 1100 * 1100


def test_proof_steps_put_dependencies_first(spark):
    base = {"edge": frame(spark, [("a", "b"), ("b", "c"), ("c", "d")], "X", "Y")}
    rules = [R.Rule("r1", R.lit("path", X="A", Y="B"), (R.lit("edge", X="A", Y="B"),)), R.Rule("r2", R.lit("path", X="A", Y="C"), (R.lit("path", X="A", Y="B"), R.lit("edge", X="B", Y="C")))]
    m = R.evaluate(base, rules)
    steps = {r.atom: r.step for r in V.proof_steps(m, asked(spark, "path(X=a,Y=d)")).collect()}
    for e in V.proof_edges(m).where("kind = 'pos'").collect():
        if e.atom in steps:
            assert steps[e.depends_on] < steps[e.atom]
    assert max(steps, key=steps.get) == "path(X=a,Y=d)" and len(steps) == 6


def test_statuses_and_new_facts(spark):
    base, rule = withdraw(spark)
    m = R.evaluate(base, [rule])
    facts = spark.createDataFrame([("case1", "f1", "can_withdraw(CUSTOMER=c1,ORDER=o2)", "candidate"), ("case1", "f2", "can_withdraw(CUSTOMER=c1,ORDER=o1)", "candidate"), ("case1", "f3", "order_placed(ORDER=o1)", "rejected")], "case_id string, fact_id string, atom string, status string")
    got = {r.fact_id: r for r in V.updated_statuses(m, facts).collect()}
    assert (got["f1"].status, got["f2"].status, got["f3"].status) == ("proved", "candidate", "rejected")
    assert got["f1"].proof_id and not got["f2"].proof_id
    assert V.new_facts(m, facts).count() == 0
    fresh = V.new_facts(m, facts.where("fact_id = 'f2'")).collect()
    assert [(r.predicate, r.atom, r.confidence) for r in fresh] == [("CAN_WITHDRAW", "can_withdraw(CUSTOMER=c1,ORDER=o2)", 1.0)]


def test_date_helpers_and_constraints(spark):
    d = datetime.date
    rows = [("case1", "o1", d(2026, 1, 10), d(2026, 1, 15)), ("case1", "o2", d(2026, 1, 10), d(2026, 1, 10)), ("case1", "o3", d(2026, 1, 10), d(2026, 1, 9)), ("case1", "o4", d(2025, 12, 29), d(2026, 1, 1)), ("case1", "o5", d(2026, 1, 1), d(2026, 1, 20))]
    x = spark.createDataFrame(rows, "case_id string, ORDER string, A date, B date")
    frames = {"placed": x.selectExpr("case_id", "ORDER", "A AS DATE"), "back": x.selectExpr("case_id", "ORDER", "B AS DATE")}
    ends = {"earlier": ("placed", "ORDER", "DATE"), "later": ("back", "ORDER", "DATE")}
    broken = lambda **k: sorted(r.key for r in temporal.violations(frames, [temporal.Constraint("c", **k, **ends)]).collect())
    assert broken(kind="order") == ["o3"]  # equal dates are fine
    assert broken(kind="window", days=14) == ["o3", "o5"]
    assert broken(kind="same", period="week") == ["o1", "o5"]  # the ISO week runs over the year's end
    assert broken(kind="same", period="year") == ["o4"]
    bound, missing = temporal.bind([temporal.Constraint("a", "order", **ends), temporal.Constraint("b", "order", ("paid", "ORDER", "DATE"), ends["later"])], set(frames))
    assert [c.name for c in bound] == ["a"] and missing == [("b", "paid")]
    assert "within_7_days" in temporal.HELPER_TESTS and "within_x_days" not in temporal.HELPER_TESTS
