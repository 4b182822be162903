"""A model maintained under changes equals the model evaluated anew, on random programs and random changes."""

import random

import pytest

from rulefact.plans import loop
from rulefact.plans import rules as R
from rulefact.plans.incremental import Maintained

BASE = {"a": ("X", "Y"), "b": ("X", "Y"), "c": ("X",), "d": ("X", "Y"), "p": ("X",)}
VALUES = ["u", "v", "w", "x"]


def frames(spark, facts):
    return {p: spark.createDataFrame(sorted(facts[p]), "case_id long, " + ", ".join(f"{r} string" for r in roles)) for p, roles in BASE.items()}


def drawn(r, p):
    return (r.randrange(3), *(r.choice(VALUES) for _ in BASE[p]))


PROGRAMS = {
    "negation over two groups": [
        R.Rule("r1", R.lit("p", X="A"), (R.lit("a", X="A", Y="B"), R.naf("b", X="B", Y="_"))),
        R.Rule("r2", R.lit("p", X="A"), (R.lit("c", X="A"), R.lit("d", X="A", Y="_"))),
        R.Rule("r3", R.lit("q", X="A", Y="B"), (R.lit("p", X="A"), R.lit("d", X="A", Y="B"), R.naf("p", X="B"), R.naf("c", X="B"))),
        R.Rule("r4", R.lit("s", X="A"), (R.lit("q", X="A", Y="A"),)),
        R.Rule("r5", R.lit("s", X="A"), (R.lit("c", X="A"), R.naf("q", X="A", Y="_"))),
    ],
    "recursion, constants, free variables": [
        R.Rule("r1", R.lit("t", X="A", Y="B"), (R.lit("a", X="A", Y="B"), R.naf("c", X="A"))),
        R.Rule("r2", R.lit("t", X="A", Y="C"), (R.lit("t", X="A", Y="B"), R.lit("a", X="B", Y="C"))),
        R.Rule("r3", R.lit("far", X="A"), (R.lit("t", X="A", Y=R.Const("u")), R.naf("b", X="A", Y="A"))),
        R.Rule("r4", R.lit("pair", X="A", Y="B"), (R.lit("far", X="A"), R.naf("t", X="A", Y="B"))),
        R.Rule("r5", R.lit("p", X="A"), (R.lit("pair", X="A", Y="_"), R.lit("d", X="A", Y="_"))),
    ],
}


def model_of(m):
    return sorted((p, *map(str, x)) for p, d in m.derived.items() for x in d.select("case_id", *sorted(c for c in d.columns if c not in ("case_id", "proof")), "proof.rule_id", "proof.substitution").collect())


@pytest.mark.parametrize("name", PROGRAMS)
def test_equals_full_evaluation(spark, name):
    r, rules = random.Random(len(name)), PROGRAMS[name]
    facts = {p: {drawn(r, p) for _ in range(9)} for p in BASE}
    kept = Maintained(frames(spark, facts), rules)
    assert model_of(kept.model()) == model_of(R.evaluate(frames(spark, facts), rules))
    for turn in range(2):
        plus, minus = {p: set() for p in BASE}, {p: set() for p in BASE}
        for _ in range(4 if turn else 1):
            p = r.choice(list(BASE))
            (plus if r.random() < 0.5 else minus)[p].add(drawn(r, p))
        for p in r.sample(list(BASE), 2 if turn else 1):
            minus[p] |= set(r.sample(sorted(facts[p]), min(2, len(facts[p]))))
        changed = {p for p in BASE if plus[p] or minus[p]}
        kept.update({p: f for p, f in frames(spark, plus).items() if p in changed}, {p: f for p, f in frames(spark, {q: minus[q] - plus[q] for q in BASE}).items() if p in changed})
        facts = {p: (facts[p] - (minus[p] - plus[p])) | plus[p] for p in BASE}
        assert model_of(kept.model()) == model_of(R.evaluate(frames(spark, facts), rules))


def test_only_what_changed_is_evaluated(spark):
    r, rules = random.Random(1), PROGRAMS["negation over two groups"]
    facts = {p: {drawn(r, p) for _ in range(9)} for p in BASE}
    kept = Maintained(frames(spark, facts), rules)
    same = sorted(facts["a"])[:2]
    assert kept.update({"a": spark.createDataFrame(same, "case_id long, X string, Y string")}, {}) == {} and not kept.decided
    changes = kept.update({"d": spark.createDataFrame([(2, "zz", "zy")], "case_id long, X string, Y string")}, {})
    assert set(changes) == {"d"} and set(kept.grown) <= {"r2", "r3"}  # no c(zz), so nothing follows
    changes = kept.update({"c": spark.createDataFrame([(2, "zz")], "case_id long, X string")}, {})
    assert {"c", "p", "q"} <= set(changes)
    assert {x.case_id for c in changes.values() for f in (c.plus, c.minus) for x in f.collect()} == {2}


def test_rounds_feed_back(spark):
    """A proved fact makes rows that a later round derives from; a candidate refuted by a later fact is judged again."""
    base = {"order": spark.createDataFrame([(1, "o1", 0.9), (1, "o2", 0.9), (2, "o3", 0.9)], "case_id long, ORDER string, confidence double"),
            "open": spark.createDataFrame([(1, "o2", 1.0)], "case_id long, ORDER string, confidence double")}
    late = R.Rule("r_late", R.lit("late", ORDER="O"), (R.lit("order", ORDER="O"), R.naf("open", ORDER="O")))
    watch = R.Rule("r_watch", R.lit("watch", ORDER="O"), (R.lit("told_late", ORDER="O"),))
    calm = R.Rule("r_calm", R.lit("calm", ORDER="O"), (R.lit("order", ORDER="O"), R.naf("told_late", ORDER="O")))

    def told_of(facts):
        return {"told_late": facts.where("status = 'proved' AND atom LIKE 'late(%'").selectExpr("case_id", "regexp_extract(atom, 'ORDER=(\\\\w+)', 1) AS ORDER", "confidence")}

    start = spark.createDataFrame([(2, "f1", "LATE", "late(ORDER=o3)", "candidate", "T", 0.8), (2, "f2", "SEEN", "seen(ORDER=o3)", "candidate", "T", 0.8), (2, "f3", "SEEN", "seen(ORDER=o4)", "rejected", "F", 0.1)], loop.FACT)
    facts, model = loop.refine([late, watch, calm], base, told_of, start, rounds=5)
    got = {(x.case_id, x.atom): (x.status, x.value) for x in facts.collect()}
    assert got == {
        (1, "late(ORDER=o1)"): ("proved", "T"), (1, "late(ORDER=o2)"): ("rejected", "F"), (2, "late(ORDER=o3)"): ("proved", "T"),
        (1, "watch(ORDER=o1)"): ("proved", "T"), (2, "watch(ORDER=o3)"): ("proved", "T"),
        (1, "calm(ORDER=o1)"): ("proved", "T"), (1, "calm(ORDER=o2)"): ("proved", "T"), (2, "calm(ORDER=o3)"): ("proved", "T"),
        (2, "seen(ORDER=o3)"): ("candidate", "T"), (2, "seen(ORDER=o4)"): ("rejected", "F"),
    }
    assert [x.ORDER for x in model.derived["calm"].collect()] == ["o2"]
