"""A stratified model kept up to date while its facts change.

Of every rule the groundings of its positive body are kept, each with a flag for each negated literal that holds; an atom is
derived while a grounding of it has no flag. A change of facts touches only what it meets:

* a literal's rows that appear bring new groundings, joined from those rows outwards; rows that vanish take theirs with them;
* rows that appear or vanish under a negation change flags of the groundings they match;
* heads of these groundings, and no others, choose their proof anew; what thereby appears or vanishes is the change that the
  next group of predicates sees.

Recursive groups, and rules with a variable that nothing binds, are derived anew (deleted, then rederived), for the cases that a
change touches. Groups without a changed predicate are not evaluated at all. Tables are kept as the last ones written plus what
was taken out and put in; they are written as one every GATHER changes.

Rows with a null role are no atoms. Frames have the columns they had at the start. Where base frames have a `confidence`, a
grounding keeps that of each row it rests on (in v_CONF0 and so on), and a changed confidence is a changed row; heads have none.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.operators.temporal import HELPER_TESTS
from rulefact.plans.rules import CASE, GATHER, Const, Literal, Model, Rule, _any_flag, _best, _heads, _literal_frame, _union, _var, body_frame, evaluate, evaluation_order, flagged
from rulefact.sources.durable import durable


@dataclass
class Change:
    """Rows that appear and rows that vanish."""

    plus: DataFrame
    minus: DataFrame


def _lossy(x: Literal, frame: DataFrame) -> bool:
    """Whether several rows of a frame can match a literal in one way."""
    variables = [t for _, t in x.args if isinstance(t, str) and t != "_"]
    return len({role for role, t in x.args if t != "_"}) < len(frame.columns) - 1 or not variables


def _matches(x: Literal, frame: DataFrame) -> DataFrame:
    part = _literal_frame(x, frame)
    return part.distinct() if _lossy(x, frame) else part


def _matches_changed(x: Literal, change: Change, old: DataFrame, new: DataFrame) -> Change:
    """Ways to match a literal that appear (no row matched so before) and that vanish (no row does any more)."""
    plus, minus = _matches(x, change.plus), _matches(x, change.minus)
    if _lossy(x, change.plus):
        plus = plus.join(_literal_frame(x, old), plus.columns, "left_anti")
        minus = minus.join(_literal_frame(x, new), minus.columns, "left_anti")
    return Change(plus, minus)


def _free(rule: Rule) -> bool:
    bound = {v for x in rule.positives for v in x.variables}
    return not rule.positives or any(v not in bound for x in (rule.head, *rule.helpers, *rule.negatives) for v in x.variables)


def _grown(rule: Rule, k: int, rows: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Groundings whose k-th positive literal is matched by `rows`: the other literals join from there, connected ones first."""
    out, bound = rows, set(rule.positives[k].variables)
    left = [x for j, x in enumerate(rule.positives) if j != k]
    while left:
        x = next((y for y in left if bound & set(y.variables)), left[0])
        left.remove(x)
        out = out.join(_matches(x, frames[x.predicate]), [CASE, *(_var(v) for v in x.variables if v in bound)])
        bound |= set(x.variables)
    for x in rule.helpers:
        a, b = (F.lit(t.value) if isinstance(t, Const) else F.col(_var(t)) for _, t in x.args)
        test = HELPER_TESTS[x.predicate](a, b)
        out = out.where(~test if x.negated else test)
    return out


class Maintained:
    """frames: every predicate's rows; bodies: groundings with flags, per rule id; derived: atoms with their proof."""

    def __init__(self, base: dict[str, DataFrame], rules: list[Rule]):
        self.rules, self.order = list(rules), {r.rule_id: k for k, r in enumerate(rules)}
        heads = {r.head.predicate for r in rules}
        self.base = {p: self._whole(f.drop("confidence") if p in heads else f) for p, f in base.items()}
        #: The rules as their bodies are kept: with a variable for the confidence of each positive literal that has one.
        self.wide = {r.rule_id: r if _free(r) else replace(r, body=tuple(self._sure(k, x) for k, x in enumerate(r.body))) for r in rules}
        self.frames = dict(self.base)
        self.bodies: dict[str, DataFrame] = {}
        self.derived: dict[str, DataFrame] = {}
        #: Of the last change: groundings that appeared, per rule id, and heads that were decided anew, per predicate.
        self.grown: dict[str, DataFrame] = {}
        self.decided: dict[str, DataFrame] = {}
        self.age = 0
        self.groups = evaluation_order(self.rules)
        for group in self.groups:
            own = self._own(group)
            if self._recursive(group):
                self.derived |= self._rederived(own, self.frames, self.base)
            else:
                for r in own:
                    body = flagged(r, self._body(r, self.frames), self.frames)
                    self.bodies[r.rule_id] = self.grown[r.rule_id] = durable(body, "kept-body")
                for p in group:
                    self.derived[p] = durable(self._proved(p, None, self.base), f"kept-{p}")
            for p in group:
                new = self.derived[p].drop("proof")
                self.frames[p] = self.frames[p].unionByName(new) if p in self.frames else new
                self.decided[p] = new

    @staticmethod
    def _whole(frame: DataFrame) -> DataFrame:
        return frame.dropna()

    def _own(self, group: list[str]) -> list[Rule]:
        return [r for r in self.rules if r.head.predicate in group]

    def _roles(self, p: str) -> list[str]:
        return [role for role, _ in next(r for r in self.rules if r.head.predicate == p).head.args]

    def _recursive(self, group: list[str]) -> bool:
        return any(x.predicate in group for r in self._own(group) for x in r.positives)

    def _sure(self, k: int, x: Literal) -> Literal:
        has = not x.negated and x.predicate in self.base and "confidence" in self.base[x.predicate].columns
        return replace(x, args=(*x.args, ("confidence", f"CONF{k}"))) if has else x

    def _body(self, r: Rule, frames: dict[str, DataFrame]) -> DataFrame:
        if _free(r):
            return body_frame(r, {p: f.drop("confidence") for p, f in frames.items()}).distinct()
        body = body_frame(self.wide[r.rule_id], frames)
        return body.distinct() if any(_lossy(x, frames[x.predicate]) for x in self.wide[r.rule_id].positives) else body

    @staticmethod
    def _rederived(own: list[Rule], frames: dict[str, DataFrame], base: dict[str, DataFrame]) -> dict[str, DataFrame]:
        heads = {r.head.predicate for r in own}
        asked = {x.predicate for r in own for x in r.body if not x.is_helper}
        given = {p: f for p, f in frames.items() if p in asked and p not in heads} | {p: f for p, f in base.items() if p in heads}
        derived = evaluate(given, own).derived
        return {p: durable(derived[p], f"kept-{p}") for p in heads}

    def _proved(self, p: str, heads: DataFrame | None, base: dict[str, DataFrame]) -> DataFrame:
        """Derived atoms of p with their first proof, of the given heads (case_id and roles) only."""
        roles, parts = self._roles(p), []
        for r in self.rules:
            if r.head.predicate != p:
                continue
            body = self.bodies[r.rule_id].where(~_any_flag(r))
            if heads is not None:
                body = body.join(_literal_frame(r.head, heads), [CASE, *(_var(v) for v in r.head.variables)], "left_semi")
            parts.append(_heads(r, self.order[r.rule_id], body))
        out = _best(_union(parts), roles)
        return out.join(base[p].select(CASE, *roles), [CASE, *roles], "left_anti") if p in base else out

    def model(self) -> Model:
        return Model(self.rules, {p: f.drop("confidence") for p, f in self.base.items()}, dict(self.derived), {k: b for k, b in self.bodies.items() if any(r.rule_id == k and r.negatives for r in self.rules)})

    def update(self, plus: dict[str, DataFrame], minus: dict[str, DataFrame]) -> dict[str, Change]:
        """Takes changed base rows in; returns what appeared and vanished, by predicate. Only predicates with a change are in it."""
        old, changes = dict(self.frames), {}
        self.grown, self.decided, self.age = {}, {}, self.age + 1
        self.only_grew: set[str] = set()  # predicates that lost no grounding and no base row
        heads = {r.head.predicate for r in self.rules}
        moved: dict[str, Change] = {}
        for p in sorted({*plus, *minus}):
            roles = self.base[p].columns
            none = self.base[p].limit(0)
            inn = self._whole(plus[p].select(*roles)).distinct() if p in plus else none
            out = self._whole(minus[p].select(*roles)).distinct() if p in minus else none
            both = inn.join(out, roles, "left_semi") if p in plus and p in minus else none
            c = Change(durable(inn.join(self.base[p], roles, "left_anti"), "plus"), durable(out.join(both, roles, "left_anti").join(self.base[p], roles, "left_semi"), "minus") if p in minus else none)
            if c.plus.isEmpty() and c.minus.isEmpty():
                continue
            moved[p] = c
            self.base[p] = self._changed(self.base[p], c, roles)
            if p not in heads:
                changes[p] = c
                self.frames[p] = self.base[p]
        for group in self.groups:
            own = self._own(group)
            met = [r for r in own if any(x.predicate in changes for x in r.body)]
            if not met and not any(p in moved for p in group):
                continue
            decided = self._again(group, own, changes, moved) if self._recursive(group) else self._propagated(group, met, old, changes, moved)
            for p, (heads_of, now) in decided.items():
                roles = self._roles(p)
                keys = [CASE, *roles]
                was = old[p].join(heads_of, keys, "left_semi")
                here = now.drop("proof").select(*keys)
                if p in self.base:
                    here = here.unionByName(self.base[p].join(heads_of, keys, "left_semi").select(*keys))
                appeared = durable(here.join(was, keys, "left_anti"), "appeared")
                c = Change(appeared, appeared.limit(0) if p in self.only_grew else durable(was.join(here, keys, "left_anti"), "vanished"))
                self.derived[p] = self.derived[p].join(heads_of, keys, "left_anti").unionByName(now)
                self.decided[p] = heads_of
                if not (c.plus.isEmpty() and c.minus.isEmpty()):
                    changes[p] = c
                new = self.derived[p].drop("proof")
                self.frames[p] = self.base[p].select(*keys).unionByName(new.select(*keys)) if p in self.base else new
        if self.age % GATHER == 0:
            self._gather()
        return changes

    def _changed(self, frame: DataFrame, c: Change, keys: list[str]) -> DataFrame:
        return frame.join(c.minus, keys, "left_anti").unionByName(c.plus)

    def _gather(self) -> None:
        self.base = {p: durable(f, "kept") for p, f in self.base.items()}
        self.bodies = {k: durable(f, "kept-body") for k, f in self.bodies.items()}
        self.derived = {p: durable(f, "kept") for p, f in self.derived.items()}
        self.frames = dict(self.base)
        for p, f in self.derived.items():
            new = f.drop("proof")
            self.frames[p] = self.base[p].unionByName(new) if p in self.base else new

    def _touched(self, rules: list[Rule], changes: dict[str, Change]) -> DataFrame:
        asked = {x.predicate for r in rules for x in r.body}
        return durable(_union([f.select(CASE) for p, c in changes.items() if p in asked for f in (c.plus, c.minus)]).distinct(), "touched")

    def _again(self, group: list[str], own: list[Rule], changes: dict[str, Change], moved: dict[str, Change]) -> dict[str, tuple[DataFrame, DataFrame]]:
        """The group derived anew for the cases that the change touches: per predicate the heads to decide, and those that hold."""
        cases = self._touched(own, changes | {p: moved[p] for p in group if p in moved})
        here = lambda frames: {p: f.join(cases, CASE, "left_semi") for p, f in frames.items()}
        now = self._rederived(own, here(self.frames), here(self.base))
        out = {}
        for p in group:
            keys = [CASE, *self._roles(p)]
            heads = [self.derived[p].join(cases, CASE, "left_semi").select(*keys), now[p].select(*keys)]
            heads += [f.select(*keys) for f in (moved[p].plus, moved[p].minus)] if p in moved else []
            out[p] = durable(_union(heads).distinct(), "heads"), now[p]
        return out

    def _propagated(self, group: list[str], met: list[Rule], old: dict[str, DataFrame], changes: dict[str, Change], moved: dict[str, Change]) -> dict[str, tuple[DataFrame, DataFrame]]:
        heads: dict[str, list[DataFrame]] = {p: [] for p in group}
        self.only_grew |= {p for p in group if p not in moved}
        for r in met:
            out, inn, lost = self._body_change(r, old, changes)
            if out is None:
                continue
            names = [c for c in inn.columns if not c.startswith("holds_")]
            if lost:
                self.bodies[r.rule_id] = self.bodies[r.rule_id].join(out, names, "left_anti")
                self.only_grew.discard(r.head.predicate)
            self.bodies[r.rule_id] = self.bodies[r.rule_id].unionByName(inn)
            self.grown[r.rule_id] = inn
            of = [F.lit(t.value).alias(role) if isinstance(t, Const) else F.col(_var(t)).alias(role) for role, t in r.head.args]
            heads[r.head.predicate] += [f.select(CASE, *of) for f in ((out, inn) if lost else (inn,))]
        for p in group:
            if p in moved:
                heads[p] += [f.select(CASE, *self._roles(p)) for f in (moved[p].plus, moved[p].minus)]
        done = {}
        for p in group:
            if heads[p]:
                of = durable(_union(heads[p]).distinct(), "heads")
                done[p] = of, durable(self._proved(p, of, self.base), f"kept-{p}")
        return done

    def _body_change(self, r: Rule, old: dict[str, DataFrame], changes: dict[str, Change]) -> tuple[DataFrame | None, DataFrame | None, bool]:
        """Groundings that leave the kept table (and whether any does), and those that enter it, with flags; a changed flag is both."""
        kept = self.bodies[r.rule_id]
        names = [c for c in kept.columns if not c.startswith("holds_")]
        bare = kept.select(*names)
        if _free(r):
            cases = self._touched([r], changes)
            out = bare.join(cases, CASE, "left_semi")
            grown = self._body(r, {p: f.join(cases, CASE, "left_semi") for p, f in self.frames.items()})
        else:
            gone, stay, new = [], [], []
            for k, x in enumerate(self.wide[r.rule_id].positives):
                if x.predicate in changes:
                    c = _matches_changed(x, changes[x.predicate], old[x.predicate], self.frames[x.predicate])
                    keys = [CASE, *(_var(v) for v in x.variables)]
                    gone.append(bare.join(c.minus, keys, "left_semi"))
                    new.append(_grown(self.wide[r.rule_id], k, c.plus, self.frames).select(*names))
            for x in r.negatives:
                if x.predicate in changes:
                    c = _matches_changed(x, changes[x.predicate], old[x.predicate], self.frames[x.predicate])
                    keys = [CASE, *(_var(v) for v in x.variables)]
                    stay.append(bare.join(c.plus.unionByName(c.minus), keys, "left_semi"))
            out = _union([*gone, *stay]).distinct()
            back = _union(stay).distinct() if stay else None
            if back is not None and gone:
                back = back.join(_union(gone), names, "left_anti")
            grown = _union([*new, *([back] if back is not None else [])]).distinct() if new or back is not None else bare.limit(0)
        out, inn = durable(out, "out"), durable(flagged(r, grown, self.frames), "in")
        lost = not out.isEmpty()
        return (out, inn, lost) if lost or not inn.isEmpty() else (None, None, False)
