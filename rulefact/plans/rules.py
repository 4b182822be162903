"""Rules as data, and their compilation to joins.

A rule is a head and a body of literals over predicates; a predicate's extension is a DataFrame with case_id and one column per
role. Positive literals become equi-joins on case_id and shared variables, negated ones anti-joins on case_id and the bound
roles, date helpers conditions on the two bound columns. All cases are evaluated at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefact.functions.scalars import atom_key
from rulefact.operators.paths import reached
from rulefact.operators.temporal import HELPER_TESTS
from rulefact.sources.durable import durable

CASE = "case_id"
#: Constants of a case that meet its rows at once; rounds after which the tables of a loop are written as one.
DOMAIN_BLOCK, GATHER = 1000, 20
PROOF = "struct<rule_order:int,substitution:string,rule_id:string,pos_atoms:array<string>,naf_atoms:array<string>>"


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Literal:
    """predicate with (role, term) pairs; a term is a variable's name, `_` for any value, or a Const."""

    predicate: str
    args: tuple[tuple[str, object], ...]
    negated: bool = False

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for _, t in self.args if isinstance(t, str) and t != "_"))

    @property
    def is_helper(self) -> bool:
        return self.predicate in HELPER_TESTS


def lit(predicate: str, **args: object) -> Literal:
    return Literal(predicate, tuple(args.items()))


def naf(predicate: str, **args: object) -> Literal:
    return Literal(predicate, tuple(args.items()), negated=True)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    head: Literal
    body: tuple[Literal, ...]
    stratum: int | None = None
    weight: float = 1.0

    @property
    def positives(self) -> list[Literal]:
        return [x for x in self.body if not x.negated and not x.is_helper]

    @property
    def negatives(self) -> list[Literal]:
        return [x for x in self.body if x.negated and not x.is_helper]

    @property
    def helpers(self) -> list[Literal]:
        return [x for x in self.body if x.is_helper]


class RuleError(ValueError):
    pass


def stratification_violations(rules: list[Rule]) -> list[tuple[str, str]]:
    """Declared strata: one per head predicate, positive bodies not above the head, negated ones below; predicates without
    rules are free. Returns (rule_id, problem)."""
    of: dict[str, int] = {}
    found = []
    for r in rules:
        s = r.stratum or 0
        if of.setdefault(r.head.predicate, s) != s:
            found.append((r.rule_id, "head predicate has several strata"))
    for r in rules:
        s = r.stratum or 0
        for x in r.body:
            if x.predicate in of:
                if x.negated and of[x.predicate] >= s:
                    found.append((r.rule_id, f"negated {x.predicate} is not below the head"))
                elif not x.negated and of[x.predicate] > s:
                    found.append((r.rule_id, f"{x.predicate} is above the head"))
    return sorted(set(found))


def evaluation_order(rules: list[Rule]) -> list[list[str]]:
    """Head predicates in groups that depend on each other, after all they depend on. A group that negates itself is an error."""
    heads = list(dict.fromkeys(r.head.predicate for r in rules))
    needs = {h: {x.predicate for r in rules if r.head.predicate == h for x in r.body if x.predicate in heads} for h in heads}
    reach = {h: set(needs[h]) for h in heads}
    changed = True
    while changed:
        changed = False
        for h in heads:
            more = set().union(*(reach[x] for x in reach[h])) - reach[h] if reach[h] else set()
            if more:
                reach[h] |= more
                changed = True
    groups: list[list[str]] = []
    left = list(heads)
    while left:
        for h in left:
            group = [x for x in left if x == h or (x in reach[h] and h in reach[x])]
            if all(x in group or x not in left for g in group for x in needs[g]):
                break
        else:
            raise RuleError("no order of evaluation")
        for r in rules:
            if r.head.predicate in group and any(x.predicate in group for x in r.negatives):
                raise RuleError(f"{r.rule_id}: negation inside the recursion of {', '.join(group)}")
        groups.append(group)
        left = [x for x in left if x not in group]
    return groups


def _var(name: str) -> str:
    return f"v_{name}"


def _literal_frame(x: Literal, frame: DataFrame) -> DataFrame:
    """The rows that match a literal, as case_id and one column per variable; constants and repeated variables filter."""
    first: dict[str, str] = {}
    test: list[Column] = []
    for role, term in x.args:
        if role not in frame.columns:
            raise RuleError(f"{x.predicate} has no role {role}")
        if isinstance(term, Const):
            test.append(F.col(role) == F.lit(term.value))
        elif term != "_":
            if term in first:
                test.append(F.col(role) == F.col(first[term]))
            else:
                first[term] = role
    for t in test:
        frame = frame.where(t)
    return frame.select(CASE, *(F.col(role).alias(_var(v)) for v, role in first.items()))


def constants(frames: dict[str, DataFrame]) -> DataFrame:
    """case_id, value: every constant of a case, over all predicates and roles."""
    parts = [f.select(CASE, F.explode(F.array(*(F.col(c).cast("string") for c in f.columns if c != CASE))).alias("value")) for f in frames.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value is not null").distinct()


def _ranged(out: DataFrame, domain: DataFrame, free: list[str]) -> DataFrame:
    """The product of the rows of a case with its constants for each free variable, in blocks of about DOMAIN_BLOCK constants."""
    sizes = domain.groupBy(CASE).agg(F.ceil(F.count(F.lit(1)) / DOMAIN_BLOCK).alias("n_blocks"))
    values = domain.join(sizes, CASE).select(CASE, F.pmod(F.xxhash64("value"), F.col("n_blocks")).alias("block"), "value")
    for v in free:
        out = out.join(sizes, CASE).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).drop("n_blocks")
        out = out.join(values.withColumnRenamed("value", _var(v)), [CASE, "block"]).drop("block")
    return out


def body_frame(rule: Rule, frames: dict[str, DataFrame], domain_limit: int | None = None) -> DataFrame:
    """All groundings of the positive part of a body, one row each; negation is not applied.

    A variable that no positive literal binds ranges over the constants of its case, whatever their number. That is a product;
    with a `domain_limit`, a case with more constants is an error, never a silent cut.
    """
    out: DataFrame | None = None
    bound: set[str] = set()
    for x in rule.positives:
        part = _literal_frame(x, frames[x.predicate])
        shared = [_var(v) for v in x.variables if v in bound]
        out = part if out is None else out.join(part, [CASE, *shared])
        bound |= set(x.variables)
    free = [v for v in dict.fromkeys([*rule.head.variables, *(v for x in (*rule.helpers, *rule.negatives) for v in x.variables)]) if v not in bound]
    if out is None or free:
        domain = constants({p: f for p, f in frames.items() if p in {x.predicate for x in rule.body} or not rule.positives})
        if domain_limit is not None:
            sized = domain.join(domain.groupBy(CASE).agg(F.count(F.lit(1)).alias("n")), CASE)
            domain = sized.select(CASE, F.when(F.col("n") <= domain_limit, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("domain of case too large: "), F.col(CASE).cast("string")))).alias("value"))
        out = domain.select(CASE).distinct() if out is None else out
        out = _ranged(out, domain, free)
    for x in rule.helpers:
        a, b = (F.lit(t.value) if isinstance(t, Const) else F.col(_var(t)) for _, t in x.args)
        test = HELPER_TESTS[x.predicate](a, b)
        out = out.where(~test if x.negated else test)
    return out


def flagged(rule: Rule, body: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Groundings with holds_k: whether the k-th negated literal holds."""
    for k, x in enumerate(rule.negatives):
        if x.predicate in frames:
            part = _literal_frame(x, frames[x.predicate]).distinct().withColumn(f"holds_{k}", F.lit(True))
            body = body.join(part, [CASE, *(_var(v) for v in x.variables)], "left").withColumn(f"holds_{k}", F.coalesce(f"holds_{k}", F.lit(False)))
        else:
            body = body.withColumn(f"holds_{k}", F.lit(False))
    return body


def _any_flag(rule: Rule) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *(F.col(f"holds_{k}") for k in range(len(rule.negatives))))


def without_violations(rule: Rule, body: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Groundings for which no negated literal holds."""
    for x in rule.negatives:
        if x.predicate in frames:
            body = body.join(_literal_frame(x, frames[x.predicate]).distinct(), [CASE, *(_var(v) for v in x.variables)], "left_anti")
    return body


def _ground(x: Literal) -> Column:
    """The text of a literal under a row's variables; `_` stays."""
    return atom_key(F.lit(x.predicate), {role: F.lit("_") if t == "_" else F.lit(str(t.value)) if isinstance(t, Const) else F.col(_var(t)) for role, t in x.args})


def _substitution(rule: Rule) -> Column:
    names = sorted({v for x in (rule.head, *rule.body) for v in x.variables})
    return F.concat_ws(",", *(F.concat(F.lit(f"{v}="), F.col(_var(v)).cast("string")) for v in names))


def _heads(rule: Rule, order: int, body: DataFrame) -> DataFrame:
    roles = [(F.lit(t.value) if isinstance(t, Const) else F.col(_var(t))).alias(role) for role, t in rule.head.args]
    texts = lambda xs: F.array(*map(_ground, xs)) if xs else F.array().cast("array<string>")
    proof = F.struct(F.lit(order).alias("rule_order"), _substitution(rule).alias("substitution"), F.lit(rule.rule_id).alias("rule_id"), texts(rule.positives).alias("pos_atoms"), texts(rule.negatives).alias("naf_atoms"))
    return body.select(CASE, *roles, proof.alias("proof"))


def _best(df: DataFrame, roles: list[str]) -> DataFrame:
    """One proof per atom: the first rule, then the first substitution."""
    return df.groupBy(CASE, *roles).agg(F.min("proof").alias("proof"))


@dataclass
class Model:
    """Base and derived extensions. derived[p] also has `proof`: rule_order, substitution, rule_id, pos_atoms, naf_atoms."""

    rules: list[Rule]
    base: dict[str, DataFrame]
    derived: dict[str, DataFrame] = field(default_factory=dict)
    #: Per rule id, the groundings of its body with a flag for each negated literal that holds, where evaluation has kept them.
    bodies: dict[str, DataFrame] = field(default_factory=dict)

    def frames(self) -> dict[str, DataFrame]:
        out = dict(self.base)
        for p, d in self.derived.items():
            new = d.drop("proof")
            out[p] = out[p].unionByName(new) if p in out else new
        return out

    def atoms(self, only: set[str] | None = None) -> DataFrame:
        """case_id, predicate, atom, proof (null for base atoms) of the whole model, or of the predicates `only`."""
        parts = [_keyed(p, f.distinct()).withColumn("proof", F.lit(None).cast(PROOF)) for p, f in self.base.items() if only is None or p in only]
        parts += [_keyed(p, f, "proof") for p, f in self.derived.items() if only is None or p in only]
        if not parts:
            spark = next(iter((*self.base.values(), *self.derived.values()))).sparkSession
            return spark.createDataFrame([], f"case_id long, predicate string, atom string, proof {PROOF}")
        return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _keyed(predicate: str, frame: DataFrame, *more: str) -> DataFrame:
    key = atom_key(F.lit(predicate), {c: F.col(c) for c in frame.columns if c not in (CASE, "proof")})
    return frame.select(CASE, F.lit(predicate).alias("predicate"), key.alias("atom"), *more)


def atoms_of(frames: dict[str, DataFrame]) -> DataFrame:
    """case_id, predicate, atom of the rows of some predicates, one at least."""
    return _union([_keyed(p, f) for p, f in frames.items()])


def _linear(rules: list[Rule], p: str, frames: dict[str, DataFrame]) -> tuple[list[str], list[str]] | None:
    """The roles of p that recursive rules carry along and those they move, if every one has a single literal of p that hands
    carried values over unchanged and whose moved ones are bound by the rest of the body."""
    roles = [role for role, _ in rules[0].head.args]
    carried = set(roles)
    for r in rules:
        own = [x for x in r.positives if x.predicate == p]
        if len(own) != 1 or {role for role, _ in own[0].args} != set(roles) or any(t == "_" for _, t in (*own[0].args, *r.head.args)):
            return None
        head, back = dict(r.head.args), dict(own[0].args)
        uses = [t for x in (r.head, *r.body) for _, t in x.args if isinstance(t, str)]
        carried &= {c for c in roles if isinstance(head[c], str) and head[c] == back[c] and uses.count(head[c]) == 2}
    moved = [c for c in roles if c not in carried]
    for r in rules:
        rest = [x for x in r.positives if x.predicate != p]
        bound = {v for x in rest for v in x.variables}
        back = next(x for x in r.positives if x.predicate == p)
        needed = {t for x in (r.head, back) for role, t in x.args if role in moved and isinstance(t, str)}
        if not rest or not needed | {v for x in (*r.negatives, *r.helpers) for v in x.variables} <= bound:
            return None
    return ([c for c in roles if c in carried], moved) if moved else None


def _closed(rules: list[Rule], order: dict[str, int], p: str, carried: list[str], moved: list[str], known: dict[str, DataFrame], first: DataFrame | None) -> DataFrame | None:
    """Derived atoms of a linear recursion, by strides through the steps its rules allow; `first` has those of the other rules.

    An atom's proof is the first among those that rest on an atom one step nearer to the start, as a round-by-round loop finds it.
    """
    parts = [f.select(CASE, *carried, *moved) for f in (first, known.get(p)) if f is not None]
    if not parts:
        return None
    bodies = {}
    for r in rules:
        back = next(x for x in r.positives if x.predicate == p)
        step = Rule(r.rule_id, Literal(p, tuple((role, t) for role, t in r.head.args if role in moved)), tuple(x for x in r.body if x is not back))
        body = without_violations(step, body_frame(step, known), known)
        term = lambda t: F.lit(t.value) if isinstance(t, Const) else F.col(_var(t))
        ends = [term(t).alias(f"{side}_{role}") for side, x in (("s", back), ("t", r.head)) for role, t in x.args if role in moved]
        bodies[r.rule_id] = durable(body.select("*", *ends).distinct(), "steps")
    edges = _union([b.select(CASE, *(f"{side}_{c}" for side in "st" for c in moved)) for b in bodies.values()])
    atoms = durable(reached(_union(parts).withColumn("d", F.lit(0)), edges, [CASE], moved), "closure")
    before = atoms.select(CASE, *carried, *(F.col(c).alias(f"s_{c}") for c in moved), (F.col("d") + 1).alias("d"))
    after = atoms.select(CASE, *carried, *(F.col(c).alias(f"t_{c}") for c in moved), "d")
    proofs = []
    for r in rules:
        names = {c: _var(dict(r.head.args)[c]) for c in carried}
        body = bodies[r.rule_id].join(before, [CASE, *(f"s_{c}" for c in moved)]).join(after, [CASE, *carried, *(f"t_{c}" for c in moved), "d"])
        proofs.append(_heads(r, order[r.rule_id], body.withColumnsRenamed(names)))
    found = _best(_union(proofs), [*carried, *moved])
    return found if first is None else first.select(*found.columns).unionByName(found)


def evaluate(base: dict[str, DataFrame], rules: list[Rule]) -> Model:
    """The least model, group by group: plain joins where nothing is recursive, strides along linear recursions, and a
    semi-naive loop for the others.

    The bodies of rules with negation and all derived atoms are written once; what comes after reads those tables.
    The loop runs until a round adds no atom. It ends: atoms are made of the constants at hand, and each round adds some.
    """
    model = Model(list(rules), dict(base))
    order = {r.rule_id: k for k, r in enumerate(rules)}
    for group in evaluation_order(rules):
        own = [r for r in rules if r.head.predicate in group]
        roles = {p: [role for role, _ in next(r for r in own if r.head.predicate == p).head.args] for p in group}
        known = model.frames()
        recursive = any(x.predicate in group for r in own for x in r.positives)

        def fresh(rs: list[Rule], frames_of: Callable[[Rule], list[dict[str, DataFrame]]], have: dict[str, DataFrame], p: str, roles: dict = roles) -> DataFrame | None:
            out = None
            for r in rs:
                if r.head.predicate != p:
                    continue
                for frames in frames_of(r):
                    rows = _heads(r, order[r.rule_id], without_violations(r, body_frame(r, frames), frames))
                    out = rows if out is None else out.unionByName(rows)
            if out is None:
                return None
            out = _best(out, roles[p])
            return out.join(have[p].select(CASE, *roles[p]), [CASE, *roles[p]], "left_anti") if p in have else out

        if not recursive:
            for r in own:
                if r.negatives:
                    model.bodies[r.rule_id] = durable(flagged(r, body_frame(r, known), known), "body")
            for p in group:
                rows = None
                for r in own:
                    if r.head.predicate == p:
                        body = model.bodies[r.rule_id].where(~_any_flag(r)) if r.negatives else body_frame(r, known)
                        part = _heads(r, order[r.rule_id], body)
                        rows = part if rows is None else rows.unionByName(part)
                rows = _best(rows, roles[p])
                rows = rows.join(known[p].select(CASE, *roles[p]), [CASE, *roles[p]], "left_anti") if p in known else rows
                model.derived[p] = durable(rows, f"derived-{p}")
            continue
        start = [r for r in own if not any(x.predicate in group for x in r.positives)]
        turn = [r for r in own if r not in start]
        full: dict[str, DataFrame] = {}
        for p in group:
            first = fresh(start, lambda r, known=known: [known], known, p)
            if first is not None:
                full[p] = durable(first, f"fix-{p}")
        line = _linear(turn, group[0], known) if len(group) == 1 else None
        if line:
            p = group[0]
            closed = _closed(turn, order, p, *line, known, full.get(p))
            if closed is not None:
                model.derived[p] = durable(closed.select(CASE, *roles[p], "proof"), f"derived-{p}")
            continue
        delta = {p: full[p].select(CASE, *roles[p]) for p in full}
        delta |= {p: (delta[p].unionByName(known[p].select(CASE, *roles[p])) if p in delta else known[p].select(CASE, *roles[p])) for p in group if p in known}
        for turns_done in count(1):
            have = {p: f for p, f in known.items()}
            for p in full:
                own_rows = full[p].drop("proof")
                have[p] = have[p].select(*own_rows.columns).unionByName(own_rows) if p in known else own_rows

            def turns(r: Rule, have: dict = have, delta: dict = delta) -> list[dict[str, DataFrame]]:
                """The body with one recursive literal read from the last round's rows, for each such literal."""
                out = []
                for x in {x.predicate for x in r.positives if x.predicate in group}:
                    if x in delta:
                        out.append(have | {x: delta[x]} if sum(y.predicate == x for y in r.positives) == 1 else have)
                return out

            new = {p: f for p in group if (f := fresh(turn, turns, have, p)) is not None}
            new = {p: durable(f, f"fix-{p}") for p, f in new.items()}
            new = {p: f for p, f in new.items() if f.limit(1).count()}
            if not new:
                break
            for p, f in new.items():
                full[p] = full[p].unionByName(f) if p in full else f
                if turns_done % GATHER == 0:
                    full[p] = durable(full[p], f"fix-{p}")
            delta = {p: f.drop("proof") for p, f in new.items()}
        model.derived |= full
    return model


def violations(model: Model) -> DataFrame:
    """case_id, atom, rule_id, violated: heads whose positive body holds but some negated literal does too."""
    frames = model.frames()
    out = None
    for r in model.rules:
        if not r.negatives:
            continue
        body = model.bodies.get(r.rule_id)
        body = flagged(r, body_frame(r, frames), frames) if body is None else body
        head = atom_key(F.lit(r.head.predicate), {role: F.lit(str(t.value)) if isinstance(t, Const) else F.col(_var(t)) for role, t in r.head.args})
        hits = F.array_compact(F.array(*(F.when(F.col(f"holds_{k}"), _ground(x)) for k, x in enumerate(r.negatives))))
        part = body.where(_any_flag(r)).select(CASE, head.alias("atom"), F.lit(r.rule_id).alias("rule_id"), F.explode(hits).alias("violated"))
        out = part if out is None else out.unionByName(part)
    return out


def explain_missing(rule: Rule, frames: dict[str, DataFrame], atoms: DataFrame) -> DataFrame:
    """case_id, atom, missing: for asked head atoms, the positive literals of a rule that no fact matches on the head's roles."""
    heads = {role: t for role, t in rule.head.args if isinstance(t, str)}
    out = None
    for x in rule.positives:
        part = _literal_frame(x, frames[x.predicate])
        shared = [(role, t) for role, t in heads.items() if t in x.variables]
        asked = atoms.select(CASE, "atom", *(F.col(role).alias(_var(t)) for role, t in shared))
        gone = asked.join(part.select(CASE, *(_var(t) for _, t in shared)).distinct(), [CASE, *(_var(t) for _, t in shared)], "left_anti")
        row = gone.select(CASE, "atom", F.lit(x.predicate).alias("missing"))
        out = row if out is None else out.unionByName(row)
    return out
