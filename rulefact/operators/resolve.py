"""Entity linking, alignment of extracted facts to an ontology, and quality reports over raw extractions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.functions.scalars import name_uuid
from rulefact.operators.matching import any_class_links, overlapping
from rulefact.operators.nearest import PIECE
from rulefact.operators.nearest import _best as best_rows
from rulefact.operators.nearest import _matrix as matrix
from rulefact.operators.picks import first_wins, top


def match_scores(new: DataFrame, known: DataFrame) -> DataFrame:
    """old_id, entity_id, score of pairs of one type that share a canonical name, alias or blocking key.

    100 for equal canonical names, 20 per shared alias, 10 per shared key. Pairs that share a key and pairs that share a name only
    are made one after the other, each pair once, so that none has to be brought together with itself. What is null is not shared.
    """
    lower = F.transform(F.array_compact("aliases"), F.lower)

    def side(x: DataFrame, row_id: str, s: str) -> DataFrame:
        names = F.concat(F.array(F.lower("canonical_name")), F.coalesce(lower, F.array().cast("array<string>")))
        return x.select("type", F.col("entity_id").alias(row_id), F.lower("canonical_name").alias(f"name_{s}"), lower.alias(f"aliases_{s}"), F.array_compact("blocking_keys").alias(f"keys_{s}"), names.alias("names"), F.col("blocking_keys").alias("keys"))

    a, b = side(new, "old_id", "a"), side(known, "entity_id", "b")
    by_key = overlapping(a.drop("keys_a", "names"), b.drop("keys_b", "names"), "keys", ["type"])
    by_name = overlapping(a.drop("keys"), b.drop("keys"), "names", ["type"]).where(~F.coalesce(F.arrays_overlap("keys_a", "keys_b"), F.lit(False)))
    aliases = F.when((F.size("aliases_a") > 0) & (F.size("aliases_b") > 0), F.size(F.array_intersect("aliases_a", "aliases_b"))).otherwise(0)
    named = F.when(F.col("name_a") == F.col("name_b"), 100).otherwise(0) + 20 * aliases
    score = lambda pairs, keys: pairs.select("old_id", "entity_id", (named + keys).cast("int").alias("score"))
    return score(by_key, 10 * F.col("shared")).unionByName(score(by_name, F.lit(0)))


def match_classes(new: DataFrame, known: DataFrame) -> DataFrame:
    """What match_scores says, without a row for every pair: part, kind, id, class, score, as any_class_links has them.

    Entities of one type with the same names (parts `name`, 100, and `aliases`, 20 for each shared one) or the same keys (`keys`,
    10 each) are a class of that part; part `named` (0) links entities of which one's name is the other's alias. The score of two
    entities is the sum over the parts whose classes are paired; without such a part they are no candidates.
    """
    arrays = {"name": (F.array(F.lower("canonical_name")), 100), "aliases": (F.transform("aliases", F.lower), 20), "keys": (F.col("blocking_keys"), 10)}
    arrays["named"] = F.concat(arrays["name"][0], F.coalesce(arrays["aliases"][0], F.array().cast("array<string>"))), 0
    side = lambda x: x.select("type", "entity_id", *(k.alias(part) for part, (k, _) in arrays.items()))
    links = any_class_links(side(new), side(known), list(arrays), ("entity_id", "entity_id"), ("new", "known"), ["type"])
    weight = F.coalesce(*(F.when(F.col("part") == part, w) for part, (_, w) in arrays.items()))
    return links.select("part", "kind", "id", "class", (weight * F.col("shared")).alias("score"))


def _marks(x: DataFrame, row_id: str) -> DataFrame:
    """type, id, mark, weight: what entities can share. Names, aliases and keys are marks of their own kinds."""
    kind = lambda prefix, marks, weight: F.transform(F.array_distinct(marks), lambda m: F.struct(F.concat(F.lit(prefix), m).alias("mark"), F.lit(weight).alias("weight")))
    marks = F.concat(kind("n:", F.array(F.lower("canonical_name")), 100), kind("a:", F.transform("aliases", F.lower), 20), kind("k:", F.col("blocking_keys"), 10))
    each = x.select("type", F.col(row_id).alias("id"), F.explode(marks).alias("m")).select("type", "id", "m.mark", "m.weight")
    return each.where("mark IS NOT NULL").distinct()


def _with_common(marks: DataFrame, counts: DataFrame, rare: int) -> tuple[DataFrame, DataFrame]:
    """Rows of rare marks, each with the array of its entity's common ones; and type, id, common of entities that have any.
    A mark is common if more than `rare` known entities have it."""
    x = marks.join(counts, ["type", "mark"])
    common = x.where(F.col("n") > rare).groupBy("type", "id").agg(F.sort_array(F.collect_list(F.struct("mark", "weight"))).alias("common"))
    return x.where(F.col("n") <= rare).join(common, ["type", "id"], "left").select("type", "id", "mark", "weight", "common"), common


def best_matches(new: DataFrame, known: DataFrame, rare: int = 16) -> DataFrame:
    """old_id, entity_id, score: for each new entity the known one of its type with the highest score above 0, as match_scores
    counts it (ties: smallest id), without a row for every pair that shares a key.

    Pairs that share a mark of at most `rare` known entities are scored one by one. All others share common marks only, and
    there entities with the same common marks are alike: each set of them is represented by its smallest id, and sets meet sets.
    A representative scored so may score more by its rare marks; then the first way has found that.
    """
    ours, theirs = _marks(new, "entity_id"), _marks(known, "entity_id")
    counts = theirs.groupBy("type", "mark").agg(F.count(F.lit(1)).alias("n"))
    (new_rare, new_common), (known_rare, known_common) = _with_common(ours, counts, rare), _with_common(theirs, counts, rare)

    shared = F.aggregate(F.array_intersect(F.coalesce("common", F.array().cast("array<struct<mark:string,weight:int>>")), F.coalesce("common_b", F.array().cast("array<struct<mark:string,weight:int>>"))), F.lit(0), lambda s, m: s + m["weight"])
    pairs = new_rare.join(known_rare.select("type", "mark", F.col("id").alias("entity_id"), F.col("common").alias("common_b")), ["type", "mark"])
    pairs = pairs.groupBy(F.col("id").alias("old_id"), "entity_id").agg((F.sum("weight") + F.first(shared)).alias("score"))

    sets = lambda x, name: x.select("type", F.col("common").alias(name), F.explode("common").alias("m")).select("type", name, "m.mark", F.col("m.weight").alias(f"{name}_weight"))
    groups = known_common.groupBy("type", "common").agg(F.min("id").alias("entity_id"))
    meet = sets(new_common.select("type", "common").distinct(), "common").join(sets(groups, "theirs").drop("theirs_weight"), ["type", "mark"])
    meet = meet.groupBy("type", "common", "theirs").agg(F.sum("common_weight").alias("score")).join(groups.withColumnRenamed("common", "theirs"), ["type", "theirs"])
    best = meet.groupBy("type", "common").agg(F.min(F.struct((-F.col("score")).alias("minus"), "entity_id")).alias("b"))
    alike = new_common.join(best, ["type", "common"]).select(F.col("id").alias("old_id"), "b.entity_id", (-F.col("b.minus")).alias("score"))
    every = pairs.unionByName(alike).groupBy("old_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "entity_id")).alias("b"))
    return every.select("old_id", "b.entity_id", (-F.col("b.minus")).alias("score"))


def linked(new: DataFrame, scores: DataFrame) -> DataFrame:
    """old_id, entity_id, created: the best match (ties: smallest id), or the entity itself as a new one."""
    best = top(scores.where("score > 0"), ["old_id"], [F.desc("score"), F.col("entity_id")])
    x = new.select(F.col("entity_id").alias("old_id")).join(best.select("old_id", "entity_id"), "old_id", "left")
    return x.select("old_id", F.coalesce("entity_id", "old_id").alias("entity_id"), F.col("entity_id").isNull().alias("created"))


def aligned(args: DataFrame, roles: DataFrame, implicit: dict[str, str]) -> DataFrame:
    """fact_id, predicate, args (role=value in role order): facts brought to their predicate's roles.

    A role without an argument takes the implicit entity of its role, else the fact goes; facts alike after that are one.
    args(case_id, fact_id, predicate, role, value); roles(predicate, position, role).
    """
    facts = args.select("case_id", "fact_id", "predicate").distinct()
    want = facts.join(roles, "predicate")
    fill = F.coalesce(*(F.when(F.col("role") == r, F.lit(v)) for r, v in implicit.items()), F.lit(None).cast("string"))
    got = want.join(args.select("case_id", "fact_id", "role", "value"), ["case_id", "fact_id", "role"], "left").withColumn("value", F.coalesce("value", fill))
    whole = got.groupBy("case_id", "fact_id", "predicate").agg(F.array_sort(F.collect_list(F.struct("position", "role", "value"))).alias("x"), F.count_if(F.col("value").isNull()).alias("missing")).where("missing = 0")
    whole = whole.withColumn("args", F.concat_ws("|", F.transform("x", lambda a: F.concat(a["role"], F.lit("="), a["value"]))))
    return first_wins(whole, ["case_id", "predicate", "args"], ["fact_id"]).select("case_id", "fact_id", "predicate", "args", name_uuid(F.concat_ws("/", F.col("case_id").cast("string"), "predicate", "args")).alias("new_id"))


def referenced_entities(args: DataFrame, entities: DataFrame, type_of: Column) -> DataFrame:
    """Entities that facts name but no entity row declares, with their type."""
    named = args.where("entity_id is not null").select("case_id", "entity_id", "role").groupBy("case_id", "entity_id").agg(F.min("role").alias("role"))
    return named.join(entities.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_anti").select("case_id", "entity_id", type_of.alias("type"))


def known_only(states: DataFrame, entities: DataFrame) -> DataFrame:
    return states.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def conflicts(states: DataFrame, args: DataFrame, roles: DataFrame, entities: DataFrame) -> DataFrame:
    """case_id, kind, subject of six checks: values (several of one cluster), optional_args (one fact told twice with other
    arguments), unknown_predicate, unknown_role, undeclared_entity, bad_date."""
    known = roles.select("predicate").distinct()
    several = states.groupBy("case_id", F.concat_ws("/", F.col("entity_id").cast("string"), "cluster").alias("subject")).agg(F.count_distinct("value").alias("n")).where("n > 1").select("case_id", F.lit("values").alias("kind"), "subject")
    shape = args.groupBy("case_id", "fact_id", "predicate").agg(F.min(F.when(F.col("position") == 0, F.col("entity_id"))).alias("first"), F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("=", "role", "entity_id")))).alias("all"))
    told = shape.groupBy("case_id", F.concat_ws("/", "predicate", "first").alias("subject")).agg(F.count_distinct("all").alias("n")).where("n > 1").select("case_id", F.lit("optional_args").alias("kind"), "subject")
    predicate = args.join(known, "predicate", "left_anti").select("case_id", F.lit("unknown_predicate").alias("kind"), F.col("predicate").alias("subject")).distinct()
    role = args.join(known, "predicate", "left_semi").join(roles.select("predicate", "role").distinct(), ["predicate", "role"], "left_anti").select("case_id", F.lit("unknown_role").alias("kind"), F.concat_ws("/", "predicate", "role").alias("subject")).distinct()
    is_date = F.col("role") == "DATE"
    undeclared = args.where(~is_date).join(entities.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_anti").select("case_id", F.lit("undeclared_entity").alias("kind"), F.col("entity_id").alias("subject")).distinct()
    date = args.where(is_date & ~F.col("entity_id").rlike(r"^d_\d{4}_\d{2}_\d{2}$")).select("case_id", F.lit("bad_date").alias("kind"), F.col("entity_id").alias("subject")).distinct()
    return several.unionByName(told).unionByName(predicate).unionByName(role).unionByName(undeclared).unionByName(date)


def normal_roles(spec: DataFrame) -> DataFrame:
    """predicate (lower), position, role (upper; ARGi if blank); blank predicates go, the first of a (predicate, position) stays."""
    x = spec.where(F.trim("predicate") != "")
    x = x.select(F.lower(F.trim("predicate")).alias("predicate"), "position", F.upper(F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.concat(F.lit("ARG"), F.col("position").cast("string")))).alias("role"), "ord")
    return first_wins(x, ["predicate", "position"], ["ord"]).drop("ord")


def rule_problems(literals: DataFrame, roles: DataFrame) -> DataFrame:
    """rule_id, problem over literals(rule_id, is_head, negated, predicate, vars): no_head, undefined_head, arity, unsafe_head_variable."""
    arity = roles.groupBy("predicate").agg(F.count(F.lit(1)).alias("arity"))
    head = literals.where("is_head")
    none = literals.select("rule_id").distinct().join(head, "rule_id", "left_anti").select("rule_id", F.lit("no_head").alias("problem"))
    undefined = head.join(arity, "predicate", "left_anti").select("rule_id", F.lit("undefined_head").alias("problem"))
    wrong = literals.join(arity, "predicate").where(F.size("vars") != F.col("arity")).select("rule_id", F.lit("arity").alias("problem")).distinct()
    bound = literals.where("NOT is_head AND NOT negated").groupBy("rule_id").agg(F.array_distinct(F.flatten(F.collect_list("vars"))).alias("bound"))
    unsafe = head.join(bound, "rule_id", "left").where(F.size(F.array_except("vars", F.coalesce("bound", F.array().cast("array<string>")))) > 0).select("rule_id", F.lit("unsafe_head_variable").alias("problem"))
    return none.unionByName(undefined).unionByName(wrong).unionByName(unsafe)


def rule_table_problems(rules: DataFrame) -> DataFrame:
    """rule_id (#ord where it has none), problem over rules(ord, module, rule_id, predicate, vars): missing_id, duplicate_id,
    malformed (no predicate or no arguments); and, under the module's name, no_valid_rule where every rule has a problem."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    x = rules.withColumn("name", F.when(blank("rule_id"), F.concat(F.lit("#"), F.col("ord").cast("string"))).otherwise(F.col("rule_id")))
    several = x.where(~blank("rule_id")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit(True).alias("several"))
    x = x.join(several, "name", "left")
    tests = {"missing_id": blank("rule_id"), "duplicate_id": F.coalesce("several", F.lit(False)), "malformed": blank("predicate") | F.coalesce(F.size("vars") < 1, F.lit(True))}
    x = x.withColumn("problems", F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items()))))
    found = x.select(F.col("name").alias("rule_id"), F.explode("problems").alias("problem")).distinct()
    modules = x.groupBy("module").agg(F.min(F.size("problems")).alias("least")).where("least > 0").select(F.col("module").alias("rule_id"), F.lit("no_valid_rule").alias("problem"))
    return found.unionByName(modules)


def checked_queries(drafts: DataFrame, roles: DataFrame, most: int) -> DataFrame:
    """Drafted queries(case_id, ord, predicate, n_args, query) of known predicates and right arity, once, at most `most` a case."""
    arity = roles.groupBy("predicate").agg(F.count(F.lit(1)).alias("n_args"))
    ok = first_wins(drafts.join(arity, ["predicate", "n_args"], "left_semi"), ["case_id", "query"], ["ord"])
    return top(ok, ["case_id"], [F.col("ord")], most, rank="place")


def nearest_in_block(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """block, id, other, cosine, place: the k nearest by cosine (to 9 decimals) within a block, ties to the smaller id; a, b: (block, id, v).

    Queries and rows of a block meet as matrices, in groups of at most about PIECE each, and only a query's k best leave a group.
    A zero or non-finite vector has the cosine NaN with all others, which ranks first, as in SQL; a vector that is null, empty or
    holds a null, and vectors of different lengths, have none, which ranks last.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))
    kind = F.when(F.col("norm").isNull() | (F.size("v") < 1), "none").when(F.isnan("norm") | F.col("norm").isin(0.0, float("inf")), "wild").otherwise("plain")
    side = lambda df: df.where("block IS NOT NULL AND id IS NOT NULL").withColumn("norm", norm).withColumn("kind", kind).withColumn("size", F.when(F.col("kind") == "plain", F.size("v")))
    unit = F.transform("v", lambda x: x / F.col("norm")).alias("u")
    x, y = side(a), side(b).withColumnRenamed("id", "other")
    plain = lambda df: df.where("kind = 'plain'")
    count = lambda df: -(-(plain(df).groupBy("block", "size").count().agg(F.max("count")).first()[0] or 1) // PIECE)
    shares, pieces = count(x), count(y)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = ["block", "size", "share", "piece"]
    ours = plain(x).select("block", "size", "id", unit, dealt("id", shares).alias("share")).withColumn("piece", spread(pieces))
    theirs = plain(y).select("block", "size", "other", unit, dealt("other", pieces).alias("piece")).withColumn("share", spread(shares))

    def meet(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"block": [], "id": [], "other": [], "near": [], "cosine": []})
        ids, others = q["id"].to_numpy(), r["other"].to_numpy()
        u, w = matrix(q["u"].tolist(), key[1]), matrix(r["u"].tolist(), key[1])
        i, j, near = best_rows(ids, u, others, w, k)
        return pd.DataFrame({"block": [key[0]] * len(i), "id": ids[i], "other": others[j], "near": near, "cosine": np.einsum("ij,ij->i", u[i], w[j])})

    type_of = lambda df, c: df.schema[c].dataType.simpleString()
    met = ours.groupBy(*group).cogroup(theirs.groupBy(*group)).applyInPandas(meet, f"block {type_of(x, 'block')}, id {type_of(x, 'id')}, other {type_of(y, 'other')}, near double, cosine double")
    # Pairs without a number for a cosine go by ids alone: of each kind and length, k + 1 rows of a block are enough.
    few = top(y.select("block", "other", "kind", "size"), ["block", "kind", "size"], [F.col("other")], k + 1, rank="nth")
    p, q = x.select("block", "id", "kind", "size").alias("p"), few.alias("q")
    both = q.join(p, F.col("p.block") == F.col("q.block")).where("id <> other AND NOT (p.kind = 'plain' AND q.kind = 'plain' AND p.size = q.size)")
    wild = F.lit("wild").isin(F.col("p.kind"), F.col("q.kind")) & ~F.lit("none").isin(F.col("p.kind"), F.col("q.kind"))
    found = met.unionByName(both.select("p.block", "id", "other", *(F.when(wild, float("nan")).alias(c) for c in ("near", "cosine"))))
    w = Window.partitionBy("block", "id").orderBy(F.desc("near"), "other")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("near")
