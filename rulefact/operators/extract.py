"""Extraction payloads as tables: entities, facts with arguments, and states that the text clamps.

Clusters and roles are few, as an ontology names them: they are broadcast, so that rows are not dealt by so few keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE = "case_id"
PAYLOAD = (
    "entities array<struct<entity_id:string,type:string,canonical_name:string,span_text:string>>, "
    "facts array<struct<predicate:string,args:array<struct<role:string,entity_id:string,literal_value:string>>,span_text:string>>, "
    "cluster_states array<struct<entity_id:string,cluster_name:string,value:string,span_text:string>>"
)
#: The two parties every text has, and the logit of a hard clamp.
IMPLICIT = [("CUST1", "CUSTOMER", "Klient"), ("STORE1", "STORE", "Sklep")]
CLAMP = 10.0


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def extracted_facts(rows: DataFrame) -> DataFrame:
    """case_id, ord, predicate, args(role, entity_id, literal_value), key, span_text of rows(case_id, reply): names in upper case,
    arguments without role or value go, so do facts without arguments; a fact told twice stays once, the first."""
    x = rows.select(CASE, F.posexplode("reply.facts").alias("ord", "f"))
    args = F.transform("f.args", lambda a: F.struct(F.upper(_filled(a["role"])).alias("role"), _filled(a["entity_id"]).alias("entity_id"), _filled(a["literal_value"]).alias("literal_value")))
    args = F.filter(args, lambda a: a["role"].isNotNull() & F.coalesce(a["entity_id"], a["literal_value"]).isNotNull())
    x = x.select(CASE, "ord", F.upper(_filled(F.col("f.predicate"))).alias("predicate"), args.alias("args"), _filled(F.col("f.span_text")).alias("span_text")).where("predicate IS NOT NULL AND size(args) > 0")
    key = F.concat_ws("|", F.array_sort(F.transform("args", lambda a: F.concat_ws(":", a["role"], F.coalesce(a["entity_id"], a["literal_value"])))))
    first = x.withColumn("key", key).groupBy(CASE, "predicate", "key").agg(F.min_by(F.struct("ord", "args", "span_text"), "ord").alias("x"))
    return first.select(CASE, "x.ord", "predicate", "x.args", "key", "x.span_text")


def extracted_states(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """case_id, ord, entity_id, cluster, entity_type, logits, is_clamped, clamp_hard, clamp_source, span_text: states of known
    clusters with a value of the domain, hard clamped; the first of an entity and cluster stays. schemas(cluster, entity_type, domain)."""
    x = rows.select(CASE, F.posexplode("reply.cluster_states").alias("ord", "s"))
    x = x.select(CASE, "ord", _filled(F.col("s.entity_id")).alias("entity_id"), F.trim("s.cluster_name").alias("cluster"), F.upper(_filled(F.col("s.value"))).alias("value"), _filled(F.col("s.span_text")).alias("span_text"))
    x = x.where("entity_id IS NOT NULL").join(F.broadcast(schemas), "cluster").where(F.array_contains("domain", F.col("value")))
    first = x.groupBy(CASE, "entity_id", "cluster").agg(F.min_by(F.struct("ord", "entity_type", "domain", "value", "span_text"), "ord").alias("x"))
    logits = F.transform("x.domain", lambda d: F.when(d == F.col("x.value"), CLAMP).otherwise(-CLAMP))
    return first.select(CASE, "x.ord", "entity_id", "cluster", "x.entity_type", logits.alias("logits"), F.lit(True).alias("is_clamped"), F.lit(True).alias("clamp_hard"), F.lit("text").alias("clamp_source"), "x.span_text")


def extracted_entities(rows: DataFrame, facts: DataFrame, states: DataFrame, role_types: DataFrame) -> DataFrame:
    """case_id, entity_id, type, canonical_name: the implicit parties, the payload's own, then those that only arguments (typed by
    role_types(role, entity_type)) or states name; the first mention of an id counts."""
    implicit = rows.select(CASE, F.inline(F.array(*(F.struct(F.lit(i).alias("entity_id"), F.lit(t).alias("type"), F.lit(n).alias("canonical_name"), F.lit(k).alias("ord")) for k, (i, t, n) in enumerate(IMPLICIT))))).withColumn("stage", F.lit(0))
    own = rows.select(CASE, F.posexplode("reply.entities").alias("ord", "e")).select(CASE, _filled(F.col("e.entity_id")).alias("entity_id"), F.upper(_filled(F.col("e.type"))).alias("type"), F.coalesce(_filled(F.col("e.canonical_name")), F.trim("e.entity_id")).alias("canonical_name"), "ord", F.lit(1).alias("stage"))
    args = facts.select(CASE, "ord", F.explode("args").alias("a")).select(CASE, "ord", "a.entity_id", "a.role").join(F.broadcast(role_types), "role")
    args = args.select(CASE, "entity_id", F.col("entity_type").alias("type"), F.col("entity_id").alias("canonical_name"), "ord", F.lit(2).alias("stage"))
    named = states.select(CASE, "entity_id", F.col("entity_type").alias("type"), F.col("entity_id").alias("canonical_name"), "ord", F.lit(3).alias("stage"))
    every = implicit.unionByName(own).unionByName(args).unionByName(named).where("entity_id IS NOT NULL AND type IS NOT NULL")
    return every.groupBy(CASE, "entity_id").agg(F.min(F.struct("stage", "ord", "type", "canonical_name")).alias("x")).select(CASE, "entity_id", "x.type", "x.canonical_name")
