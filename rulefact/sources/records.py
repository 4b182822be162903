"""Readers and writers: case texts, query files, mixed-record JSON lines, ontologies, extractions. Bad rows go to an error frame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefact.sources.durable import in_parts

VERDICTS = ("proved", "not_proved", "blocked", "unknown")
QUERY_COLUMNS = ("case_id", "query", "expected_result")
EXTRACTION = "entities array<struct<id:string,type:string,name:string>>, facts array<struct<id:string,predicate:string,args:array<struct<role:string,value:string>>>>, states array<struct<entity:string,cluster:string,value:string>>"
ONTOLOGY = "entity_types array<string>, predicates array<struct<name:string,roles:array<struct<role:string,type:string>>>>, clusters array<struct<name:string,entity_type:string,domain:array<string>>>"


def case_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """case_id (the file's stem), source_id and content of every text that is not blank."""
    x = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select("value", "_metadata.file_name")
    case = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return x.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select(case.alias("case_id"), F.concat(case, F.lit("-TEXT")).alias("source_id"), F.col("value").alias("content"))


def write_texts(texts: DataFrame, folder: str, rows_each: int = 1000) -> None:
    """texts(name, text) as one UTF-8 file each, `<first three characters of the name>/<name>.txt`, so that paths sort as names do.

    Tasks write them through Arrow's file systems, with no folder, checksum and renaming for each file. In a store that those do not
    reach, Spark's own writer makes a folder `name=<name>` of each.
    """
    x = in_parts(texts.select(F.col("name").cast("string"), F.col("text").cast("binary")), texts.count(), rows_each, "name")
    try:
        fs.FileSystem.from_uri(folder)
    except (OSError, pa.ArrowInvalid):
        x.withColumn("text", F.col("text").cast("string")).write.partitionBy("name").text(folder)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, made = fs.FileSystem.from_uri(folder), set()
        for b in batches:
            for name, text in zip(b["name"].to_pylist(), b["text"]):
                into = f"{there[1]}/{name[:3]}"
                if into not in made:
                    there[0].create_dir(into, recursive=True)
                    made.add(into)
                with there[0].open_output_stream(f"{into}/{name}.txt") as out:
                    out.write(text.as_buffer())
                    out.write(b"\n")  # as Spark's writer ends a text; it reads no file of length 0
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, pa.schema([("n", pa.int64())]))

    x.where("name IS NOT NULL AND text IS NOT NULL").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def query_csv(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.csv(path, header=True)
    x = x.toDF(*(c.lstrip("﻿").strip() for c in x.columns))
    missing = [c for c in QUERY_COLUMNS if c not in x.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return x


def query_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, lines that are no JSON object) of a .jsonl or .ndjson file."""
    if not path.rstrip("/").endswith((".jsonl", ".ndjson")):
        raise ValueError(f"not a .jsonl or .ndjson file: {path}")
    x = spark.read.text(path).where(F.trim("value") != "")
    ok = F.trim("value").rlike(r"^\{") & F.try_parse_json("value").isNotNull()
    q = x.where(ok).select(F.from_json("value", "case_id string, query string, expected_result string, notes string").alias("q")).select("q.*")
    return q, x.where(~ok)


def normal_queries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a reason). Rows that are all blank, or without query and expectation, just go."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    x = rows.where(~(blank("query") & blank("expected_result"))).withColumns({"case_id": F.trim("case_id"), "query": F.trim("query"), "expected_result": F.lower(F.trim("expected_result"))})
    problem = F.when(blank("case_id") | blank("query") | blank("expected_result"), "missing_part").when(~F.col("expected_result").isin(*VERDICTS), "unknown_label")
    x = x.withColumn("reason", problem)
    return x.where("reason IS NULL").drop("reason"), x.where("reason IS NOT NULL")


def decoded(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Model replies as structs `reply`, and the rows that are no JSON object; code fences are stripped, where there are any."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(column), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    text = F.when(F.contains(F.col(column), F.lit("```")), bare).otherwise(F.trim(column))
    ok = F.startswith(text, F.lit("{")) & F.try_parse_json(text).isNotNull()
    return lines.where(ok).withColumn("reply", F.from_json(text, schema)), lines.where(~F.coalesce(ok, F.lit(False)))


def extraction_frames(rows: DataFrame, case: str, reply: str = "reply") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts with one row per argument, states) of parsed extractions."""
    e = rows.select(case, F.inline(f"{reply}.entities"))
    f = rows.select(case, F.inline(f"{reply}.facts")).select(case, F.col("id").alias("fact_id"), "predicate", F.posexplode("args").alias("position", "a")).select(case, "fact_id", "predicate", "position", "a.role", "a.value")
    return e, f, rows.select(case, F.inline(f"{reply}.states"))


def encoded(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def mixed_lines(frames: dict[str, DataFrame]) -> DataFrame:
    """One text column of JSON lines {record_type, payload} from a frame per record type."""
    out = None
    for kind, df in frames.items():
        part = df.select(F.to_json(F.struct(F.lit(kind).alias("record_type"), F.struct(*df.columns).alias("payload"))).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def read_mixed(lines: DataFrame, schemas: dict[str, str], needed: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """(a frame per record type, lines of unknown types); blank lines are none. A file without a record of a `needed` type is an
    error, as is one without its round."""
    lines = lines.where(F.trim("value") != "")
    kind = F.get_json_object("value", "$.record_type")
    there = {r[0] for r in lines.where(kind.isin(*needed)).select(kind).distinct().collect()} if needed else set()
    if missing := [x for x in needed if x not in there]:
        raise ValueError(f"no record of type {', '.join(missing)}")
    frames = {k: lines.where(kind == k).select(F.from_json("value", f"payload struct<{s}>").alias("x")).select("x.payload.*") for k, s in schemas.items()}
    return frames, lines.where(kind.isNull() | ~kind.isin(*schemas))


def ontology_frames(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entity types, predicate roles, clusters, domain values) of ontology documents."""
    types = docs.select(F.explode("entity_types").alias("entity_type")).distinct()
    roles = docs.select(F.inline("predicates")).select(F.lower("name").alias("predicate"), F.posexplode("roles").alias("position", "r")).select("predicate", "position", F.upper("r.role").alias("role"), F.col("r.type").alias("entity_type"))
    clusters = docs.select(F.inline("clusters")).select(F.col("name").alias("cluster"), "entity_type", "domain")
    values = clusters.select("cluster", F.posexplode("domain").alias("position", "value"))
    return types, roles, clusters.select("cluster", "entity_type"), values


def facts_with_args(facts: DataFrame, args: DataFrame) -> DataFrame:
    """Facts with their arguments as one ordered array."""
    packed = args.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "value"))).alias("args"))
    return facts.join(packed, "fact_id", "left")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def annotation_template(texts: DataFrame) -> DataFrame:
    """case_id, excerpt and blank columns for a query and its expected result."""
    return texts.select("case_id", "excerpt", F.lit("").alias("query"), F.lit("").alias("expected_result"))


def report_row(metrics: DataFrame) -> DataFrame:
    """A report (metric, value) as one line of JSON."""
    return metrics.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "value")))).alias("value"))


def proof_steps_of(runs: DataFrame) -> DataFrame:
    """proof_id, step, atom of runs(proof_id, dag), where dag is a JSON list of steps or an object of them."""
    step = "struct<step:long,atom:string>"
    steps = F.when(F.trim("dag").rlike(r"^\["), F.from_json("dag", f"array<{step}>")).otherwise(F.map_values(F.from_json("dag", f"map<string,{step}>")))
    return runs.select("proof_id", F.inline(F.array_sort(steps)))
