"""Nearest entities by cosine over whole tables: signed projections, several probes, exact reranking.

Every row gets, in each of a few tables, a code with one bit per random direction (on which side of the mean it lies), of as many
bits as leave about `leaf` rows a code. A query asks its own code and all codes that differ only in its least certain bits: those
nearest to the mean. How many bits may differ, and in how many tables, is measured: the exact neighbours of a few queries among all
rows say which choice finds the wanted share of them for the fewest rows scored.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a shorter vector counts as if it
ended in zeros; equal rounded cosines go by the smaller id; repeated rows (one id, one vector) are one row; empty tables give an
empty result. Of equal vectors the k + 1 smallest ids are indexed: no query can return another.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.sources.durable import durable

#: Bits of a code at most; tables at most; queries whose exact neighbours are looked up to choose the probes.
MOST_BITS, MOST_TABLES, ASKED = 30, 4, 64
#: Rows and queries of one group that meet in a task.
PIECE = 8192


class Probes(NamedTuple):
    """What was chosen: tables, bits of a code, bits of it that may differ, and the share of exact neighbours found so."""

    tables: int
    bits: int
    differ: int
    recall: float


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p, F.lit(0.0)) * F.coalesce(q, F.lit(0.0))), F.lit(0.0), lambda s, z: s + z)


def _units(df: DataFrame) -> DataFrame:
    """id, u: each valid vector scaled to length 1 (first by its largest component, so that squares stay finite)."""
    v = F.col("v").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    top = F.array_max(F.transform("w", F.abs))
    x = df.select("id", v.alias("w")).where(finite & F.col("id").isNotNull()).withColumn("top", top).where("top > 0")
    x = x.select("id", F.transform("w", lambda y: y / F.col("top")).alias("w"))
    length = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, y: s + y * y))
    return x.withColumn("length", length).select("id", F.transform("w", lambda y: y / F.col("length")).alias("u")).distinct()


def _fewest_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids; Spark cuts the groups before it shuffles them."""
    w = Window.partitionBy("h", "u").orderBy("id")
    return rows.withColumn("h", F.xxhash64("u")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).drop("place", "h")


def _sides(rows: DataFrame, directions: DataFrame) -> DataFrame:
    """rows with s: how far each lies from the mean in every direction; `directions` is one row of bounded size."""
    return rows.join(F.broadcast(directions)).withColumn("s", F.transform("directions", lambda d: _dot(d, F.col("u")))).drop("directions")


def _code(s: Column) -> Column:
    bits = F.transform(s, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda c, b: c + b)


def _codes(tables: int, bits: int) -> Column:
    """The code of every table."""
    return F.array(*(_code(F.slice("s", l * bits + 1, bits)) for l in range(tables)))


def _uncertain(table: int, bits: int) -> Column:
    """The bits of a table's code as weights, least certain first."""
    far = F.transform(F.slice("s", table * bits + 1, bits), lambda x, i: F.struct(F.abs(x).alias("far"), i.cast("int").alias("i")))
    return F.transform(F.array_sort(far), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b["i"]))


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of one width; shorter ones end in zeros (and of longer ones the rest would meet zeros only)."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v[:width]
    return out


def _best(query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k best others: positions of query and row, and cosines to 9 decimals. At most about `most` at once."""
    order = np.argsort(ids, kind="stable")
    ids, y, out, at = ids[order], y[order], [], max(1, most // max(1, len(ids)))
    for a in range(0, len(x), at):
        c = np.round(x[a : a + at] @ y.T, 9)
        c[query_ids[a : a + at, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            edge = np.partition(c, len(ids) - k, axis=1)[:, len(ids) - k, None]
            above, level = c > edge, c == edge
            take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))  # ties: the smaller ids
        else:
            take = np.ones(c.shape, bool)
        q, r = np.nonzero(take & (c > -np.inf))
        out.append((q + a, order[r], c[q, r]))
    return tuple(np.concatenate(z) for z in zip(*out))


def _choose(queries: DataFrame, rows: DataFrame, k: int, bits: int, width: int, recall: float) -> Probes:
    """The tables and differing bits of fewest codes that find `recall` of the exact neighbours of ASKED queries."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(ASKED).select("id", "u", "s")
    held = asked.select("id", "u").collect()
    ids, x = np.array([r.id for r in held]), _matrix([r.u for r in held], width)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            q, r, cosine = _best(ids, x, t["other"].to_numpy(), _matrix(t["w"].tolist(), width), k)
            yield pd.DataFrame({"id": ids[q], "other": t["other"].to_numpy()[r], "theirs": t["theirs"].to_numpy()[r], "cosine": cosine})

    kind = rows.schema["id"].dataType.simpleString()
    if not held:
        return Probes(1, bits, 0, 1.0)
    pairs = rows.select(F.col("id").alias("other"), F.col("u").alias("w"), _codes(MOST_TABLES, bits).alias("theirs")).mapInPandas(near, f"id {kind}, other {kind}, theirs array<long>, cosine double")
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("place") <= k).join(F.broadcast(asked.select("id", "s")), "id")
    ours = _codes(MOST_TABLES, bits)
    last = lambda l: F.aggregate(F.transform(_uncertain(l, bits), lambda w, i: F.when(F.get(ours, F.lit(l)).bitwiseXOR(F.get("theirs", F.lit(l))).bitwiseAND(w) != 0, i.cast("int") + 1).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y))
    needed = best.select(F.array(*(last(l) for l in range(MOST_TABLES))).alias("needed")).groupBy("needed").count().collect()
    total = sum(r["count"] for r in needed)
    found = lambda tables, differ: sum(r["count"] for r in needed if min(r.needed[:tables]) <= differ) / total if total else 1.0
    choices = [(tables * 2**differ, tables, differ) for tables in range(1, MOST_TABLES + 1) for differ in range(bits + 1)]
    _, tables, differ = min(c for c in choices if found(*c[1:]) >= recall)
    return Probes(tables, bits, differ, found(tables, differ))


def nearest(queries: DataFrame, rows: DataFrame, k: int, recall: float = 0.95, leaf: int = 512, seed: int = 0) -> tuple[DataFrame, Probes]:
    """id, other, cosine (to 9 decimals), place: the k nearest rows found for each query, itself left out; and the probes chosen.

    queries, rows: (id, v). Queries and rows of one code meet as matrices, and only a query's k best of each group leave it. With
    all bits of one table free to differ the search is exhaustive, so any `recall` up to 1 is met on the queries measured.
    """
    spark = rows.sparkSession
    a, b = _units(queries), durable(_fewest_copies(_units(rows), k), "nearest-rows")
    n, width = b.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("u")), F.lit(0))).first()
    bits = min(MOST_BITS, max(0, int(math.log2(max(1, n / leaf)))))
    g = random.Random(seed)
    drawn = [[g.gauss(0, 1) for _ in range(width)] for _ in range(MOST_TABLES * bits)]
    middle = dict(b.select(F.posexplode("u")).groupBy("pos").agg(F.sum("col") / max(n, 1)).collect())
    shift = [float(sum(d[i] * middle.get(i, 0.0) for i in range(width))) for d in drawn]
    directions = spark.createDataFrame([(drawn, shift)], "directions array<array<double>>, shift array<double>")
    side = lambda x: _sides(x, directions).withColumn("s", F.zip_with("s", "shift", lambda p, q: p - q)).drop("shift")
    a, b = durable(side(a), "nearest-queries"), durable(side(b), "nearest-sides")
    probes = _choose(a, b, k, bits, width, recall)

    codes, tables = _codes(probes.tables, bits), range(probes.tables)
    free = [F.slice(_uncertain(l, bits), 1, probes.differ) for l in tables]
    asks = lambda l: F.aggregate(free[l], F.array(F.get(codes, F.lit(l))), lambda found, w: F.concat(found, F.transform(found, lambda c: c.bitwiseXOR(w))))
    ours = a.select("id", "u", F.array(*map(asks, tables)).alias("asked")).select("id", "u", F.posexplode("asked").alias("table", "asked")).select("id", "u", "table", F.explode("asked").alias("code"))
    theirs = b.select(F.col("id").alias("other"), F.col("u").alias("w"), F.posexplode(codes).alias("table", "code"))
    # Groups stay bounded: a code's rows lie in as many pieces as the fullest code needs, all queries in as many as there are.
    fullest = theirs.groupBy("table", "code").count().agg(F.max("count")).first()[0] or 1
    pieces, shares = -(-fullest // PIECE), max(1, -(-a.count() // PIECE))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = ours.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")).withColumn("piece", spread(pieces))
    theirs = theirs.withColumn("piece", F.pmod(F.xxhash64("other"), F.lit(pieces)).cast("int")).withColumn("share", spread(shares))
    group = ["table", "code", "piece", "share"]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        ids, others = x["id"].to_numpy(), y["other"].to_numpy()
        q, r, cosine = _best(ids, _matrix(x["u"].tolist(), width), others, _matrix(y["w"].tolist(), width), k)
        return pd.DataFrame({"id": ids[q], "other": others[r], "cosine": cosine})

    kinds = [x.schema["id"].dataType.simpleString() for x in (a, b)]
    met = ours.groupBy(*group).cogroup(theirs.groupBy(*group)).applyInPandas(meet, f"id {kinds[0]}, other {kinds[1]}, cosine double")
    met = met.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))  # several tables may find a row
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k), probes
