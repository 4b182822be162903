"""Mixing sources to target weights by balanced sampling (the cube method).

A source that must give r times its words gives floor(r) whole copies of each document and samples the rest with inclusion
probability r - floor(r). The flight phase moves those probabilities through the null space of two constraints (documents and
words) until at most two per block stay fractional. It runs in blocks of documents side by side; what stays fractional goes
to the next level of fewer blocks, until one block per source is left, where the landing settles the last few documents.
Rows alike in doc_id, source and text are one row of the flight: moving probability among them keeps both balances, so m of
them with probability p are floor(m * p) taken ones and one with the fraction that is left.

Defined cases: a null text has size 0 and takes 0; null sources are one source, last in order; of repeated rows each is taken
as often as the others or once more; a source without words has target 0; very long texts are counted whole; other columns are
kept as they are, whatever their names; an empty table gives an empty result. Reruns agree: blocks, order and random numbers
come from hashes of the rows and the seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefact.llm.common import WORD, free_name, stored

BLOCK = 256
FEW = 1e-9
_ROW = "src string, doc_id long, size long, source_size long, target double, base long, m long, pi double, tag long"


def _tag() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def sizes(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """src (a key that keeps null apart), doc_id, size in words and a hash of the row; counted natively over whole texts."""
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~null")).alias("src"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _tag().alias("tag"),
        *([] if key is None else [key.alias("key")]),
    )


def _running(rows: DataFrame, order: list[Column | str], **values: Column) -> DataFrame:
    """rows with, for each value, its sum over the rows before in a total order. Rows are sorted over range partitions; only one
    row per partition is summed in one task."""
    rows = stored(rows.withColumns({f"own_{k}": v for k, v in values.items()}).repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "mix-order")
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("pid").agg(*(F.sum(f"own_{k}").alias(f"part_{k}") for k in values)).select("pid", *(F.coalesce(F.sum(f"part_{k}").over(ahead), F.lit(0)).alias(f"before_{k}") for k in values))
    inside = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(parts), "pid").withColumns({k: F.col(f"before_{k}") + F.coalesce(F.sum(f"own_{k}").over(inside), F.lit(0)) for k in values})
    return rows.drop("pid", *(f"own_{k}" for k in values), *(f"before_{k}" for k in values))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """src, n, source_size, target: weights repeat over the sources in code-point order, null last; no target exceeds cap times
    its source, and what is cut goes to the others by weight. In closed form: sources are capped in the order of
    cap * size / weight, up to the first that need not be."""
    s = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")).withColumn("last", F.col("src") == "~null")
    s = _running(s, ["last", "src"], place=F.lit(1))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("turn", F.col("most") / F.col("w"))
    s = _running(s, ["turn", "src"], capped=F.col("most"), used=F.col("w"))
    size, weight = s.agg(F.sum("source_size"), F.sum("w")).first()
    s = stored(s.withColumn("level", (F.lit(size or 0) - F.col("capped")) / (F.lit(weight or 0.0) - F.col("used"))), "mix-levels")
    level = s.where(F.col("level") * F.col("w") <= F.col("most")).agg(F.min_by("level", F.struct("turn", "src"))).first()[0]
    share = F.lit(level).cast("double") * F.col("w")
    return s.select("src", "n", "source_size", F.coalesce(F.least(F.col("most"), share), F.col("most")).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Moves the fractional entries of pi, three at a time, so that sum(pi) and sum(pi * size) stay; at most two stay fractional."""
    pi = pi.copy()
    live: list[int] = []
    for i in np.flatnonzero((pi > FEW) & (pi < 1 - FEW)):
        live.append(int(i))
        if len(live) < 3:
            continue
        a, b, c = live
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))  # in the null space of (1, size)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        _move(pi, live, u, draw)
        live = [k for k in live if FEW < pi[k] < 1 - FEW]
    return np.where(pi <= FEW, 0.0, np.where(pi >= 1 - FEW, 1.0, pi))


def _move(pi: np.ndarray, at: list[int], u: tuple[float, ...], draw: np.random.Generator) -> None:
    up = min(((1 - pi[k]) / x if x > 0 else pi[k] / -x) for k, x in zip(at, u, strict=False) if x)
    down = min((pi[k] / x if x > 0 else (1 - pi[k]) / -x) for k, x in zip(at, u, strict=False) if x)
    step = up if draw.random() * (up + down) < down else -down
    for k, x in zip(at, u, strict=False):
        pi[k] += step * x


def landing(pi: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Settles the last fractional entries: first the balance of words is kept, then only the expected count."""
    pi = pi.copy()
    while len(live := [int(k) for k in np.flatnonzero((pi > FEW) & (pi < 1 - FEW))]):
        if len(live) > 1:
            a, b = live[:2]
            _move(pi, [a, b], (float(size[b]), -float(size[a])) if size[a] and size[b] else (1.0, -1.0), draw)
        else:
            pi[live[0]] = float(draw.random() < pi[live[0]])
    return np.round(pi)


def _fly(seed: int, land: bool):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tag", "doc_id", "size"], ignore_index=True)
        draw = np.random.default_rng([seed, int(part["tag"].iloc[0]) & (2**63 - 1), len(part)])
        size = part["size"].to_numpy(np.int64)
        pi = flight(part["pi"].to_numpy(np.float64), size, draw)
        part["pi"] = landing(pi, size, draw) if land else pi
        return part[[c.split()[0] for c in _ROW.split(", ")]]

    return run


def _decided(rows: DataFrame, weights: tuple[int, ...], cap: int, block: int, seed: int) -> DataFrame:
    """For rows alike in all of sizes(): how many (m), and how often they are taken together (total)."""
    goal = stored(targets(rows, weights, cap), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    alike = rows.groupBy("src", "doc_id", "size", "tag").agg(F.count(F.lit(1)).alias("m"))
    x = alike.join(goal.select("src", "source_size", "target"), "src").withColumn("ratio", ratio)
    share = F.col("m") * (F.col("ratio") - F.floor("ratio"))
    x = x.withColumn("base", F.col("m") * F.floor("ratio") + F.floor(share)).withColumn("pi", share - F.floor(share))
    columns = [c.split()[0] for c in _ROW.split(", ")]
    todo = stored(x.select(*columns), "mix-start")
    done: DataFrame | None = None
    while True:
        counts = todo.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")
        todo = stored(todo.join(counts, "src").withColumn("block", F.pmod(F.xxhash64("tag", "doc_id", F.lit(seed)), blocks)).select(*columns, "block"), "mix-blocks")
        last = todo.agg(F.max("block")).first()[0] in (None, 0)
        level = stored(todo.groupBy("src", "block").applyInPandas(_fly(seed, last), _ROW), "mix-level")
        settled = level if last else level.where((F.col("pi") == 0) | (F.col("pi") == 1))
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done.withColumn("total", F.col("base") + F.col("pi").cast("long"))
        todo = level.where((F.col("pi") > 0) & (F.col("pi") < 1))
        seed += 1


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = BLOCK, seed: int = 9) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size * copies) of every document."""
    x = _decided(stored(sizes(docs), "mix-sizes"), weights, cap, block, seed)
    more = F.pmod("total", "m")
    lots = F.array(F.struct(F.floor(F.col("total") / F.col("m")).alias("copies"), (F.col("m") - more).alias("rows")), F.struct((F.floor(F.col("total") / F.col("m")) + 1).alias("copies"), more.alias("rows")))
    x = x.withColumn("lot", F.explode(F.filter(lots, lambda s: s["rows"] > 0))).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lot.rows"))))
    copies = F.col("lot.copies").cast("int")
    return x.select("doc_id", F.when(F.col("src") != "~null", F.substring("src", 2, 1 << 30)).alias("source"), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "tag")


def _places(x: DataFrame, group: list[str], key: str, salts: int = 256) -> DataFrame:
    """x with `place`, the number of each row in its group from 0, without sorting a whole group in one task."""
    x = x.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    ahead = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy(*group, "salt").agg(F.count(F.lit(1)).alias("k")).select(*group, "salt", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*group, "salt").orderBy(key)
    return x.withColumn("nth", F.row_number().over(inside)).join(before, [*group, "salt"]).withColumn("place", F.col("before") + F.col("nth") - 1)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = BLOCK, seed: int = 9) -> DataFrame:
    """The documents as the mix takes them, repeated by their copies, with all their columns.

    Rows alike in doc_id, source and text are taken equally often, some once more. Every row is decided by a key of its own, so
    columns may have any names; rows without doc_id, source or text are rows like others; an empty table gives an empty result.
    """
    key = free_name(docs, "mix_key")
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "mix-keyed")
    slim = stored(sizes(keyed, F.col(key)), "mix-sizes")
    group = ["src", "id", "size", "tag"]
    same = F.coalesce("doc_id", F.lit(0)).alias("id")  # a null doc_id is part of the tag
    decided = _decided(slim.drop("key"), weights, cap, block, seed).where("total > 0").select("src", same, "size", "tag", "m", "total")
    x = slim.select("key", "src", same, "size", "tag").join(decided, group).withColumn("copies", F.floor(F.col("total") / F.col("m"))).withColumn("more", F.pmod("total", "m"))
    some = _places(x.where("more > 0"), group, "key").withColumn("copies", F.col("copies") + (F.col("place") < F.col("more")).cast("long"))
    copies = x.where("more = 0").select("key", "copies").unionByName(some.select("key", "copies")).where("copies > 0").withColumnsRenamed({"key": key, "copies": (often := free_name(docs, "mix_copies"))})
    whole = keyed.join(copies, key)
    return whole.withColumn(often, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"`{often}`")))).select(*(F.col(f"`{c}`") for c in docs.columns))
