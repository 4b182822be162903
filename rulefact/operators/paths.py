"""Shortest and longest ways through an edge table in a logarithmic number of rounds."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.sources.durable import durable


def _ways(edges: DataFrame, by: list[str], node: list[str]) -> int:
    """In how many ways an edge can follow an edge."""
    out = edges.groupBy(*by, *(F.col(f"s_{c}").alias(c) for c in node)).agg(F.count(F.lit(1)).alias("n_out"))
    inn = edges.groupBy(*by, *(F.col(f"t_{c}").alias(c) for c in node)).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(inn, [*by, *node]).agg(F.sum(F.col("n_out") * F.col("n_in"))).first()[0] or 0


def _squared(edges: DataFrame, by: list[str], node: list[str]) -> DataFrame:
    first = edges.select(*by, *(F.col(f"s_{c}") for c in node), *(F.col(f"t_{c}").alias(f"m_{c}") for c in node))
    then = edges.select(*by, *(F.col(f"s_{c}").alias(f"m_{c}") for c in node), *(F.col(f"t_{c}") for c in node))
    return first.join(then, [*by, *(f"m_{c}" for c in node)]).select(*edges.columns).distinct()


def reached(start: DataFrame, edges: DataFrame, by: list[str], node: list[str], longest: bool = False, dense: int = 4) -> DataFrame:
    """What is reached from start(by, others, node, d): the same columns, with the least or, of acyclic edges, the greatest d.

    edges(by, s_.., t_..) lead from a node to a node, under the same `by`; other columns of start go along unchanged.

    The edge table is squared after each round, so that round k takes strides of 2^(k - 1) edges from all that is known: n links
    take about log2(n) rounds, and on chains and trees upwards every power has no more rows than the edges. Where edges branch
    so much that the next power could have more than `dense` times their number, strides stay as they are, and each further
    round takes the last one's rows on by one stride. Both give the same: a row at distance d has one at d - stride before it.
    Rows with a null in `by` or node lead nowhere; repeated rows and edges count once.
    """
    keys = [c for c in start.columns if c != "d"]
    best = F.max("d") if longest else F.min("d")
    known = durable(start.groupBy(*keys).agg(best.alias("d")), "reached")
    edges = durable(edges.select(*by, *(f"s_{c}" for c in node), *(f"t_{c}" for c in node)).dropna().distinct(), "strides")
    size, stride, block, squaring = edges.count(), 1, known, True
    for turn in count(1):
        there = edges.select(*by, *(F.col(f"s_{c}").alias(c) for c in node), *(F.col(f"t_{c}") for c in node))
        moved = block.join(there, [*by, *node]).select(*(F.col(f"t_{c}").alias(c) if c in node else F.col(c) for c in keys), (F.col("d") + stride).alias("d"))
        new = moved.groupBy(*keys).agg(best.alias("d"))
        new = durable(new if longest else new.join(known.select(*keys), keys, "left_anti"), "reached")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if longest:
            known = durable(known.groupBy(*keys).agg(best.alias("d")), "reached")
        elif turn % 8 == 0:
            known = durable(known, "reached")
        squaring = squaring and _ways(edges, by, node) <= dense * size
        if squaring:
            edges, stride, block = durable(_squared(edges, by, node), "strides"), 2 * stride, known
        else:
            block = new
