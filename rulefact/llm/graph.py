"""Connected components of an edge table, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.llm.common import stored


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges(a, b) with least(a, m). The second key makes both sides plain exchanges, apart from the one that found the minima,
    so that Spark can split the rows of a star's centre among tasks."""
    again = F.xxhash64("a")
    return edges.withColumn("again", again).join(least.withColumn("again", again).hint("merge"), ["a", "again"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the smallest node it sees."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours and itself to the smallest of them; edges lead from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _with_least(edges, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root that has none: then the roots are found."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("x")).select("x.node", "x.out")
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 OR (out = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, root (the smallest node of its component) for every node with an edge; edges(a, b) of long, in any direction.

    Large-star and small-star rounds take turns until only stars are left; each round's edges are written to the shared folder.
    The edges never outgrow the input. Null ends are no edges; repeated edges count once; an empty table gives an empty result.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        edges = stored(_small_star(_large_star(edges)), "edges")
        if _all_stars(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
